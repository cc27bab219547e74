"""The registered queries themselves, over small tables, against plain versions."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from keelson.llm.queries import ORACLES, QUERIES

from .fixtures import documents, rows
from .test_dedup import brute_components, brute_fingerprint, brute_minimax


def markup(rng, depth=0):
    """Random page text and what it shows, as words and breaks (1: a new line, 2: a blank line)."""
    html, shown = "", []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "div", "p", "span", "none", "css", "seen"] if depth < 4 else ["text"])
        if kind == "text":
            words = [rng.choice(["ab", "cd", "é", "x1"]) for _ in range(rng.randint(1, 3))]
            html += " " + rng.choice(["  ", "\n"]).join(words) + " "
            shown += words
            continue
        inner, seen = markup(rng, depth + 1)
        if kind == "p" and "<div" not in inner and "<p" not in inner:
            html, shown = f"{html}<p>{inner}</p>", [*shown, 2, *seen, 2]
        elif kind == "div":
            html, shown = f"{html}<div>{inner}</div>", [*shown, 1, *seen, 1]
        elif kind == "none":
            html += f"<div style='display: none'>{inner}</div>"
        elif kind == "css":
            html += f"<div class='gone other'>{inner}</div>"
        elif kind == "seen":
            html, shown = f"{html}<div class=other>{inner}</div>", [*shown, 1, *seen, 1]
        elif "<div" not in inner and "<p" not in inner:
            html, shown = f"{html}<span>{inner}</span>", shown + seen
        else:
            html, shown = f"{html}<div>{inner}</div>", [*shown, 1, *seen, 1]
    return html, shown


def printed(shown):
    out, gap = "", 0
    for x in shown:
        if isinstance(x, int):
            gap = max(gap, x)
        else:
            out += ("\n" * gap if gap else " ") * bool(out) + x
            gap = 0
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    documents(spark, [r for r in rows() if r[0] is not None]).write.parquet(f"{path}/documents.parquet")
    rng = random.Random(12)
    pages = [(i, *markup(rng)) for i in range(80)]
    pages = [(i, f"<style>.gone {{ display: none }}</style><body>{html}</body>", printed(shown)) for i, html, shown in pages] + [(900, None, ""), (901, "", "")]
    spark.createDataFrame([(a, "u", b) for a, b, _ in pages], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    talk = [(c, t, ["user", "assistant"][t % 2], rng.choice(["hi", 'a "b"\n', "é", "", None])) for c in range(6) for t in range(rng.randint(0, 9))]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path), [r for r in rows() if r[0] is not None], {a: c for a, _, c in pages}, talk


def test_op5(spark, folder):
    path, data, _, _ = folder
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, path).collect()}
    prints = {k: brute_fingerprint(t, 3) for k, t in data}
    roots = brute_components(prints, 2)
    assert got == {k: (f"{p:016x}", roots[k]) for k, p in prints.items()}


def test_op8(spark, folder):
    path, _, pages, _ = folder
    assert {r["page_id"]: r["text"] for r in QUERIES["op8_html"](spark, path).collect()} == pages


def test_op9(spark, folder):
    from tokenizers import Tokenizer

    path, data, _, _ = folder
    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for k, t in sorted(data):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op9_token_ids"](spark, path).collect())) == want


def test_op10(spark, folder):
    path, data, _, _ = folder
    got = {r["doc_id"]: r for r in QUERIES["op10_shards"](spark, path).collect()}
    groups: dict = {}
    for k, t in sorted(data):
        groups.setdefault(t, []).append(k)
    size = {t: len((t or "").encode()) + 1 for t in groups}
    ordered = sorted(groups, key=lambda t: groups[t][0])
    shard_of = dict(zip(ordered, brute_minimax([size[t] * len(groups[t]) for t in ordered], 16), strict=True))
    slots: dict = {}
    for t in ordered:
        for k in groups[t]:
            slot = slots[shard_of[t]] = slots.get(shard_of[t], -1) + 1
            assert tuple(got[k])[:7] == (k, size[t], zlib.crc32((t or "").encode()), "bytes", shard_of[t], slot, None)
    assert len(got) == len(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{folder[0]}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder[0])
    columns = sorted(df.columns)
    assert sorted(con.sql(ORACLES[name]).columns) == columns
    want = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want, key=str)


def test_op6_links_every_result(spark, folder):
    talk = folder[3]
    got = QUERIES["op6_chat"](spark, folder[0]).collect()
    assert len(got) == len(talk) + sum(r == "assistant" for _, _, r, _ in talk)
    by: dict = {}
    for r in got:
        by.setdefault(r["conv_id"], {})[r["position"]] = json.loads(r["line"])
    for lines in by.values():
        assert sorted(lines) == list(range(len(lines)))
        place = {c["id"]: i for i, x in lines.items() for c in x.get("tool_calls", ())}
        assert all(x["linked"] and place[x["tool_call_id"]] < i for i, x in lines.items() if x["role"] == "tool")
    assert sum(r["n_problems"] for r in got) == sum(not t for _, _, r, t in talk if r == "assistant") + sum(n > 5 for _, n, r, _ in talk if r == "assistant")


def test_op4(spark, folder):
    path, data, _, _ = folder
    got = {r["doc_id"]: r for r in QUERIES["op4_fingerprint"](spark, path).collect()}
    ordered = sorted(data)
    for i, (k, t) in enumerate(ordered):
        t, following = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert got[k]["near_edited"] == float(got[k]["fingerprint"] == got[k]["edited_fingerprint"])
    assert len({r["fingerprint"] for r in got.values()}) == len({r["group_id"] for r in got.values()})
