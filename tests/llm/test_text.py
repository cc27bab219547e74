"""Language ID, decontamination, HTML and chat."""

import json
import random
import zlib

import numpy as np
import pytest

from keelson.llm import chat, decontam, html, langid

from .fixtures import documents, rows


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    kinds = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "äöüßklmno"}
    data = [(i, prose(rng, kinds[k], 30), k) for i, k in enumerate(rng.choices(sorted(kinds), k=300))]
    data += [(1000, None, "aa"), (1001, "12 .. !", "aa"), (1002, "", None), (1003, prose(rng, kinds["bb"], 5), None), (None, prose(rng, kinds["cc"], 9), "aa")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert len(got) == len(data)
    for k, text, lang in data:
        r = got[k]
        assert r["held_out"] == (k is None or zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if not langid.has_letter(text):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert got[1003]["lang_pred"] == "bb" and got[None]["lang_pred"] == "cc"
    tried = [(k, lang) for k, t, lang in data[:300] if got[k]["held_out"]]
    assert sum(got[k]["lang_pred"] == lang for k, lang in tried) >= 0.98 * len(tried)
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, t, _ in data if langid.has_letter(t)}


def test_language_features_by_hand():
    buckets, starts = langid.features(["Ab", "", "c"])
    assert starts.tolist() == [0, 12, 18] and len(buckets) == 27
    alone = [np.sort(langid.features([t])[0]) for t in ("Ab", "", "c")]
    for part, want in zip(np.split(buckets, starts[1:]), alone, strict=True):
        assert np.sort(part).tolist() == want.tolist()


def test_language_equals_plain_naive_bayes(spark, tmp_path):
    """The registered query against counts in plain Python, over texts of several lengths, odd ones included."""
    import collections
    import math

    from keelson.llm.queries import QUERIES

    rng = random.Random(9)
    kinds = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "äöüßklmno"}
    data = [(i, prose(rng, kinds[k], rng.choice([1, 3, 30])), k if rng.random() < 0.8 else None) for i, k in enumerate(rng.choices(sorted(kinds), k=120))]
    data += [(500 + i, t, "aa") for i, (_, t) in enumerate(rows())] + [(None, "abc", "bb")]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def grams(text):
        points = [ord(c) for c in f" {text.lower()} "]
        for n in range(3):
            for i in range(len(points) - n):
                g = 0
                for c in points[i : i + n + 1]:
                    g = (g * 0x100000001B3 + c) % (1 << 64)
                yield (g * langid.MULTIPLIERS[n]) % (1 << 64) >> 48

    counts, sizes = {}, collections.Counter()
    for k, text, lang in data:
        if lang is not None and k is not None and text is not None and zlib.crc32(str(k).encode()) % 3 != 1:
            sizes[lang] += 1
            if any(map(str.isalpha, text)):
                counts.setdefault(lang, collections.Counter()).update(grams(text))
    totals = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
    got = {r["doc_id"]: r for r in QUERIES["op2_language"](spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for k, text, _ in data:
        if not langid.has_letter(text):
            assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
            continue
        found = list(grams(text))
        logs = {n: math.log(sizes[n] / sum(sizes.values())) + sum(math.log((c[g] + 0.5) / totals[n]) for g in found) for n, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        share = 1 / sum(math.exp(min(v - logs[best], 0)) for v in logs.values())
        if share > 0.51:
            assert got[k]["lang_pred"] == best and abs(got[k]["score"] - share) < 1e-3


def test_foreign_texts_go(spark):
    rng = random.Random(10)
    data = [(i, prose(rng, "abcdefghi", 40), "aa") for i in range(60)] + [(100, "Это другой язык, которого никто не изучал", "aa"), (101, "日本語の文章です", None)]
    data += [(102, "4734663219866878 978463 bad cabbage 1111222233334444 5555", None), (103, "12 34", "aa")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    left = {r["doc_id"] for r in langid.keep_known(df, langid.train(df.where("doc_id < 100"))).collect()}
    assert left == {*range(60), 102}


def test_language_without_labels(spark):
    df = documents(spark, rows()).drop("lang").selectExpr("*", "cast(null as string) lang")
    model = langid.train(df)
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}
    assert langid.keep_known(df, model).count() == 0
    assert langid.predict(documents(spark, []), langid.train(documents(spark, []))).count() == 0


def edit_distance_within(pattern: str, text: str) -> int:
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnop"
    items = [(i, prose(rng, letters, rng.randint(12, 30))) for i in range(8)] + [(90, None), (91, ""), (92, "zq"), (93, "?!")]

    def hurt(text, n):
        out = list(text)
        for _ in range(n):
            i = rng.randrange(len(out))
            out[i] = rng.choice(["", "x", out[i] + "y"])
        return "".join(out)

    data = [(None, "some zq here"), (1, None), (2, "")]
    for i in range(60):
        item = rng.choice(items[:8])[1]
        inner = hurt(item, rng.choice([0, 0, 3, int(len(item) * 0.09), int(len(item) * 0.13), len(item) // 3]))
        if rng.random() < 0.3:
            inner = inner.upper().replace(" ", " !! ")
        data.append((10 + i, prose(rng, letters, rng.randint(0, 30)) + " " + inner + "\n" + prose(rng, letters, rng.randint(0, 30))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.matches(documents(spark, data), bench).collect()}
    want = {}
    for k, text in data:
        for i, item in items:
            folded = decontam.fold(item)
            if not folded:
                continue
            edits = edit_distance_within(folded, decontam.fold(text)) if len(folded) >= decontam.Q else 0 if f" {folded} " in f" {decontam.fold(text)} " else 99
            if edits <= int(len(folded) * decontam.RATE):
                want[k, i] = edits
    assert got == want and len(want) > 20
    left = decontam.remove(documents(spark, data), bench)
    assert left.columns == documents(spark, data).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(k) for k, _ in data if k not in {a for a, _ in want})


def test_decontamination_of_short_items_equals_brute_force():
    """Items of 1 to 40 characters, with edits within and beyond their budget, in texts of one batch."""
    rng = random.Random(4)
    block, names = decontam.Block(), [decontam.fold("".join(rng.choice("abcdefgh ") for _ in range(n))) or "a" for n in range(1, 41) for _ in range(3)]
    for i, name in enumerate(names):
        block.add(i, name)
    block.index()
    texts = [""]
    for name in names + ["abcdefghij", "abcdefghijabcdefghij"]:
        out = list(name)
        for _ in range(rng.randint(0, len(name) // 10 + 1)):
            out[rng.randrange(len(out))] = rng.choice(["", "h", "ab"])
        texts.append(decontam.fold("".join([*(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 30))), " ", *out, " ", *(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 30)))])))
    inexact = 0
    for text, got in zip(texts, block.match(texts), strict=True):
        want = {}
        for i, name in enumerate(names):
            edits = edit_distance_within(name, text) if len(name) >= decontam.Q else 0 if f" {name} " in f" {text} " else 99
            if edits <= int(len(name) * decontam.RATE):
                want[i] = edits
        assert got == want
        inexact += sum(map(bool, want.values()))
    assert inexact > 30
    one = decontam.Block()
    one.add(0, "abcdefghij")
    assert one.index().match(["abcdeXghij".lower(), "zz abcdeghij zz", "abcdXghiX".lower()]) == [{0: 1}, {0: 1}, {}]


def test_decontamination_of_monotonous_texts_is_bounded(monkeypatch):
    """Pieces of few pairs find what one large piece finds; a long text of one letter takes little memory."""
    import tracemalloc

    rng = random.Random(6)
    block = decontam.Block()
    for i in range(6):
        block.add(i, "".join(rng.choice("ab") for _ in range(60 + 90 * i)))
    block.add(6, "a" * 400)
    block.index()
    texts = ["".join(rng.choice("ab") for _ in range(3000)) + block.windows[3][:-4] + "".join(rng.choice("ab") for _ in range(9000)) + block.windows[5] for _ in range(2)] + ["b" + "a" * 900, ""]
    want = block.match(texts)
    assert want[0][3] <= 4 and want[0][5] == 0 and want[2] == {6: 0}
    monkeypatch.setattr(decontam, "PAIRS", 500)
    monkeypatch.setattr(decontam, "STRETCH", 2000)
    assert block.match(texts) == want
    monkeypatch.undo()
    alone = decontam.Block()
    alone.add(0, "a" * 400)
    alone.index()
    tracemalloc.start()
    assert alone.match(["a" * 1_000_000]) == [{0: 0}]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_decontamination_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(documents(spark), empty).count() == 0
    assert decontam.remove(documents(spark), empty).count() == documents(spark).count()
    rng = random.Random(3)
    long = prose(rng, "abcdef", 400)
    bench = spark.createDataFrame([(1, long), (1, long), (2, "short text")], "item_id long, text string")
    docs = documents(spark, [(7, "x " + long[600:1400] + " y"), (8, "a short text.")])
    assert sorted(map(tuple, decontam.matches(docs, bench).collect())) == [(7, 1, 0), (7, 1, 0), (8, 2, 0)]
    monkeypatch.setattr(decontam, "GROUP", 1)
    assert sorted(map(tuple, decontam.matches(docs, bench).collect())) == [(7, 1, 0), (7, 1, 0), (8, 2, 0)]
    assert decontam.remove(docs, bench).count() == 0
    assert decontam.matches(documents(spark, []), bench).count() == 0 and decontam.remove(documents(spark, []), bench).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("a &lt; b&nbsp;c", "a < b\xa0c"),
        ("<title>t</title><p>one<p>two <b>bold<p>three", "one\n\ntwo bold\n\nthree"),
        ("<head><meta><style>x</style></head><body>y<script>z</script><!-- c -->", "y"),
        ("<div>a</div><div>b<div>c</div></div>d", "a\nb\nc\nd"),
        ("<ul><li>a<li>b<ul><li>c</ul></li></ul>d", "- a\n- b\n  - c\n\nd"),
        ("<ol start=3><li>a<li><p>b<p>c</ol>", "3. a\n\n4. b\n\n   c"),
        ("<table><tr><th>n<th>name<tr><td>1<td>x<tr><td>200<td>long name</table>", "n    name\n1    x\n200  long name"),
        ("<table><tr><td colspan=2>wide<td>e<tr><td>a<td>b<td>c</table>", "wide  e\na  b  c"),
        ("<table><tr><td>a<br>b<td><table><tr><td>in</table></table>", "a  in\nb"),
        ("<p hidden>no</p><p style='color:red; display : none'>no</p><p>yes</p><dialog>no</dialog>", "yes"),
        ("<pre>  a\n    b\n\nc</pre>d", "  a\n    b\n\nc\n\nd"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
        ("x </b></p> y <li>z", "x\n\ny\n- z"),
        ("<p>a  \n b<span> c</span>d", "a b cd"),
        ("<table><caption>cap</caption><tr><td>1</table>", "cap\n1"),
        ("<" * 50 + "b>ok", "<" * 49 + "ok"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td colspan=2 rowspan=2>b<td>x<tr><td>c<td>y</table>", "a  b   x\nc      y"),
        ("<style>.h, p#i {display:none} b.h{display:inline} @media print{i{display:none}}</style><p class='k h'>no</p><p id=i>no</p><b class=h>yes</b> <i>too</i>", "yes too"),
        ("<style>/* .h{} */ .v{visibility:hidden}</style><div class=v>no <b style='visibility:visible'>yes</b> no</div>end", "yes\nend"),
        ("<details><summary>s</summary>body</details><details open><summary>t</summary>body</details>", "s\nt\nbody"),
        ("<textarea>a\n  b</textarea>", "a\n  b"),
        ("a</i></b></table></p>b", "a\n\nb"),
    ],
)
def test_pages(page, want):
    assert html.render(page) == want


def test_pages_of_any_depth(spark):
    assert html.render("<div>" * 30_000 + "deep") == "deep"
    df = spark.createDataFrame([(1, "<p>a"), (None, None), (1, "<p>a")], "page_id long, html string")
    assert sorted(map(tuple, html.texts(df).collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]


def call(i, **args):
    return {"id": i, "name": "add", "arguments": args}


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 8000 + "<li>x</li>" * 8000, "<div><li>" * 8000, "<b>" * 8000 + "</i>" * 8000, "<table>" * 8000 + "</b>" * 8000,
        "<table><tr><td>" * 3000, "<p><i>" * 8000, "<ul><li>" * 8000,
    ],
)
def test_rendering_is_linear(page):
    import time

    builder, began = html.Builder(), time.process_time()
    builder.feed(page)
    assert time.process_time() - began < 5  # seconds; comparing each tag with all open ones took 25


def test_chat(spark):
    schemas = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
    data = [
        (1, 0, "user", "hi \n \"there\""),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("x", a=1.0), call("y", a=-1, b=2)], "content": "c"})),
        (1, 1, "tool", json.dumps({"tool_call_id": "y", "content": {"z": 1, "a": [2.50]}})),
        (1, 4, "tool", json.dumps({"tool_call_id": "x", "content": None})),
        (1, 5, "tool", json.dumps({"tool_call_id": "gone", "content": 1})),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": None, "name": "nope", "arguments": "{bad"}]})),
        (2, 1, "tool", "not json"),
        (2, 1, "tool", "not json"),
        (None, None, None, None),
        (2, None, "user", '{"tool_calls": 3}'),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {}
    for r in chat.format(df, schemas).collect():
        got.setdefault(r["conv_id"], []).append((r["position"], r["turn"], r["n_calls"], r["n_problems"], r["line"]))
    assert {k: [x[0] for x in sorted(v)] for k, v in got.items()} == {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3], None: [0]}
    first = sorted(got[1])
    assert [x[1] for x in first] == [0, 3, 1, 4, 5] and [x[2:4] for x in first] == [(0, 0), (2, 2), (0, 0), (0, 0), (0, 1)]
    assert first[1][4] == (
        '{"content":"c","conversation":1,"role":"assistant","tool_calls":[{"arguments":{"a":1},"id":"x","name":"add","valid":true},'
        '{"arguments":{"a":-1,"b":2},"id":"y","name":"add","valid":false}],"turn":3}'
    )
    assert first[2][4] == '{"content":{"a":[2.5],"z":1},"conversation":1,"linked":true,"role":"tool","tool_call_id":"y","turn":1}'
    assert [x[2:4] for x in sorted(got[2])] == [(0, 0), (1, 1), (0, 0), (0, 0)]
    assert chat.format(df.limit(0)).count() == 0


def test_chat_orders_chains_and_circles(spark):
    """Random chains of calls against a plain version of Kahn's rounds; a circle stays at its turns."""
    rng = random.Random(5)
    data, follows = [], {}
    for i in range(30):  # turn i asks, turn 100 + i answers, in a mixed order
        after = [f"t{j}" for j in rng.sample(range(30), rng.randint(0, 2)) if j < i or rng.random() < 0.0]
        turn = rng.randint(0, 40)
        data.append((1, turn, "assistant", json.dumps({"tool_calls": [{"id": f"t{i}", "name": "f", "arguments": {}, "after": after}], "content": i})))
        data.append((1, rng.randint(0, 40), "tool", json.dumps({"tool_call_id": f"t{i}", "content": i})))
        follows["a", i] = {(kind, int(a[1:])) for a in after for kind in "ar"}
        follows["r", i] = {("a", i)}
    turns = {("ar"[k % 2], k // 2): row[1] for k, row in enumerate(data)}
    place = {}
    while len(place) < len(turns):
        for node in [n for n in turns if n not in place and follows[n] <= place.keys()]:
            last = max((place[x] for x in follows[node]), default=None)
            place[node] = (turns[node], 0) if last is None or turns[node] > last[0] else (last[0], last[1] + 1)
    data += [(2, 5, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "f", "after": ["q"]}]})), (2, 1, "assistant", json.dumps({"tool_calls": [{"id": "q", "name": "f", "after": ["p"]}]}))]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = sorted(chat.format(df, {"f": {}}).collect(), key=lambda r: (r["conv_id"], r["position"]))
    lines = [json.loads(r["line"]) for r in got if r["conv_id"] == 1]
    order = [("a" if x["role"] == "assistant" else "r", x["content"]) for x in lines]
    assert [place[n] for n in order] == sorted(place.values()) and all(x.get("linked", True) for x in lines)
    assert all(order.index(x) < order.index(n) for n in order for x in follows[n])
    assert [(r["turn"], r["n_problems"]) for r in got if r["conv_id"] == 2] == [(1, 1), (5, 1)]


def test_chat_survives_odd_json(spark):
    deep = "[" * 3000 + "]" * 3000
    data = [
        (0, "assistant", '{"tool_calls": [{"id": "a", "name": "f", "arguments": %s}]}' % deep),
        (1, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "f", "arguments": deep}]})),
        (2, "assistant", json.dumps({"tool_calls": [{"id": ["c"], "name": ["f"]}, {"id": "d", "name": "f", "arguments": {"n": 1}}]}).replace("1}", "1e999}")),
        (3, "tool", '{"tool_call_id": "\\ud800", "content": "\\udfff"}'),
        (4, "assistant", '{"tool_calls": [{"id": "\\ud800", "name": "\\ud800"}]}'),
        (5, "assistant", '{"tool_calls": 5}'),
        (6, "assistant", '{"tool_calls": [7, null]}'),
    ]
    df = spark.createDataFrame([(str(7), *x, 1) for x in data], "conv_id string, turn int, role string, text string, mid int").selectExpr("cast(conv_id as decimal(10,2)) conv_id", "turn", "role", "text", "mid", "turn after")
    got = {r["turn"]: r for r in chat.format(df, {"f": {"properties": {"n": {"type": "integer"}}}}).collect()}
    assert [got[i]["n_calls"] for i in range(7)] == [0, 1, 2, 0, 1, 0, 0]
    assert [got[i]["n_problems"] for i in range(7)] == [0, 0, 2, 0, 1, 0, 0]
    assert json.loads(got[2]["line"])["tool_calls"][1]["arguments"] == {"n": None} and json.loads(got[3]["line"])["linked"]
    assert got[0]["line"].startswith('{"content":"{') and json.loads(got[0]["line"])["conversation"] == "7.00"


@pytest.mark.parametrize(
    "schema,good,bad",
    [
        ({"enum": [1, "a", None]}, [1, 1.0, "a", None], [True, "1", 2]),
        ({"const": {"a": [1]}}, [{"a": [1.0]}], [{"a": [True]}, {"a": []}]),
        ({"type": "integer"}, [3, 3.0], [3.5, float("inf"), True, "3"]),
        ({"type": ["string", "null"], "pattern": "^a+$"}, ["aa", None], ["b", 1]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 6], [4]),
        ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 4], [2]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}], "not": {"const": 2}}, [1, 3], [0, 2, 4]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 2, "multipleOf": 0.1}, [1.1, 1.9], [1, 2, 1.55]),
        ({"uniqueItems": True, "items": {"$ref": "#/$defs/n"}, "$defs": {"n": {"type": "number"}}, "maxItems": 3}, [[1, 2]], [[1, 1.0], ["a"], [1, 2, 3, 4]]),
        ({"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": {"type": "number"}, "maxProperties": 2}, [{"x1": "a", "y": 2}], [{"x": 1}, {"y": "a"}, {"a": 1, "b": 2, "c": 3}]),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"minProperties": 1}}, [{"a": 1, "b": 2}, {"c": 1}], [{"a": 1}, {}]),
        ({"propertyNames": {"maxLength": 2}, "properties": {"l": {"contains": {"const": 1}, "prefixItems": [{"type": "string"}]}}}, [{"l": ["a", 1]}], [{"l": [1]}, {"l": ["a"]}, {"long": 1}]),
        ({"$ref": "#"}, [], [1]),
        (True, [1], []),
    ],
)
def test_schemas(schema, good, bad):
    chat.checked(schema, "s")
    assert [x for x in good if chat.problems(x, schema)] == [] and [x for x in bad if not chat.problems(x, schema)] == []


def test_unknown_keywords_are_refused(spark):
    with pytest.raises(ValueError):
        chat.format(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), {"f": {"properties": {"a": {"minimun": 3}}}})
