"""The registered queries of this subpackage: thin derivations from its operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, digest, html, langid, shards, simhash, suffix, tokens
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_successor(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, sf_dir, "documents"), width=3)
    return simhash.cluster(prints, radius=2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


LOOKUP = {
    "lookup": {
        "type": "object", "required": ["query", "turn"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 5}},
    }
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """Every row of conversations, and for each of an assistant a result, by a fixed rule: the row's message
    becomes one that calls `lookup` with its text and turn, under the id t<turn>, and the result (the text's
    length) stands one turn before it, so that linking has to put it behind its call."""
    name = F.concat(F.lit("t"), F.col("turn"))
    call = F.to_json(F.struct(F.col("text").alias("content"), F.array(F.struct(name.alias("id"), F.lit("lookup").alias("name"), F.struct(F.col("text").alias("query"), "turn").alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name.alias("tool_call_id"), F.struct(F.length("text").alias("length")).alias("content")))
    asks = F.col("role") == "assistant"
    rows = conversations.select("conv_id", "turn", "role", F.when(asks, call).otherwise(F.col("text")).alias("text"))
    return rows.unionByName(conversations.where(asks).select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("tool").alias("role"), result.alias("text")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format(with_calls(table(spark, sf_dir, "conversations")), LOOKUP)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.texts(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), shards=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_decontamination": op3_decontamination,
    "op4_fingerprint": op4_fingerprint,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html": op8_html,
    "op9_token_ids": op9_token_ids,
    "op10_shards": op10_shards,
}

ORACLES: dict[str, str] = {
    # a result stands behind its call, which has the turn after it
    "op6_chat": """
        WITH m AS (
            SELECT conv_id, turn, role, text, turn AS after, 0 AS depth FROM conversations
            UNION ALL SELECT conv_id, turn - 1, 'tool', text, turn, 1 FROM conversations WHERE role = 'assistant'
        ), n AS (
            SELECT *, coalesce(to_json(text)::VARCHAR, 'null') AS body, conv_id::VARCHAR AS c, turn::VARCHAR AS t,
                   text IS NOT NULL AND length(text) > 0 AND turn BETWEEN 0 AND 5 AS valid FROM m
        )
        SELECT conv_id, turn, role,
            row_number() OVER (PARTITION BY conv_id ORDER BY after NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position,
            CASE role
                WHEN 'assistant' THEN '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || body || ',' END || '"conversation":' || c
                    || ',"role":"assistant","tool_calls":[{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"query":' || body || ',' END || '"turn":' || t
                    || '},"id":"t' || t || '","name":"lookup","valid":' || CASE WHEN valid THEN 'true' ELSE 'false' END || '}],"turn":' || t || '}'
                WHEN 'tool' THEN '{"content":{' || coalesce('"length":' || length(text), '') || '},"conversation":' || c
                    || ',"linked":true,"role":"tool","tool_call_id":"t' || after || '","turn":' || t || '}'
                ELSE '{"content":' || body || ',"conversation":' || c || ',"role":"' || role || '","turn":' || t || '}'
            END AS line,
            (role = 'assistant')::INT AS n_calls,
            CASE WHEN role <> 'assistant' THEN 0
                 ELSE (text IS NULL OR length(text) = 0)::INT + (turn NOT BETWEEN 0 AND 5)::INT END AS n_problems
        FROM n""",
    # every string of 100 bytes, and the place where it starts first
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        x AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99, 200)) AS base, h FROM d WHERE length(h) >= 200),
        g AS (SELECT doc_id, base, substr(h, 2 * base + 1, 598) AS h FROM x),
        w AS (SELECT doc_id, base, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM g),
        s AS (SELECT doc_id, base + i AS i, md5(substr(h, 2 * i + 1, 200)) AS m FROM w),
        f AS (SELECT m, min(doc_id::HUGEINT * 4294967296 + i) AS least FROM s GROUP BY m HAVING count(*) > 1),
        a AS (SELECT s.doc_id, s.i FROM s JOIN f USING (m) WHERE s.doc_id::HUGEINT * 4294967296 + s.i <> f.least),
        b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS fresh FROM a),
        c AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
        r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM c GROUP BY doc_id, run),
        p AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM (SELECT doc_id, lo, hi FROM r UNION ALL SELECT doc_id, -1, 0 FROM d)),
        e AS (SELECT d.doc_id, string_agg(substr(d.h, 2 * p.lo + 1, 2 * (coalesce(p.hi, length(d.h) // 2) - p.lo)), '' ORDER BY p.lo) AS h FROM d JOIN p USING (doc_id) GROUP BY d.doc_id),
        n AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM r GROUP BY doc_id)
        SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n.gone, 0)::BIGINT AS n_removed, coalesce(n.spans, 0)::BIGINT AS n_spans,
               sha256(unhex(e.h)) AS kept_sha256
        FROM d JOIN e USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
