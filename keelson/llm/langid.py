"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Lower-cased code points give n-grams of 1 to 3 (a space stands at both ends of a text), each hashed
into one of 2**16 buckets. Training counts n-grams for each language on the executors; the matrix of
smoothed log probabilities (buckets x languages) is small and goes to all tasks, where whole texts
are scored in batches with numpy.

At most PER_LANGUAGE texts a language (in expectation; chosen by a hash of the id) are learned
from: that bound is the documented parameter per_language. Everything else covers all rows.

A filter keeps what a learned language explains better than no language at all, which would give each
bucket the same chance: the mean log probability of a text's n-grams is compared with that, over the
whole text or over its letters alone (so that numbers don't count against a text). A posterior can't
say so, since it only compares the languages with one another.

Edge cases: text that is null or has no letter is `und` with score 0; with nothing to learn from
every text is `und`; a null id is held out (it has no remainder); ties go to the language that
comes first by name; repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, arrow_schema, slices

BITS = 16
ORDERS = 3
PER_LANGUAGE = 4000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd constants, one for each order


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of all texts, text by text, and where each text starts."""
    coded = [f" {t.lower()} ".encode("utf-32-le") for t in texts]
    lengths = np.array([len(c) // 4 for c in coded])
    ends = np.cumsum(lengths)
    points = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.uint64)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # code points from here to the end of the text
    out = np.full((len(points), ORDERS), 1 << BITS, dtype=np.int32)  # the bucket past the last counts for nothing
    gram = np.zeros(len(points), np.uint64)
    for n in range(ORDERS):
        m = len(points) - n
        if m <= 0:
            break
        gram = gram[:m] * np.uint64(0x100000001B3) + points[n:]
        hashed = (gram * np.uint64(MULTIPLIERS[n])) >> np.uint64(64 - BITS)
        out[:m, n] = np.where(left[:m] > n, hashed.astype(np.int32), 1 << BITS)
    return out.ravel(), (ends - lengths) * ORDERS


def batches_of(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with a bounded number of code points (or one long text)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Model:
    """languages by name and a matrix of log probabilities, float32, buckets + 1 by language."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        logs = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if languages else np.zeros(counts.shape)
        self.logs = np.ascontiguousarray(np.vstack([logs, np.zeros((1, len(languages)))]).T.astype(np.float32))
        self.prior = np.log(np.maximum(documents, 1) / max(documents.sum(), 1))

    def joint(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text under each language, and its number of n-grams."""
        buckets, starts = features(texts)
        return np.stack([np.add.reduceat(row[buckets], starts, dtype=np.float64) for row in self.logs], axis=1), np.add.reduceat(buckets < 1 << BITS, starts, dtype=np.int64)

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability."""
        names, scores = [], []
        for lo, hi in batches_of(texts):
            joint = self.joint(texts[lo:hi])[0] + self.prior
            best = joint.argmax(axis=1)
            share = 1 / np.exp(joint - joint[np.arange(len(best)), best][:, None]).sum(axis=1)
            names += [self.languages[b] for b in best]
            scores += share.tolist()
        return names, scores

    def fits(self, texts: list[str]) -> list[bool]:
        """Whether some language explains a text better than equal chances of all buckets."""
        out: list[bool] = []
        for lo, hi in batches_of(texts):
            joint, n = self.joint(texts[lo:hi])
            out += (joint.max(axis=1) >= -n * BITS * np.log(2)).tolist()
        return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    rows = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r["n"] for r in rows.groupBy(F.col(lang_col)).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    rate = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col(lang_col))
    chosen = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < rate * (1 << 20))
    number = {k: i for i, k in enumerate(languages)}
    schema = "lang int, bucket int, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for big in batches:
            for batch in slices(big):
                by: dict[int, list[str]] = {}
                for lang, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    if has_letter(text):
                        by.setdefault(number[lang], []).append(text)
                for k, texts in by.items():
                    sums = total.setdefault(k, np.zeros((1 << BITS) + 1, np.int64))
                    for lo, hi in batches_of(texts):
                        sums += np.bincount(features(texts[lo:hi])[0], minlength=len(sums))
        for k, sums in total.items():
            seen = np.flatnonzero(sums[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k), pa.int32()), pa.array(seen, pa.int32()), pa.array(sums[seen])], schema=arrow_schema(schema))

    counts = np.zeros((1 << BITS, len(languages)))
    grams = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, schema)
    found = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets x languages rows at most
    counts[found["bucket"].to_numpy(int), found["lang"].to_numpy(int)] = found["n"].to_numpy()
    return Model(languages, counts, np.array([sizes[k] for k in languages], float))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; no shuffle."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = shared.value, Rows(schema)
        for big in batches:
            for batch in slices(big):
                texts = batch[2].to_pylist()
                known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                for i, name, score in zip(known, *model.score([texts[i] for i in known]), strict=True):
                    names[i], scores[i] = name, score
                for row in zip(batch[0].to_pylist(), batch[1].to_pylist(), names, scores, strict=True):
                    out.add(*row)
                if out.full():
                    yield out.take()
        yield from out.rest()

    return df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df without the rows whose text is in no learned language: `und`, or one that fits none."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for big in batches:
            for batch in slices(big):
                texts = batch[at].to_pylist()
                known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
                keep = model.fits([texts[i] for i in known])
                left = [i for i, fits in zip(known, keep, strict=True) if not fits]
                letters = model.fits([" ".join(LETTERS.findall(texts[i])) for i in left])
                gone = {i for i, fits in zip(left, letters, strict=True) if not fits}
                yield batch.take(pa.array([i for i in known if i not in gone], pa.int64()))

    return df.mapInArrow(run, df.schema)
