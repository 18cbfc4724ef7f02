"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per language in each task (a map-side combine into BUCKETS counters
a language), adds them up per slice of the counters, and broadcasts the matrix of
log-probabilities: BUCKETS x languages, refused beyond MAX_LANGUAGES. Scoring adds the rows of
the matrix for each text's n-grams in numpy, a batch of texts at once.

N-grams: one to three lower-case letters, or a word's edge and its letters; they never cross
words. Letters are what Unicode calls so. Labels serve only in training.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text
if nothing could be learned. Rows with a null label are predicted but not learned from. Equal
likelihoods go to the label that sorts first. A null id counts as not held out. Repeated rows
count as often as they occur. An empty table gives an empty table. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.blocks import small_batches
from assay.llm.common import named

BUCKETS = 1 << 16
MAX_LANGUAGES = 1024
SLICE = 1 << 12
BATCH_BYTES = 4 << 20
ALPHA = 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to itself if a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def _grams(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n: buckets of all n-grams, and where each text's begin (and the end)."""
    joined = "\n" + "\n".join(x.lower().replace("\n", " ") for x in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    edge = np.flatnonzero(code == 10)
    c = _letters()[code]
    has = c != 0
    h1 = c * np.uint32(0x9E3779B1)
    h2 = h1[:-1] * np.uint32(0x85EBCA6B) + h1[1:] + np.uint32(0x27D4EB2F)
    h3 = h2[:-1] * np.uint32(0xC2B2AE35) + h1[2:] + np.uint32(0x165667B1)
    parts, where = [], []
    for h, keep in ((h1, has), (h2, has[:-1] | has[1:]), (h3, has[1:-1])):
        at = np.flatnonzero(keep)
        got = h[at]
        got ^= got >> np.uint32(15)
        got *= np.uint32(0x2C1B3C6D)
        parts.append(got >> np.uint32(16))
        where.append(at)
    return parts, [np.searchsorted(at, edge) for at in where]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BATCH_BYTES, with the first one's position."""
    held, size, first = [], 0, 0
    for i, x in enumerate(texts):
        held.append(x or "")
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities: a row for each bucket, the priors last)."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")

    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"the broadcast matrix is bounded at {MAX_LANGUAGES} labels")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, k in zip(texts, langs, strict=True) if k == lang]
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[-1] += len(own)
                for _, run in _runs(own):
                    for got in _grams(run)[0]:
                        total[:-1] += np.bincount(got, minlength=BUCKETS)
        for lang, total in sums.items():
            cuts = range(0, BUCKETS + 1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cuts)), pa.array(list(cuts), pa.int32()), pa.array([total[k : k + SLICE].tobytes() for k in cuts], pa.binary())], ["lang", "slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(body, np.int64) for body in rows.column("counts").to_pylist())
        return pa.table({"lang": [key[0].as_py()], "slice": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    small_batches(docs)
    form = "lang string, slice int, counts binary"
    partial = rows.mapInArrow(count, form)
    found = partial.groupBy("lang", "slice").applyInArrow(add, form).collect()  # languages x BUCKETS counters
    langs = sorted({r.lang for r in found})
    counts = np.zeros((BUCKETS + 1, len(langs)))
    for r in found:
        own = np.frombuffer(r.counts, np.int64)
        counts[r.slice : r.slice + len(own), langs.index(r.lang)] = own
    prior = counts[-1].copy()
    logs = np.log(counts + ALPHA) - np.log(counts[:-1].sum(0) + ALPHA * BUCKETS)
    logs[-1] = np.log(prior) - np.log(prior.sum()) if len(langs) else 0
    return langs, logs.astype(np.float32)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, further columns, lang_pred string, score double (its posterior probability)."""
    small_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logs.T)))
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in (more or {}).items()], F.col(text_col).alias("text"))
    kept = [f.name for f in rows.schema.fields[:-1]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, prob = np.full(len(texts), "und", object), np.zeros(len(texts))
            for first, run in _runs(texts) if names else ():
                total, seen = np.zeros((len(names), len(run))), np.zeros(len(run), np.int64)
                for got, starts in zip(*_grams(run), strict=True):
                    seen += np.diff(starts)
                    full = np.flatnonzero(np.diff(starts))
                    for k in range(len(names)) if len(full) else ():
                        total[k, full] += np.add.reduceat(table[k][got], starts[full], dtype=np.float64)
                total += table[:, -1:]
                best = total.argmax(0)
                p = 1 / np.exp(total - total.max(0)).sum(0)
                at = np.flatnonzero(seen)
                lang[first + at], prob[first + at] = np.array(names, object)[best[at]], p[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(lang, pa.string()), pa.array(prob)], names=[*kept, "lang_pred", "score"])

    return named(rows.mapInArrow(score, schema), "id", id_col)
