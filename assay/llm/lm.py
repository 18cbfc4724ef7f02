"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

p(w | h) = a2 c(h,w)/c(h) + a1 c(w)/N + a0 1/(V+1), with weights a by the bucket (power of two) of
c(h). The weights are learned by expectation-maximisation: a slice of the learning documents is
taken out ("deleted"), the estimates come from the others, and the slice's tokens are the
held-out counts. EM reads them as a histogram over (bucket, log-ratios of the estimates in steps of
1/STEPS octave), whose size is bounded by its axes, not by the corpus. The scoring model counts all learning
documents.

Counting: a scan numbers the tokens and bigrams of each block of documents and sends their
distinct hashes (64 bits) with counts to hash buckets, packed (sorted, differences, zstd); a bucket
adds them up and answers each block with the totals of the block's own keys. So a bigram that is
everywhere is one entry a block. A second scan sends, for each token, its number and its bigram's to
meet the answers: scanning twice is cheaper than writing them down between. The texts go no further.

Tokens: words between ASCII white space with A-Z in lower case, then one end token a text, which is
also the context of the first word.

Defined results: a null text is empty (the end token alone); a null id counts as remainder -1: it is
learned from; repeated rows are learned from and scored each; with nothing to learn from, N and V
are 0 and every token gets the uniform estimate 1/(V+1) = 1, so that scores are 0; a very long text
is a block of its own and takes memory for its tokens; words are bytes, so text that is not valid
UTF-8 is scored as it stands; ids may be of any type; an empty table gives an empty table; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.blocks import answered, cut_tables, distinct, fixed, gathered, join_parts, pack_table, places, row_sums, split_parts, split_words, spread_again, stable, unpack_table, unzip_bytes, unzip_ints, word_hashes, zip_bytes, zip_ints
from assay.llm.common import mix64, named, staged
from assay.sources.staging import release

BLOCK_BYTES = 8 << 20
CONTEXTS, STEPS, SPAN = 40, 4, 120
EM_ROUNDS = 60


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, the end first; token numbers of all texts, each with its end; tokens of each text)."""
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    hashes = np.concatenate([word_hashes(pa.array([b"\n"])), word_hashes(coded.dictionary)])
    ends = np.cumsum(counts)
    return hashes, np.insert(coded.indices.to_numpy().astype(np.int32) + 1, ends, 0), counts + 1


def _pairs(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hash of each position's (previous token, token)."""
    left = mix64(hashes)[np.concatenate([np.zeros(1, np.int32), ids[:-1]])]
    return mix64(left + hashes[ids])


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n bucket's keys begin in the sorted keys, and the end."""
    edges = np.array([((i << 64) + n - 1) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _squeeze(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte position, so that zero bytes lie together."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _send(fields: list[str], wanted: str):
    """What a block sends: its key lists, or its pieces."""

    def send(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
        for block, table in enumerate(cut_tables(batches, BLOCK_BYTES)):
            hashes, ids, counts = _tokens(table.column("text").combine_chunks())
            learn = np.repeat(table.column("learn").to_numpy().astype(bool), counts)
            tune = bool(table.column("tune")[0].as_py())
            lists, places_ = [], []
            words, rank = distinct(hashes)
            pairs, pair = distinct(_pairs(hashes, ids))
            for keys, at in ((words, rank[ids]), (pairs, pair)):
                if wanted == "lists":
                    lists.append((keys, np.bincount(at[learn], minlength=len(keys)).astype(np.uint32), _cuts(keys, n)))
                else:
                    places_.append(zip_ints(at))
            for bucket in range(n) if lists else ():
                body = [np.uint32([tune, *(c[bucket + 1] - c[bucket] for _, _, c in lists)]).tobytes()]
                for keys, own, c in lists:
                    body += [_squeeze(keys[c[bucket] : c[bucket + 1]]), own[c[bucket] : c[bucket + 1]].tobytes()]
                if len(body[1]) or len(body[3]):
                    yield block, bucket, zip_bytes(b"".join(body))
            if lists:
                continue
            head = np.array([tune, rank[0], len(words), len(pairs), len(ids)], np.int64).tobytes()
            yield block, n, join_parts([head, pack_table(table.select(fields)), zip_ints(counts), *places_])

    return send


def _total(lists: list[bytes]) -> Iterator[bytes]:
    """For each list the totals of its keys; each answer also starts with the bucket's sums.

    Sums (each in one answer alone): tokens and distinct tokens in learning, the same without the
    deleted slice.
    """
    parsed = []
    for body in lists:
        raw = unzip_bytes(body)
        tune, *sizes = np.frombuffer(raw, np.uint32, 3).tolist()
        at, kinds = 12, []
        for size in sizes:
            kinds.append((_unsqueeze(raw[at : at + 8 * size]) if size else np.zeros(0, np.uint64), np.frombuffer(raw, np.uint32, size, at + 8 * size)))
            at += 12 * size
        parsed.append((tune, kinds))
    answers, sums = [[] for _ in parsed], [0, 0, 0, 0]
    for kind in (0, 1):
        keys = np.unique(np.concatenate([k[kind][0] for _, k in parsed]))
        fit, held = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        where = [np.searchsorted(keys, k[kind][0]) for _, k in parsed]
        for (tune, k), at in zip(parsed, where, strict=True):
            (held if tune else fit)[at] += k[kind][1]
        if not kind:
            sums = [int((fit + held).sum()), int((fit + held > 0).sum()), int(fit.sum()), int((fit > 0).sum())]
        for (tune, _), at, out in zip(parsed, where, answers, strict=True):
            out.append((fit + held)[at].astype(np.uint64))
            if tune:
                out.append(fit[at].astype(np.uint64))
    for i, out in enumerate(answers):
        head = np.array(sums if not i else [0, 0, 0, 0], np.int64)
        yield head.tobytes() + np.array([len(k) for k, _ in parsed[i][1]], np.int64).tobytes() + _zip_counts(np.concatenate(out))


def _zip_counts(x: np.ndarray) -> bytes:
    """Counts as packed numbers, in two halves where 32 bits don't hold them."""
    return join_parts([zip_ints(x & np.uint64(0xFFFFFFFF)), zip_ints(x >> np.uint64(32))])


def _unzip_counts(data: bytes) -> np.ndarray:
    low, high = split_parts(data)
    return unzip_ints(low).astype(np.int64) | (unzip_ints(high).astype(np.int64) << 32)


def _totals(answer: dict[int, bytes], body: bytes, fit: bool) -> tuple[pa.Table, tuple[np.ndarray, ...]]:
    """(kept columns; for each position: count of the token, of its context and of the pair; tokens of each text)."""
    head, table, counts, word_at, pair_at = split_parts(body)
    tune, end, *sizes, _ = np.frombuffer(head, np.int64).tolist()
    total: list[list[np.ndarray]] = [[], []]
    for slot in sorted(answer):
        raw = answer.pop(slot)
        own, got, at = np.frombuffer(raw, np.int64, 2, 32), _unzip_counts(raw[48:]), 0
        for k, size in enumerate(own.tolist()):
            take = at + size * (tune and fit)
            total[k].append(got[take : take + size])
            at += size * (1 + tune)
    words, pairs = (np.concatenate(t or [np.zeros(0, np.int64)]) for t in total)
    word = words[unzip_ints(word_at)]
    return unpack_table(table), (word, np.concatenate([words[end : end + 1], word[:-1]]), pairs[unzip_ints(pair_at)], unzip_ints(counts).astype(np.int64))


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), CONTEXTS - 1).astype(np.int64)


def _step(ratio: np.ndarray) -> np.ndarray:
    """Histogram cell of a ratio; 0 for none."""
    return np.where(ratio > 0, np.clip(np.round(np.log2(np.maximum(ratio, 1e-300)) * STEPS) + SPAN + 1, 1, 3 * SPAN), 0).astype(np.int64)


def _ratio(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, np.exp2((step - SPAN - 1) / STEPS), 0.0)


def em_weights(cells: np.ndarray, times: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """CONTEXTS x 3 weights (bigram, unigram, uniform) from cells (bucket, bigram step, unigram step)."""
    weights = np.tile([0.4, 0.4, 0.2], (CONTEXTS, 1))
    if not len(cells):
        return weights
    b = cells[:, 0]
    p = np.stack([_ratio(cells[:, 1]), _ratio(cells[:, 2]), np.ones(len(cells))], 1)
    seen = np.bincount(b, times, CONTEXTS)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (times / share.sum(1))[:, None]
        new = np.stack([np.bincount(b, share[:, k], CONTEXTS) for k in range(3)], 1)
        # one token's worth of the start keeps every weight above zero
        weights = (new + np.array([0.4, 0.4, 0.2])) / (seen + 1)[:, None]
    return weights


def lm_scores(docs: DataFrame, learn: Column, tune: Column, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, further columns, n_tokens, n_known, train_tokens long, base_score, score double.

    learn: whether a document is learned from; tune: whether such a one is in the deleted slice.
    base_score is the add-one unigram log10 probability, score that of the interpolated model.
    """
    more = more or {}
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in more.items()], F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(learn & tune, F.lit(False)).alias("tune"))
    n = places(rows)
    rows = fixed(stable(rows, "lm-docs"))
    fields = [f for f in rows.schema.fields if f.name not in ("text", "learn", "tune")]

    def deleted(wanted: str) -> DataFrame:
        return spread_again(rows.where("tune"), _send([f.name for f in fields], wanted), n)

    def both(wanted: str) -> DataFrame:
        """Blocks of the deleted slice, then all others, with names of their own; in this order, as tasks name them by number."""
        others = spread_again(rows.where("not tune"), _send([f.name for f in fields], wanted), n)
        return deleted(wanted).unionByName(others.withColumn("block", -F.col("block") - 1))

    answers = staged(answered(both("lists"), _total, n), "lm-answers", packed=True)
    release(docs.sparkSession, [])  # the lists' shuffle is of no more use
    sums = np.zeros(4, np.int64)
    for r in answers.select(F.substring("body", 1, 32).alias("head")).where(F.col("head") != F.lit(bytes(32))).collect():  # a row for each bucket
        sums += np.frombuffer(r.head, np.int64)
    n_all, v_all, n_fit, v_fit = sums.tolist()

    def held_out(block: int, answer: dict[int, bytes], pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for _, body in pieces:
            _, (word, context, pair, _) = _totals(answer, body, fit=True)
            two = _step(pair / np.maximum(context, 1) * (v_fit + 1))
            one = _step(word / max(n_fit, 1) * (v_fit + 1))
            side = 3 * SPAN + 1
            cell, times = np.unique((_bucket(context) * side + two) * side + one, return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "times": pa.array(times)})

    cells = gathered(deleted("pieces"), answers.where("block >= 0"), held_out, "cell bigint, times bigint", n).groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    side = 3 * SPAN + 1
    cell, times = cells.column("cell").to_numpy(), cells.column("times").to_numpy().astype(float)
    weights = em_weights(np.stack([cell // side**2, cell // side % side, cell % side], 1), times)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(block: int, answer: dict[int, bytes], pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for _, body in pieces:
            table, (word, context, pair, counts) = _totals(answer, body, fit=False)
            w = weights[_bucket(context)]
            p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(n_all, 1)) + w[:, 2] / (v_all + 1)
            lone = context == 0  # an unseen context has no bigram estimate: its weight goes to the others
            p[lone] /= np.maximum(w[lone, 1] * (n_all > 0) + w[lone, 2], 1e-12)
            at = np.cumsum(counts) - counts
            add = lambda x: np.add.reduceat(x, at)
            yield pa.RecordBatch.from_pydict(
                {f.name: table.column(f.name).combine_chunks() for f in fields}
                | {
                    "n_tokens": pa.array(counts),
                    "n_known": pa.array(row_sums((word > 0).astype(np.int64), counts)),
                    "train_tokens": pa.array(np.full(len(counts), n_all, np.int64)),
                    "base_score": pa.array(add(np.log10(word + 1.0)) - counts * np.log10(n_all + v_all + 1.0)),
                    "score": pa.array(add(np.log10(p))),
                }
            )

    return named(gathered(both("pieces"), answers, score, schema, n), "id", id_col)
