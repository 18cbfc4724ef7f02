"""Quality rules: counts within a text, and in how many documents of its host its lines occur.

Lines are normalised (lower case, digits as 0, white space as one space) and hashed together with
the host. One scan makes all counts. Each block of documents sends, for each of its line hashes,
the ids of the documents that hold the line, but at most max_docs + 1 of them: more prove nothing
further, so the decision stays exact while a line that a third of all documents share stays a short
entry a block. A line that more than max_docs documents of a host hold is removed wherever it
stands. A document that is left with less than min_left of its words is depleted and rejected.

Two choices are off unless asked for. count_texts counts distinct texts in place of documents, so that
copies count once and are left to a step that looks for copies. keep_first leaves a line in the
document with the smallest id that holds it.

Defined results: a null text has no words and fails; a text without line breaks is one line,
however long it is, and a very long text takes memory for itself and its words; bytes that are not
valid UTF-8 are read as Spark's make_valid_utf8 gives them; a null host is a host of its own; rows
that repeat a doc_id count as one document and each get a row; ids that are no integers are told
apart by a 64-bit hash; documents with a null id are judged but not counted, and are never the
first holder (among several rows with the smallest id all keep the line); an empty table gives an
empty table; columns of any name pass through (keep).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.blocks import answered, cut_tables, distinct, gathered, join_parts, pack_table, places, row_sums, split_parts, split_words, spread, unpack_table, unzip_bytes, unzip_ints, zip_bytes, zip_ints
from assay.llm.common import mix64

SYMBOLS = "[#*$%&|<>]"
NEVER = (1 << 63) - 1
MAX_DOCS, MIN_LEFT = 50, 0.5
MAX_LINES = 400_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(word: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word: whether it is inside a three-word window that its text holds twice or more."""
    covered = np.zeros(len(word), bool)
    if len(word) < 3:
        return covered
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    width = np.int64(word.max()) + 1
    _, pair = distinct(word[:-1].astype(np.int64) * width + word[1:])
    _, gram = distinct(pair[inside].astype(np.int64) * width + word[inside + 2])
    _, own = distinct(gram.astype(np.int64) * (np.int64(owner[-1]) + 1) + owner[inside])
    twice = inside[np.bincount(own)[own] > 1] if len(own) else inside
    for k in range(3):
        covered[twice + k] = True
    return covered


def normalised(lines: pa.Array) -> pa.Array:
    """Lower case, each run of digits as 0, each run of white space as one space, none at the ends."""
    plain = pc.replace_substring_regex(pc.utf8_lower(lines), "[0-9]+", "0")
    return pc.utf8_trim(pc.replace_substring_regex(plain, r"[\x20\x09-\x0D]+", " "), " ")


def counts_of(texts: pa.Array, hosts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(STATS of each text; lines in each text; words in each line; hash of each line with its host)."""
    lists = pc.split_pattern(texts, "\n")
    lines, edges = lists.values, lists.offsets.to_numpy().astype(np.int64)
    lines, edges = lines.slice(int(edges[0]), int(edges[-1] - edges[0])), edges - edges[0]
    per_text = np.diff(edges)
    words, per_line = split_words(lines)
    n_words = row_sums(per_line, per_text)
    owner = np.repeat(np.arange(len(texts)), n_words)
    own_line = np.repeat(np.arange(len(texts)), per_text)

    with_word = per_line > 0
    coded = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first = np.unique(coded * len(texts) + own_line, return_index=True)
    fresh = np.zeros(len(lines), np.int64)
    fresh[first] = 1
    chars = pc.utf8_length(words).to_numpy().astype(np.int64)
    again = repeated_words(words.dictionary_encode().indices.to_numpy(), owner) if len(words) else np.zeros(0, bool)
    stats = {
        "n_words": n_words,
        "word_chars": row_sums(chars, n_words),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64),
        "n_dup_lines": row_sums((with_word & (fresh == 0)).astype(np.int64), per_text),
        "n_repeat_words": row_sums(again.astype(np.int64), n_words),
    }
    host = hosts.dictionary_encode()
    marks = np.array([*(xxhash.xxh3_64_intdigest(x) for x in host.dictionary.to_pylist()), 1], np.uint64)
    mark = marks[pc.fill_null(host.indices, len(marks) - 1).to_numpy()]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, normalised(lines).to_pylist()), np.uint64, len(lines))
    with np.errstate(over="ignore"):
        return stats, per_text, per_line, mix64(hashes + mix64(mark)[own_line])


class Holders:
    """Lines of a block, and the documents that hold each of them: at most max_docs + 1."""

    def __init__(self, max_docs: int):
        self.max_docs = max_docs
        self.number: dict[int, int] = {}
        self.key: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.rows = 0

    def add(self, hashes: np.ndarray, doc: np.ndarray, counted: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Numbers of the lines."""
        keys, at = distinct(hashes)
        number = np.fromiter((self.number.setdefault(k, len(self.number)) for k in keys.tolist()), np.int64, len(keys))[at]
        self.key.append(number[counted])
        self.doc.append(doc[counted])
        first = np.full(len(keys), NEVER, np.int64)
        np.minimum.at(first, at, rank)
        self.first.append(np.stack([number[np.unique(at, return_index=True)[1]], first]))
        self.rows += len(number)
        if self.rows > 2 * MAX_LINES:
            self.shrink()
        return number

    def shrink(self) -> None:
        """Each line's distinct documents, and of a line above the limit only max_docs + 1."""
        key, doc = np.concatenate(self.key), np.concatenate(self.doc)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place <= self.max_docs
        self.key, self.doc = [key[keep]], [doc[keep]]
        first = np.concatenate(self.first, axis=1)
        least = np.full(len(self.number), NEVER, np.int64)
        np.minimum.at(least, first[0], first[1])
        self.first = [np.stack([np.arange(len(least)), least])]
        self.rows = len(key) // 2

    def lists(self, n: int) -> Iterator[tuple[int, bytes]]:
        """Packed for each bucket; slot n: the number of each line in the order sent."""
        self.shrink()
        (key,), (doc,), (first,) = self.key, self.doc, self.first
        hashes = np.fromiter(self.number, np.uint64, len(self.number))
        home = (hashes % np.uint64(n)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        size = np.bincount(key, minlength=len(hashes))
        size_sent = np.where(size > self.max_docs, 0, size)  # a line that is above the limit by itself needs no documents
        starts = np.searchsorted(key, np.arange(len(hashes)))
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            at = order[a:b]
            docs = np.concatenate([doc[starts[k] : starts[k] + size_sent[k]] for k in at.tolist()])
            yield int(home[at[0]]), join_parts([hashes[at].tobytes(), zip_ints(size[at]), first[1][at].tobytes(), docs.tobytes()])
        yield n, zip_ints(order)


def _line_answers(max_docs: int):
    """For each list: a byte for each key (1: over the limit), and the first holders of all."""

    def resolve(lists: list[bytes]) -> Iterator[bytes]:
        parsed = []
        for body in lists:
            hashes, size, first, docs = split_parts(body)
            parsed.append((np.frombuffer(hashes, np.uint64), unzip_ints(size).astype(np.int64), np.frombuffer(first, np.int64), np.frombuffer(docs, np.int64)))
        keys, at = distinct(np.concatenate([p[0] for p in parsed]))
        size = np.concatenate([p[1] for p in parsed])
        least = np.full(len(keys), NEVER, np.int64)
        np.minimum.at(least, at, np.concatenate([p[2] for p in parsed]))
        over = np.zeros(len(keys), bool)
        over[at[size > max_docs]] = True
        key = np.repeat(at, np.where(size > max_docs, 0, size))
        doc = np.concatenate([p[3] for p in parsed])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        over |= np.bincount(key[new], minlength=len(keys)) > max_docs
        done = 0
        for own, *_ in parsed:
            k = at[done : done + len(own)]
            done += len(own)
            yield join_parts([zip_bytes(over[k].tobytes()), zip_bytes(least[k][over[k]].tobytes())])

    return resolve


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
    keep: list[str] | None = None,
    with_text: bool = True,
    count_texts: bool = False,
    keep_first: bool = False,
    into: str = "rules",
) -> DataFrame:
    """Per row of docs: the columns of keep (the id, if not given), and under one struct (`into`):

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines,
    n_words_left, kept, and (with_text) text: the lines that stay.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c != text_col]
    rank = F.col(f"`{id_col}`").cast("bigint") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.xxhash64(F.col(f"`{id_col}`"))
    rows = docs.select(
        F.when(F.col(f"`{id_col}`").isNotNull(), rank).alias("rank"),
        F.make_valid_utf8(F.col(f"`{text_col}`")).alias("text"),
        F.col(f"`{host_col}`").cast("string").alias("host"),
        *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)],
    )
    n = places(rows)
    fields = [(f"keep{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    plain = [*STATS, "n_removed_lines", "n_words_left"]
    schema = T.StructType([T.StructField(k, t) for k, t in fields] + [T.StructField(k, T.LongType()) for k in plain] + [T.StructField(k, T.BooleanType()) for k in ("base_failed", "kept_doc")] + [T.StructField("text", T.StringType())] * with_text)

    def send(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
        held, block, piece = Holders(max_docs), 0, n
        for table in cut_tables(batches):
            texts = pc.fill_null(table.column("text").combine_chunks(), "")
            stats, per_text, per_line, hashes = counts_of(texts, table.column("host").combine_chunks())
            ranks = table.column("rank").combine_chunks()
            known, ranks = pc.is_valid(ranks).to_numpy(zero_copy_only=False), pc.fill_null(ranks, NEVER).to_numpy()
            doc = ranks
            if count_texts:
                doc, known = np.fromiter(map(xxhash.xxh3_64_intdigest, texts.to_pylist()), np.uint64, len(texts)).view(np.int64), np.ones(len(texts), bool)
            line = np.flatnonzero(per_line)
            owner = np.repeat(np.arange(len(texts)), per_text)[line]
            number = np.zeros(len(per_line), np.int64)
            number[line] = held.add(hashes[line], doc[owner], known[owner], ranks[owner]) + 1
            piece += 1
            wanted = [k for k, _ in fields] + ["rank"] * keep_first + ["text"] * with_text
            parts = [pack_table(table.select(wanted)), *(zip_ints(stats[k]) for k in STATS), zip_ints(per_text), zip_ints(per_line), zip_ints(number)]
            yield block, piece, join_parts(parts)
            if len(held.number) >= MAX_LINES:
                yield from ((block, slot, body) for slot, body in held.lists(n))
                held, block, piece = Holders(max_docs), block + 1, n
        if held.number:
            yield from ((block, slot, body) for slot, body in held.lists(n))

    def apply(block: int, answer: dict[int, bytes], pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        over, first = np.zeros(1, bool), np.full(1, NEVER, np.int64)
        for slot, body in pieces:
            if slot == n:
                order = unzip_ints(body).astype(np.int64)
                got = [split_parts(answer[s]) for s in sorted(answer)]
                over, first = np.zeros(len(order) + 1, bool), np.full(len(order) + 1, NEVER, np.int64)
                yes = np.concatenate([np.frombuffer(unzip_bytes(x), bool) for x, _ in got])
                over[order + 1] = yes
                first[order[yes] + 1] = np.concatenate([np.frombuffer(unzip_bytes(x), np.int64) for _, x in got])
                continue
            table, *parts = split_parts(body)
            table = unpack_table(table)
            *stats, per_text, per_line, number = (unzip_ints(x).astype(np.int64) for x in parts)
            yield from batches(table, dict(zip(STATS, stats, strict=True)), per_text, per_line, number, over, first)

    def batches(table, out, per_text, per_line, number, over, first) -> Iterator[pa.RecordBatch]:
        gone = over[number]
        if keep_first:
            ranks = pc.fill_null(table.column("rank").combine_chunks(), NEVER).to_numpy()
            own = np.repeat(ranks, per_text)
            gone &= (first[number] != own) | (own == NEVER)
        out["n_removed_lines"] = row_sums(gone.astype(np.int64), per_text)
        out["n_words_left"] = out["n_words"] - row_sums(np.where(gone, per_line, 0), per_text)
        failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        columns = [table.column(k).combine_chunks() for k, _ in fields] + [pa.array(out[k], pa.int64()) for k in plain]
        columns += [pa.array(failed), pa.array(~failed & (out["n_words_left"] >= min_left * out["n_words"]))]
        if with_text:
            texts = table.column("text").fill_null("").to_pylist()
            ends = np.cumsum(per_text)
            for i in np.flatnonzero(out["n_removed_lines"]).tolist():
                mask = gone[ends[i] - per_text[i] : ends[i]].tolist()
                texts[i] = "\n".join(x for x, g in zip(texts[i].split("\n"), mask, strict=True) if not g)
            columns.append(pa.array(texts, pa.string()))
        whole = pa.RecordBatch.from_arrays(columns, names=schema.names)
        for at in range(0, whole.num_rows, 2048):
            yield whole.slice(at, 2048)

    sent = spread(rows, send, n, "rules-lines")
    got = gathered(sent, answered(sent, _line_answers(max_docs), n), apply, schema, n)
    parts = [F.col(k) for k in plain] + [F.col("base_failed"), F.col("kept_doc").alias("kept")] + [F.col("text")] * with_text
    return got.select(*[F.col(k).alias(c) for (k, _), c in zip(fields, keep, strict=True)], F.struct(*parts).alias(into))
