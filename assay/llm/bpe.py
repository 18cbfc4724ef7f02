"""BPE encoding and decoding through a table of distinct words.

Texts are cut at ASCII white space, where every tokenizer of the supported kind (white space is
dropped before merging, each word is merged by itself) also cuts. A block of documents sends its
distinct words to word buckets and keeps, for each text, the numbers of its words in order. A bucket encodes each distinct word of the corpus once; the ids go back to the
blocks, where they are joined to the words by position. A block ends when its word table has
MAX_WORDS words, so a task's memory doesn't follow its texts. Decoding takes each id's piece
from the vocabulary, a table whose size the tokenizer file bounds.

Defined results: a null text counts as empty; an empty text has no ids; a very long text is one
piece and takes memory for its words' numbers (4 bytes each) and ids; bytes that are not valid
UTF-8 are read as Spark's make_valid_utf8 gives them; ids may be of any type; repeated rows give
repeated rows; a null id stays null; an empty table gives an empty table; further columns are not
read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.blocks import answered, cut_tables, fixed, gathered, join_parts, pack_table, places, split_parts, split_words, spread, spread_again, stable, unpack_table, unzip_bytes, unzip_ints, unzip_words, word_hashes, word_runs, zip_bytes, zip_ints, zip_words
from assay.llm.common import named, ragged

#: Texts whose case counts: a character above U+00FF, or the begin of a special token.
ODD = r"[^\x00-\x{ff}]|<\|"
#: A lower-case word that is merged by itself, then marks that are merged by themselves.
STEM = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]*)")
MARKS = np.array([chr(c).isascii() and 33 <= c < 127 and not chr(c).isalnum() and c != 39 for c in range(256)])
BATCH = 2048
MAX_WORDS = 300_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """Piece by id; the vocabulary file bounds its size."""
    t = tokenizer(path)
    return pa.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))], pa.string())


def lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case where that can't change the encoding."""
    odd = pc.match_substring_regex(texts, ODD)
    return pc.if_else(odd, texts, pc.utf8_lower(texts))


def stems(words: pa.Array) -> pa.Array:
    """Words without the marks at their end."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    last = np.maximum.reduceat(np.where(MARKS[data], -1, np.arange(len(data))), offsets[:-1])  # no word is empty
    lengths = np.maximum(last + 1 - offsets[:-1], 0)
    cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(data[ragged(offsets[:-1], lengths)])])


def _lists(table: pa.Array, home: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each bucket's words, in order of their numbers; a word and its forms with marks share a bucket."""
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(home[order[a]]), zip_words(table.take(pa.array(order[a:b])))


def _homes(words: pa.Array, n: int) -> np.ndarray:
    """Bucket of each word."""
    return np.concatenate([np.zeros(0, np.int64), *((word_hashes(stems(run)) % np.uint64(n)).astype(np.int64) for run in word_runs(words))])


def _sender(lists: bool, pieces: bool):
    """What a block sends: its word lists, and its pieces (the ids of rows, words of each, numbers of the words) with,
    as slot n, the bucket of each word.

    Words are numbered as they first come; the first time a number comes it is written as 0, others one up.
    """

    def send(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
        known: dict[bytes, int] = {}
        block, piece = 0, n

        def finish() -> Iterator[tuple[int, int, bytes]]:
            words = pa.array(list(known), pa.binary())
            home = _homes(words, n)
            if lists:
                yield from ((block, slot, body) for slot, body in _lists(words, home))
            if pieces:
                yield block, n, zip_ints(home)

        for table in cut_tables(batches):
            words, counts = split_words(lowered(pc.fill_null(table.column("text").combine_chunks(), "")))
            coded = words.dictionary_encode()
            before = len(known)
            number = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
            piece += 1
            if pieces:
                at = number[coded.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
                top = np.maximum.accumulate(np.concatenate([[before - 1], at]))
                yield block, piece, join_parts([pack_table(table.select(["id"])), zip_ints(counts), *_zip_numbers(np.where(at > top[:-1], 0, at + 1)), np.int64([before]).tobytes()])
            if len(known) >= MAX_WORDS:
                yield from finish()
                known, block, piece = {}, block + 1, n
        if known:
            yield from finish()

    return send


def _zip_numbers(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers, most of them small: a byte each, 255 for those that follow apart."""
    return zip_bytes(np.minimum(x, 255).astype(np.uint8).tobytes()), zip_ints(x[x >= 255] - 255)


def _unzip_numbers(small: bytes, large: bytes, before: int) -> np.ndarray:
    x = np.frombuffer(unzip_bytes(small), np.uint8).astype(np.int64)
    x[x == 255] += unzip_ints(large)
    new = x == 0
    return np.where(new, before + np.cumsum(new) - 1, x - 1)


def encode_words(t, words: list[bytes]) -> list[list[int]]:
    """Ids of each word. Plain words and the marks after them are encoded once for all words that share them."""
    known: dict[bytes, list[int]] = {}
    plain = [STEM.fullmatch(w) for w in words]
    for m in plain:
        if m and m[1] not in known:
            known[m[1]] = [x.id for x in t.model.tokenize(m[1].decode())]
    rest = [w for w, m in zip(words, plain, strict=True) if not m] + list({m[2] for m in plain if m and m[2]})
    own: dict[bytes, list[int]] = {b"": []}
    for at in range(0, len(rest), 4096):
        run = rest[at : at + 4096]
        own.update(zip(run, (e.ids for e in t.encode_batch_fast([w.decode() for w in run], add_special_tokens=False)), strict=True))
    return [known[m[1]] + own[m[2]] if m else own[w] for w, m in zip(words, plain, strict=True)]


def _encoder(path: str) -> Callable[[list[bytes]], Iterator[bytes]]:
    def resolve(lists: list[bytes]) -> Iterator[bytes]:
        t = tokenizer(path)
        coded = pa.chunked_array([unzip_words(x) for x in lists]).dictionary_encode()
        ids = encode_words(t, coded.chunk(0).dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for e in ids for i in e), np.uint32, int(lengths.sum()))
        del ids
        starts = np.cumsum(lengths) - lengths
        for chunk in coded.chunks:
            at = chunk.indices.to_numpy()
            yield join_parts([zip_ints(lengths[at]), zip_ints(flat[ragged(starts[at], lengths[at])])])

    return resolve


def _ids(answer: dict[int, bytes], pieces: Iterator[tuple[int, bytes]], n: int) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
    """(ids of rows, number of the first of them in its block, tokens of each row, their ids) for runs of rows."""
    parts = [split_parts(answer.pop(slot)) for slot in sorted(answer)]
    each = np.concatenate([unzip_ints(x) for x, _ in parts] or [np.zeros(0, np.uint32)])
    flat = np.concatenate([unzip_ints(x) for _, x in parts] or [np.zeros(0, np.uint32)])
    del parts
    lengths, firsts, first = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
    for slot, body in pieces:
        if slot == n:
            order = np.argsort(unzip_ints(body), kind="stable")
            lengths, firsts = np.empty(len(order), np.int32), np.empty(len(order), np.int64)
            lengths[order], firsts[order] = each, np.cumsum(each, dtype=np.int64) - each
            continue
        packed, counts, small, large, before = split_parts(body)
        owner, counts = unpack_table(packed).column("id"), unzip_ints(counts).astype(np.int64)
        at = _unzip_numbers(small, large, int(np.frombuffer(before, np.int64)[0]))
        ends = np.concatenate([[0], np.cumsum(counts)])
        for row in range(0, len(counts), BATCH):
            stop = min(row + BATCH, len(counts))
            run = at[ends[row] : ends[stop]]
            tokens = lengths[run].astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(tokens)])
            yield owner.slice(row, stop - row).combine_chunks(), first + row, np.diff(sums[ends[row : stop + 1] - ends[row]]), flat[ragged(firsts[run], tokens)]
        first += len(counts)


def encode_with(docs: DataFrame, path: str, finish: Callable[[pa.Array, int, int, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, id_col: str = "doc_id", text_col: str = "text", once: bool = True) -> DataFrame:
    """Encode all texts; finish(ids of rows, block, number of the first row in it, tokens of each row, token ids) makes output rows.

    once: split texts once and stage what comes of it; else split them in two scans and stage nothing.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    n = places(docs)

    def apply(block: int, answer: dict[int, bytes], pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for owner, row, counts, ids in _ids(answer, pieces, n):
            yield finish(owner, block, row, counts, ids)

    if once:
        words = pieces = spread(docs, _sender(True, True), n, "bpe-words")
    else:
        docs = fixed(stable(docs, "bpe-docs"))
        words, pieces = (spread_again(docs, _sender(lists, not lists), n) for lists in (True, False))
    return gathered(pieces, answered(words, _encoder(path), n), apply, schema, n)


def decode_ids(flat: np.ndarray, counts: np.ndarray, vocabulary: pa.Array) -> pa.Array:
    """Texts of rows of ids: each id's piece by a join on the vocabulary, put together by position."""
    took = vocabulary.take(pa.array(flat.astype(np.int64)))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), took)
    return pc.binary_join(lists, " ")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Per row of docs: id, n_tokens long, ids binary (unsigned 32-bit little-endian), decoded string.

    The ids are those of the tokenizers library without special tokens, truncation or padding;
    decoded is the text that its decode(ids, skip_special_tokens=False) gives.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(owner: pa.Array, block: int, row: int, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.cumsum(counts)])
        raw = ids.astype("<u4").tobytes()
        columns = {
            "id": owner,
            "n_tokens": pa.array(counts, pa.int64()),
            "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
        if decoded:
            columns["decoded"] = decode_ids(ids, counts, pieces(path))
        return pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded
    out = encode_with(docs, path, finish, schema, id_col, text_col, once=False)
    return named(out, "id", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column decoded: the text of each row's ids (binary, as encode gives them)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(ids_col).to_pylist()]
            counts = np.array([len(x) // 4 for x in raw], np.int64)
            text = decode_ids(np.frombuffer(b"".join(raw), "<u4"), counts, pieces(path))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)
