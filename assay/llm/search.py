"""Ranked lexical search: document-at-a-time merges over compressed postings, shard by shard.

`build_index` cuts the documents into shards of about SHARD_BYTES of text. A shard's documents are numbered in the
order of their ids; its postings (number, occurrences) of a term are sorted by number and kept as
differences in bytes of seven bits. The index is a table: a row for each shard (ids and lengths) and one for each
(shard, term), written by the task that reads the texts: nothing is shuffled, and a word that all documents hold is one
short list a shard. Corpus-wide counts (N, L, df) are sums over its rows.

`search` reads only the lists of the queries' terms. A task takes its shards one after another. For each query a heap
of cursors, one a list, gives the documents that hold a term in ascending order; the document's score is complete before
the next one is looked at; the best k stand in a bounded heap keyed by score, then id, which goes on from shard to shard.
Lists whose largest possible scores together stay below the worst of k full places can't bring in a document by
themselves: they leave the merge and are only looked up for the documents that the others bring. The tasks' heaps (k rows a
query each) are merged in the end.

Queries are broadcast in blocks of about QUERY_ROWS terms (an item's terms are not parted); each block is a pass over its
own terms' lists.

Weight of a term: floor(1000 ln((2N+2)/(2df+1))); gain of a posting: (10^9 tf) div (1000 tf + 8m), m = 25 + (75 n N) div L
for a document of n terms; a score is the sum of weight x gain over the query's terms, repeats included. All but the
logarithm are 64-bit integers.

Defined results: a null or empty text has no terms and is in no result; bytes of 0x80 and more count as parts of terms, valid UTF-8 or not;
documents with a null id count in N, L and df but are not returned; rows that repeat an id are documents of their
own; rows of items with equal id and text are one query, items with equal ids and different texts are ranked each; an item
without terms, or with a null text, has no rows; equal scores go by ascending id, of any type that Python and Spark order
alike; empty tables give empty tables; a very long text is a shard of its own and takes memory for its tokens; further columns
are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.blocks import block_name, cut_tables, pack_table, places, small_batches, split_words, trim, unpack_table
from assay.llm.common import named, staged

SHARD_BYTES, QUERY_ROWS, BEST = 16 << 20, 200_000, 10
INDEX = "shard bigint, term binary, df bigint, total bigint, body binary"
#: ASCII letters in lower case, digits and all bytes of 0x80 and more as they are; else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts one after another, their number in each); a null text has none."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    data = texts.buffers()[2]
    folded = pa.py_buffer((b"" if data is None else data.to_pybytes()).translate(FOLD))
    words, counts = split_words(pa.Array.from_buffers(pa.string(), len(texts), [None, texts.buffers()[1], folded], offset=texts.offset))
    return words.cast(pa.binary()), counts


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of seven bits each, the lowest first, the last below 128; number of bytes of each value)."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        part = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - sizes)[own] + k] = part | np.where(sizes[own] > k + 1, 128, 0).astype(np.uint64)
    return out, sizes


def from_bytes(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        own = first + k <= last
        out[own] |= (data[first[own] + k].astype(np.int64) & 127) << (7 * k)
    return out


def postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """(terms, documents that hold each, their packed postings, number of terms in each text)."""
    words, counts = terms_of(texts)
    coded = words.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), counts)
    key, times = np.unique(key, return_counts=True)
    term, doc = key // max(len(texts), 1), key % max(len(texts), 1)
    new = np.diff(term, prepend=-1) != 0
    step = np.where(new, doc, np.diff(doc, prepend=0))
    data, sizes = to_bytes(np.stack([step, times - 1], 1).ravel())
    starts = np.flatnonzero(new)
    df = np.diff(np.append(starts, len(term)))
    edges = np.concatenate([[0], np.cumsum(sizes)])[np.append(2 * starts, len(sizes))].astype(np.int32)
    bodies = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return coded.dictionary.take(pa.array(term[starts])), df, bodies, counts


def unpacked(bodies: list[bytes], df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the documents, occurrences) of all lists one after another."""
    values = from_bytes(np.frombuffer(b"".join(bodies), np.uint8)).reshape(-1, 2)
    run = np.cumsum(values[:, 0])
    starts = np.cumsum(df) - df
    before = np.where(starts > 0, run[starts - 1], 0) if len(starts) else starts
    return run - np.repeat(before, df), values[:, 1] + 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs (INDEX), staged: rows without a term hold a shard's ids and lengths."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    small_batches(rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(cut_tables(batches, SHARD_BYTES)):
            table = table.take(pc.sort_indices(table, [("id", "ascending")]))  # nulls come last
            terms, df, bodies, counts = postings(table.column("text").combine_chunks())
            shard = block_name(number)
            ids = pack_table(pa.table({"id": table.column("id"), "n": pa.array(counts, pa.int64())}))
            head = {"shard": [shard], "term": [None], "df": [int((counts > 0).sum())], "total": [int(counts.sum())], "body": [ids]}
            schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("total", pa.int64()), ("body", pa.binary())])
            yield pa.RecordBatch.from_pydict(head, schema)
            for a in range(0, len(df), 20_000):
                own = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df[own]), shard)), terms[own], pa.array(df[own]), pa.nulls(len(df[own]), pa.int64()), bodies[own]], schema=schema)
            trim()

    return staged(rows.mapInArrow(index, INDEX), "search-index")


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, item_id, term, times)."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = terms_of(batch.column("text"))
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("item_id").take(at), terms], ["item", "item_id", "term"])

    rows = rows.withColumn("item", F.concat_ws(" ", F.xxhash64("item_id", "text"), F.xxhash64(F.lit("item"), "item_id", "text")))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(split, f"item string, item_id {kind}, term binary").groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class _Last:
    """Ids in reverse order: in the heap of the best the worst is the one with the largest id."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other):
        return other.id < self.id


class Lists:
    """A shard's posting lists of the wanted terms, with the gain of each posting."""

    def __init__(self, ids: list, lengths: np.ndarray, n: int, total: int, terms: list[bytes], df: np.ndarray, bodies: list[bytes]):
        self.ids = ids
        docs, times = unpacked(bodies, df)
        m = 25 + 75 * lengths[docs] * n // max(total, 1)
        gains = 1_000_000_000 * times // (1000 * times + 8 * m)
        known = np.fromiter((x is not None for x in ids), bool, len(ids))[docs] if None in ids else np.ones(len(docs), bool)
        owner = np.repeat(np.arange(len(df)), df)[known]
        docs, gains = docs[known], gains[known]
        cuts = np.searchsorted(owner, np.arange(len(df) + 1)).tolist()
        self.of = {}
        for term, a, b in zip(terms, cuts[:-1], cuts[1:], strict=True):
            if b > a:
                self.of[term] = (int(gains[a:b].max()), docs[a:b].tolist(), gains[a:b].tolist())


def best_of_shard(lists: Lists, query: list[tuple[bytes, int]], best: list, k: int) -> None:
    """Put the shard's documents into `best`, a heap of the k best (score, _Last(id)) so far.

    query: (term, weight times its repeats) of each distinct term.
    """
    own = sorted(((w * lists.of[t][0], w, *lists.of[t][1:]) for t, w in query if t in lists.of and w), key=lambda x: x[0])
    if not own:
        return
    reach = np.cumsum([x[0] for x in own], dtype=object).tolist()  # the most that lists 0..j give together
    docs, gains, weights = [x[2] for x in own], [x[3] for x in own], [x[1] for x in own]
    at = [0] * len(own)
    least = best[0][0] if len(best) == k else 0
    aside = 0  # lists below this number are only looked up
    while aside < len(own) and reach[aside] < least:
        aside += 1
    cursors = [(docs[j][0], j) for j in range(aside, len(own))]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            j = cursors[0][1]
            place = at[j]
            score += weights[j] * gains[j][place]
            at[j] = place = place + 1
            if place < len(docs[j]):
                heapq.heapreplace(cursors, (docs[j][place], j))
            else:
                heapq.heappop(cursors)
        for j in range(aside - 1, -1, -1):
            if score + reach[j] < least:
                break
            place = at[j] = bisect_left(docs[j], doc, at[j])
            if place < len(docs[j]) and docs[j][place] == doc:
                score += weights[j] * gains[j][place]
        else:
            if not score:
                continue
            entry = (score, _Last(lists.ids[doc]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif best[0] < entry:
                heapq.heapreplace(best, entry)
            if len(best) == k and best[0][0] > least:
                least = best[0][0]
                if aside < len(own) and reach[aside] < least:
                    while aside < len(own) and reach[aside] < least:
                        aside += 1
                    cursors = [c for c in cursors if c[1] >= aside]
                    heapq.heapify(cursors)


def search(index: DataFrame, items: DataFrame, k: int = BEST, item_id_col: str = "item_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k best documents of the index with a score above 0."""
    spark = index.sparkSession
    wanted = staged(query_terms(items, item_id_col, text_col), "search-terms")
    n, total = (x or 0 for x in index.where("term is null").agg(F.sum("df"), F.sum("total")).first())
    df = index.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    blocks = max(1, -(-wanted.count() // QUERY_ROWS))
    weighted = staged(wanted.join(df, "term").select(F.pmod(F.hash("item"), F.lit(blocks)).alias("block"), "item", "item_id", "term", (weight * F.col("times")).cast("bigint").alias("weight")), "search-weights")
    kind = wanted.schema["item_id"].dataType.simpleString()
    found = [_search_block(index, weighted.where(F.col("block") == b), n, total, k, f"item string, item_id {kind}, doc_id {id_type}, score bigint") for b in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
    return named(every.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "item_id", item_id_col)


def _search_block(index: DataFrame, weighted: DataFrame, n: int, total: int, k: int, schema: str) -> DataFrame:
    spark = index.sparkSession
    rows = weighted.select("item", "item_id", "term", "weight").toArrow().sort_by("item")  # a block of about QUERY_ROWS rows
    queries: dict[str, tuple] = {}
    for item, item_id, term, w in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        queries.setdefault(item, (item_id, []))[1].append((term, w))
    sent = spark.sparkContext.broadcast(queries)
    terms = F.broadcast(weighted.select("term").distinct())  # of the same bounded block
    lists = index.where("term is not null").join(terms, "term", "left_semi").unionByName(index.where("term is null"))
    small_batches(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list] = {}
        for shard in _shards(batches):
            head = unpack_table(shard[0][2])
            held = Lists(head.column("id").to_pylist(), head.column("n").to_numpy(), n, total, [t for t, _, _ in shard[1:]], np.array([d for _, d, _ in shard[1:]], np.int64), [b for _, _, b in shard[1:]])
            for item, (_, query) in sent.value.items():
                best_of_shard(held, query, best.setdefault(item, []), k)
        out = [(item, sent.value[item][0], last.id, score) for item, heap in best.items() for score, last in heap]
        for a in range(0, len(out), 10_000):
            item, item_id, doc, score = zip(*out[a : a + 10_000], strict=True)
            yield pa.RecordBatch.from_pydict({"item": list(item), "item_id": pa.array(item_id, rows.schema.field("item_id").type), "doc_id": list(doc), "score": pa.array(score, pa.int64())})
        trim()

    dealt = lists.select("shard", "term", "df", "body").repartition(places(index), "shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
    return dealt.mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes | None, int, bytes]]]:
    """The rows (term, df, body) of each shard; the first has no term."""
    held, last = [], None
    for batch in batches:
        for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != last and held:
                yield held
                held = []
            held.append(tuple(row))
            last = shard
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """Each item's k best documents, by an index of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    return search(build_index(docs, id_col, text_col), items, k, item_id_col, text_col, kind)
