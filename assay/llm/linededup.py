"""Line deduplication that can be taken back: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at its ends, A-Z in lower case; it is named by 128 bits of
hash. Keys below LEAST_CHARS code points are never looked at. A `LineIndex` holds, as tables in the shared folder,

* references: a row for each (key, document), exact;
* counts: for each key its number of documents and the largest id among them, exact;
* seen, common: for each shard of the keys a cuckoo filter of the keys that are there, and of those that
  MIN_DOCS or more documents hold.

`insert` asks the seen filters first: a key they don't know is new and needs no look at the exact tables, so
the joins with them carry only what may be there. `delete` takes a document's references out again, counts the keys it
held anew and takes those that went from the filters, which cuckoo filters can do. `rewrite` asks the common filters
where the lines are scanned: only lines that may be common leave the scan. What they say yes to is then
looked up in the counts, so a false yes changes nothing. Every state is a new set of tables: a task that runs
twice or an insert that fails leaves the old one as it was.

A line that a third of all documents hold: references are spread by (key, document), counts combine before the
shuffle, and at the look-up the keys with more than a HOT share of the references (at most 1 / HOT of them by
counting) are broadcast, so no task gets a key's lines together. The common filters are broadcast where they have
FILTER_BYTES at most (some 100 million keys); beyond that the lines go to the join without them. Filters
that fill up are built anew from the counts.

Defined results: a null or empty text is one empty line; bytes that are not valid UTF-8 are read as Spark's
make_valid_utf8 gives them; rows that repeat an id count as one document, and each gets a row; rows with a null id are not counted,
hold nothing and lose all common lines; ids of any type that Spark orders; several equal lines of the largest document all
stay; an empty table gives an empty table; a very long text takes memory for itself and its lines; further columns
are not read, so their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.blocks import small_batches
from assay.llm.common import mix64, named, staged

MIN_DOCS, LEAST_CHARS = 3, 20
SHARD_KEYS, FILTER_BYTES = 500_000, 256 << 20
HOT = 1 / 20_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["hi", "lo"]
SLOTS, LOAD, TURNS = 4, 0.8, 500


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each key has two buckets, either found from the other by the fingerprint."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter with all of the distinct keys; it is made larger until they fit."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(len(keys), 1) / (SLOTS * LOAD)))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if made.add(keys):
                return made
            buckets *= 2

    @classmethod
    def unpack(cls, body: bytes) -> CuckooFilter:
        return cls(np.frombuffer(body, np.uint16).reshape(-1, SLOTS).copy())

    def pack(self) -> bytes:
        return self.table.tobytes()

    def room(self) -> int:
        """How many more keys it takes before its load is over LOAD."""
        return int(self.table.size * LOAD) - int(np.count_nonzero(self.table))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix64(keys)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        return np.where(prints == 0, np.uint16(1), prints), (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mix64(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be there; always true if it is."""
        prints, at = self._places(keys)
        here = (self.table[at] == prints[:, None]).any(1)
        return here | (self.table[self._other(at, prints)] == prints[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """False if they don't fit; the filter is of no more use then."""
        prints, at = self._places(keys)
        random = np.random.default_rng(len(keys))
        for _ in range(TURNS):
            for _ in range(2):  # a free slot in one bucket or the other
                order = np.argsort(at, kind="stable")
                prints, at = prints[order], at[order]
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                free = self.table[at] == 0
                fits = nth < free.sum(1)
                column = (np.cumsum(free, 1) == (nth + 1)[:, None]).argmax(1)
                self.table[at[fits], column[fits]] = prints[fits]
                prints, at = prints[~fits], at[~fits]
                if not len(at):
                    return True
                at = self._other(at, prints)
            first = np.unique(at, return_index=True)[1]  # both are full: one newcomer a bucket puts an older one out
            column = random.integers(0, SLOTS, len(first))
            out = self.table[at[first], column]
            self.table[at[first], column] = prints[first]
            prints[first], at[first] = out, self._other(at[first], out)
        return False

    def discard(self, keys: np.ndarray) -> None:
        """Take out keys that are there, one fingerprint for each."""
        prints, at = self._places(keys)
        pair = np.minimum(at, self._other(at, prints)) << 16 | prints
        while len(at):
            own = np.unique(pair, return_index=True)[1]
            todo = own
            for places in (at, self._other(at, prints)):
                same = self.table[places[todo]] == prints[todo][:, None]
                found = same.any(1)
                self.table[places[todo[found]], same[found].argmax(1)] = 0
                todo = todo[~found]
            left = np.ones(len(at), bool)
            left[own] = False
            prints, at, pair = prints[left], at[left], pair[left]


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def _valid(text_col: str) -> Column:
    return F.coalesce(F.make_valid_utf8(F.col(f"`{text_col}`")), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(lines: DataFrame) -> DataFrame:
    """Rows with a column line, that has a key, with the key's hashes in place of it."""
    return lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= LEAST_CHARS).withColumn("hi", F.xxhash64("key")).withColumn("lo", F.xxhash64(F.lit("line"), "key")).drop("key", "line")


def _shard(shards: int) -> Column:
    return F.pmod("hi", F.lit(shards)).cast("int").alias("shard")


def _keys(table: pa.Table) -> np.ndarray:
    return table.column("lo").to_numpy().view(np.uint64)


def _build(keys: DataFrame, shards: int, label: str) -> DataFrame:
    """Rows (shard, body): a filter for each shard of the distinct keys."""

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table.column("shard").slice(0, 1), "body": pa.array([CuckooFilter.of(_keys(table)).pack()], pa.binary())})

    small_batches(keys)
    return staged(keys.select(_shard(shards), "lo").groupBy("shard").applyInArrow(build, "shard int, body binary"), label, packed=True)


def _change(filters: DataFrame, added: DataFrame, gone: DataFrame, shards: int, exact: DataFrame, label: str) -> DataFrame:
    """The filters with keys added and others taken out; what has no room is built anew from the exact keys."""
    small_batches(filters)
    rows = added.select(_shard(shards), "lo", F.lit(True).alias("add")).unionByName(gone.select(_shard(shards), "lo", F.lit(False).alias("add")))

    def change(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left
        keys, add = _keys(right), right.column("add").to_numpy()
        if not left.num_rows:
            return pa.table({"shard": right.column("shard").slice(0, 1), "body": pa.array([CuckooFilter.of(keys[add]).pack()], pa.binary())})
        own = CuckooFilter.unpack(left.column("body")[0].as_py())
        own.discard(keys[~add])
        fits = own.room() >= int(add.sum()) and own.add(keys[add])
        return pa.table({"shard": left.column("shard"), "body": pa.array([own.pack() if fits else None], pa.binary())})

    got = staged(filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(change, "shard int, body binary"), label, packed=True)
    full = got.where("body is null").select("shard")
    if full.isEmpty():
        return got
    again = _build(exact.withColumn("shard", _shard(shards)).join(full, "shard", "left_semi").select(*KEY), shards, label)
    return got.where("body is not null").unionByName(again)


@dataclass(frozen=True)
class LineIndex:
    """The lines of the documents inserted so far."""

    references: DataFrame  # hi, lo, doc
    counts: DataFrame  # hi, lo, docs, last
    seen: DataFrame  # shard, body
    common: DataFrame  # shard, body
    shards: int
    min_docs: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> LineIndex:
        """An index of docs alone."""
        references = staged(references_of(docs, id_col, text_col), "line-references")
        return cls._over(references, staged(_count(references), "line-counts"), min_docs)

    @classmethod
    def _over(cls, references: DataFrame, counts: DataFrame, min_docs: int) -> LineIndex:
        shards = max(1, -(-counts.count() // SHARD_KEYS))
        return cls(references, counts, _build(counts, shards, "line-seen"), _build(counts.where(F.col("docs") >= min_docs), shards, "line-common"), shards, min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With docs too. An id that is there already gets these lines beside those it has."""
        batch = staged(references_of(docs, id_col, text_col), "line-batch")
        keys = batch.select(*KEY).distinct().withColumn("shard", _shard(self.shards))
        small_batches(keys)

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            hit = CuckooFilter.unpack(right.column("body")[0].as_py()).holds(_keys(left)) if right.num_rows and left.num_rows else np.zeros(left.num_rows, bool)
            return left.select(KEY).append_column("hit", pa.array(hit))

        probed = staged(keys.groupBy("shard").cogroup(self.seen.groupBy("shard")).applyInArrow(probe, "hi bigint, lo bigint, hit boolean"), "line-probed")
        maybe = batch.join(probed.where("hit"), KEY, "left_semi").join(self.references, [*KEY, "doc"], "left_anti")
        fresh = staged(batch.join(probed.where("not hit"), KEY, "left_semi").unionByName(maybe), "line-fresh")
        change = staged(_count(fresh).join(self.counts.select(*KEY, F.col("docs").alias("had"), F.col("last").alias("was")).join(probed.where("hit"), KEY, "left_semi"), KEY, "left"), "line-change")
        new = change.select(*KEY, (F.col("docs") + F.coalesce("had", F.lit(0))).alias("docs"), F.greatest("last", "was").alias("last"), "had")
        counts = staged(self.counts.join(change.where("had is not null"), KEY, "left_anti").unionByName(new.drop("had")), "line-counts")
        references = staged(self.references.unionByName(fresh), "line-references")
        if counts.count() > 4 * SHARD_KEYS * self.shards:
            return self._over(references, counts, self.min_docs)
        over = counts.where(F.col("docs") >= self.min_docs)
        none = new.where("false")
        seen = _change(self.seen, new.where("had is null"), none, self.shards, counts, "line-seen")
        common = _change(self.common, new.where((F.col("docs") >= self.min_docs) & (F.coalesce("had", F.lit(0)) < self.min_docs)), none, self.shards, over, "line-common")
        return LineIndex(references, counts, seen, common, self.shards, self.min_docs)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents of these ids; ids that are not there change nothing."""
        gone = ids.select(F.col(f"`{id_col}`").alias("doc")).distinct()
        references = staged(self.references.join(gone, "doc", "left_anti"), "line-references")
        touched = staged(self.references.join(gone, "doc", "left_semi").select(*KEY).distinct().join(self.counts.select(*KEY, F.col("docs").alias("had")), KEY), "line-touched")
        now = _count(references.join(touched, KEY, "left_semi"))
        change = staged(touched.join(now, KEY, "left"), "line-change")
        counts = staged(self.counts.join(touched, KEY, "left_anti").unionByName(change.where("docs is not null").select(*KEY, "docs", "last")), "line-counts")
        none = change.where("false")
        seen = _change(self.seen, none, change.where("docs is null"), self.shards, counts, "line-seen")
        fell = change.where((F.col("had") >= self.min_docs) & (F.coalesce("docs", F.lit(0)) < self.min_docs))
        common = _change(self.common, none, fell, self.shards, counts.where(F.col("docs") >= self.min_docs), "line-common")
        return LineIndex(references, counts, seen, common, self.shards, self.min_docs)

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row of docs: id, n_lines, n_dropped long, kept string: the text without its common lines, except in the largest document of each."""
        rows = docs.select(F.col(f"`{id_col}`").alias("doc"), _valid(text_col).alias("text"))
        row = [F.xxhash64("doc", "text").alias("r1"), F.xxhash64(F.lit("row"), "doc", "text").alias("r2")]
        lines = _keyed(rows.select("doc", *row, F.posexplode(_lines(F.col("text"))).alias("place", "line")))
        small_batches(lines)
        lines = staged(self._may_be_common(lines), "line-maybe")
        over = self.counts.where(F.col("docs") >= self.min_docs)
        total = self.counts.agg(F.sum("docs")).first()[0] or 0
        bound = max(1000, int(total * HOT))
        marked = lines.join(F.broadcast(over.where(F.col("docs") > bound).select(*KEY, F.col("last").alias("hot"))), KEY, "left")
        found = marked.where("hot is not null").select("doc", "r1", "r2", "place", F.col("hot").alias("last"))
        rest = marked.where("hot is null").drop("hot").join(over.where(F.col("docs") <= bound).select(*KEY, "last"), KEY)
        found = found.unionByName(rest.select("doc", "r1", "r2", "place", "last"))
        dropped = found.where(~F.col("doc").eqNullSafe(F.col("last"))).select("r1", "r2", "place").distinct().groupBy("r1", "r2").agg(F.collect_list("place").alias("places"))
        out = rows.select(F.col("doc"), "text", *row).join(dropped, ["r1", "r2"], "left").select("doc", "text", "places")
        schema = T.StructType([out.schema["doc"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
        return named(out.mapInArrow(_without, schema), "doc", id_col)

    def _may_be_common(self, lines: DataFrame) -> DataFrame:
        spark = lines.sparkSession
        size = self.common.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        if size > FILTER_BYTES:
            return lines
        filters = spark.sparkContext.broadcast({r.shard: bytes(r.body) for r in self.common.collect()})  # FILTER_BYTES at most
        shards = self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {s: CuckooFilter.unpack(b) for s, b in filters.value.items()}
            for batch in batches:
                hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy().view(np.uint64)
                shard, hit = hi % shards, np.zeros(len(hi), bool)
                for s in np.unique(shard).tolist():
                    if s in own:
                        here = np.flatnonzero(shard == s)
                        hit[here] = own[s].holds(lo[here])
                yield batch.filter(pa.array(hit))

        return lines.mapInArrow(probe, lines.schema)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n_lines, n_dropped, kept) of rows (doc, text, places of the lines to drop)."""
    for batch in batches:
        total, dropped, kept = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            total.append(text.count("\n") + 1)
            dropped.append(len(places or ()))
            if places:
                gone = set(places)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_lines", "n_dropped", "kept"])


def references_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (hi, lo, doc) of the lines with a key."""
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc"), F.explode(_lines(_valid(text_col))).alias("line"))
    return _keyed(rows).select(*KEY, "doc").distinct()


def _count(references: DataFrame) -> DataFrame:
    return references.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """docs rewritten by an index of themselves (`LineIndex`)."""
    return LineIndex.build(docs, id_col, text_col, min_docs).rewrite(docs, id_col, text_col)


