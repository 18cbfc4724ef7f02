"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (lower case, ASCII white space), hashed to 64 bits.
Each run samples shingles of a set with a hash and an inclusion chance of `first`/size (then 1/(threshold x size)),
so that a pair at the threshold shares at least `first` x threshold (then one) of them on average,
while unlike pairs share few. Sets that chose the same shingle meet in a bucket. A bucket of more than
LIMIT sets is split by a second and third choice, seeded by its path; what is still large then
consists of sets alike, and is compared in chunks. Runs repeat until a pair at the threshold is
found with probability RECALL, by the survival of the branching process.

A pair of a bucket counts in the first leaf where it meets, so each pair is verified once, on the
exact shingle sets, after a cheap test on sizes and a 64-byte one-permutation sketch (it drops pairs
whose estimate is below SKETCH, more than five standard deviations from the threshold). Groups
emit sums per set and a spanning star, never pairs. Equal texts are one node.

Defined results: a null text and one without words link with nothing; a text of one to four words is a
single shingle of all its words; a null id counts as a document but is never a class's id unless
the class has no other; repeated rows are documents of their own; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.blocks import by_group, small_batches, stable, trim, unzip_bytes, zip_bytes
from assay.llm.common import mix64, named, ragged, staged
from assay.llm.components import components, stars

WORDS, THRESHOLD, RECALL, LIMIT, CHUNK, SKETCH, FIRST, DEPTH = 5, 0.8, 0.99, 64, 1024, 0.5, 2.5, 3
BATCH_BYTES = 1 << 20
#: A filter has at least 16 bits a key (two of them set), in slices of SLICE_BITS; beyond MOST_KEYS keys (a filter of 128 MB) a join takes its place.
SLICE_BITS, MOST_KEYS = 1 << 20, 1 << 26


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all texts, sorted within each; how many each has)."""
    number: dict[bytes, int] = {}
    lists = [[number.setdefault(w, len(number)) for w in (t.lower() if t.isascii() else t.decode().lower().encode()).split()] for t in texts]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    if not lengths.sum():
        return np.zeros(0, np.uint64), np.zeros(len(lists), np.int64)
    h = hashes[np.fromiter((i for ids in lists for i in ids), np.int64, int(lengths.sum()))]
    ends = np.cumsum(lengths)
    # words from each position to the end of its text; a text below `words` has one shingle, of all its words
    left = np.repeat(ends, lengths) - np.arange(len(h))
    size = np.minimum(left, words)
    mixed = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(h))):
            more = size > k
            step = mixed[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
            step ^= step >> np.uint64(32)
            mixed[: len(h) - k] = np.where(more[: len(h) - k], step, mixed[: len(h) - k])
    first = np.zeros(len(h), bool)
    first[(ends - lengths)[lengths > 0]] = True
    keep = (left >= words) | first
    tokens = mix64(mixed[keep])
    counts = np.where(lengths > 0, np.maximum(lengths - words + 1, 1), 0)
    stops = np.cumsum(counts)
    for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[(stops - counts)[counts > 0]] = True
    return tokens[new], np.diff(np.concatenate([[0], np.cumsum(new)])[stops], prepend=0)


def runs_for(threshold: float, recall: float, first: float = FIRST, depth: int = DEPTH) -> int:
    """Runs so that a pair at the threshold survives all levels of some run with probability recall."""
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - np.exp(-alive)
    found = 1 - np.exp(-first * threshold * alive)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - found)))


def _choose(tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray, seeds: np.ndarray, expect: float) -> tuple[np.ndarray, np.ndarray]:
    """For each (set, seed): the sampled tokens; (which pair, new path)."""
    if not len(seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = tokens[ragged(starts, counts)]
    # tokens and seeds are mixed already: a product's high bits are enough for the test
    with np.errstate(over="ignore"):
        test = own ^ np.repeat(seeds, counts)
        test *= np.uint64(0x9FB21C651E98DF25)
    test >>= np.uint64(1)
    chance = (np.minimum(expect / np.maximum(counts, 1), 1.0) * 2.0**63).astype(np.uint64)
    keep = np.flatnonzero(test < np.repeat(chance, counts))
    pair = np.searchsorted(np.cumsum(counts), keep, side="right")
    return pair, mix64(own[keep] + mix64(seeds[pair]))


def level_keys(tokens: np.ndarray, counts: np.ndarray, depth: int, runs: int, threshold: float, first: float = FIRST, deep: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """Rows (set, path of level 1, ... of the given depth), one array set a level. Paths that the bits `deep` rule
    out are not followed."""
    starts = np.cumsum(counts) - counts
    n = len(counts)
    out: list[tuple[np.ndarray, ...]] = []
    seeds = mix64(np.arange(1, runs + 1, dtype=np.uint64))
    which, path = [], []
    for seed in seeds:  # one run after another bounds the memory
        pair, key = _choose(tokens, starts, counts, np.full(n, seed), first)
        which.append(pair)
        path.append(key)
    rows = (np.concatenate(which), np.concatenate(path))
    out.append(rows)
    if deep is not None:
        go = in_bits(deep, rows[1])
        rows = tuple(c[go] for c in rows)
    for _ in range(1, depth):
        owner = rows[0]
        pair, key = _choose(tokens, starts[owner], counts[owner], rows[-1], 1 / threshold)
        rows = (*(c[pair] for c in rows), key)
        out.append(rows)
    return out


def _places(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Two bits for each key (rows)."""
    mask = np.uint64(n_bits - 1)
    return np.stack([keys & mask, (mix64(keys) >> np.uint64(7)) & mask]).astype(np.int64)


def in_bits(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys, len(packed) * 8)
    return (((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)).astype(bool)


def sketch(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bytes a set: the top byte of the least hash in each of 64 bins, 255 for an empty bin."""
    u = mix64(tokens ^ np.uint64(0x5851F42D4C957F2D))
    owner = np.repeat(np.arange(len(counts)), counts)
    least = np.full(len(counts) * 64, np.iinfo(np.uint64).max)
    np.minimum.at(least, owner * 64 + (u >> np.uint64(58)).astype(np.int64), u)
    low = (mix64(least) % np.uint64(255)).astype(np.uint8)
    low[least == np.iinfo(np.uint64).max] = 255
    return low.reshape(-1, 64)


def _pair_tests(sizes: np.ndarray, sketches: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that sizes and sketches leave."""
    alike = np.zeros((len(sizes), len(sizes)), np.int16)
    empty = np.zeros_like(alike)
    for k in range(64):
        c = sketches[:, k]
        blank = c == 255
        both = blank[:, None] & blank[None, :]
        alike += (c[:, None] == c[None, :]) & ~both
        empty += both
    near = alike >= SKETCH * (64 - empty)
    small, large = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    return near & (small >= threshold * large)


def _met_before(leaf: int, leaves: list[np.ndarray]) -> np.ndarray:
    """Pairs that share a leaf below this one."""
    m = len(leaves)
    own = np.repeat(np.arange(m), [len(x) for x in leaves])
    value = np.concatenate(leaves)
    keep = value < leaf
    own, value = own[keep], value[keep]
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    own, column = own[shared], np.unique(column[shared], return_inverse=True)[1] if shared.any() else column[:0]
    met = np.zeros((m, m), bool)
    for a in range(0, int(column.max(initial=-1)) + 1, 2048):
        part = (column >= a) & (column < a + 2048)
        mat = np.zeros((m, 2048), np.float32)
        mat[own[part], column[part] - a] = 1
        met |= mat @ mat.T > 0
    return met


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of exact similarities: shared tokens by products of slices of the incidence matrix."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        j = both / max(sizes.sum() - both, 1)
        return np.array([[1.0, j], [j, 1.0]])
    own = np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    own, column = own[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    both = np.zeros((m, m), np.float64)
    width = max(256, (4 << 20) // max(m, 1))
    edges = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        mat = np.zeros((m, width), np.float32)
        mat[own[a:b], column[a:b] - k * width] = 1
        both += mat @ mat.T
    return both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1)


def _candidates(group: pa.Table, threshold: float) -> np.ndarray:
    """Pairs of a group that meet here first, cross the chunks, and pass the cheap tests."""
    leaf, gi, gj = (group.column(k)[0].as_py() for k in ("leaf", "gi", "gj"))
    sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, 64)
    pairs = _pair_tests(group.column("size").to_numpy(), sketches, threshold)
    np.fill_diagonal(pairs, False)
    if gi != gj:
        c = group.column("c").to_numpy()
        pairs &= c[:, None] != c[None, :]
    if pairs.any():
        pairs &= ~_met_before(leaf, [np.array(x, np.int64) for x in group.column("leaves").to_pylist()])
    return pairs


def _filter_of(keys: DataFrame) -> np.ndarray | None:
    """A Bloom filter of distinct keys, sized by their number; None for more than MOST_KEYS. Each slice of it is made by one task
    and sent once, so the driver gets the filter and no more."""
    count = keys.count()
    if count > MOST_KEYS:
        return None
    n_bits = max(SLICE_BITS, 1 << int(np.ceil(np.log2(max(16 * count, 1)))))
    name = keys.columns[0]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy().view(np.uint64), n_bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at // SLICE_BITS).astype(np.int32)), pa.array((at % SLICE_BITS).astype(np.int32))], ["slice", "bit"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in np.unique(own):
                held.setdefault(int(s), np.zeros(SLICE_BITS, bool))[bit[own == s]] = True
        for s, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zip_bytes(np.packbits(bits).tobytes())], pa.binary())], ["slice", "bits"])

    out = np.zeros(n_bits // 8, np.uint8)
    slices = keys.select(name).mapInArrow(spread, "slice int, bit int").repartition("slice").mapInArrow(made, "slice int, bits binary")
    for row in slices.collect():  # at most MOST_KEYS x 16 bits, packed
        out[row.slice * SLICE_BITS // 8 : (row.slice + 1) * SLICE_BITS // 8] = np.frombuffer(unzip_bytes(row.bits), np.uint8)
    return out


def similar_sets(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, size, weight), links (node, links, root)) over distinct texts with words."""
    texts = stable(docs.select(F.col(text_col).alias("text")).where("text is not null"), "path-docs").select(F.xxhash64("text").alias("node"), "text")
    runs = runs_for(threshold, recall)
    small_batches(docs)

    def sets_of(batches: Iterator[pa.RecordBatch], seen: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, tokens, counts) of texts with words; a text that occurs again in the task is left out."""
        for batch in batches:
            node = batch.column("node").to_pylist()
            fresh = []
            for i, x in enumerate(node):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            raw = batch.column("text").cast(pa.binary())
            at = 0
            while at < len(fresh):
                run, size = [], 0
                while at < len(fresh) and size < BATCH_BYTES:
                    run.append(raw[fresh[at]].as_py())
                    size += len(run[-1])
                    at += 1
                tokens, counts = shingles(run, words)
                nodes = np.array([node[i] for i in fresh[at - len(run) : at]], np.int64)
                yield nodes[counts > 0], tokens, counts[counts > 0]
        trim()

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, tokens, counts in sets_of(batches, set()):
            (owner, key), *_ = level_keys(tokens, counts, 1, runs, threshold)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(node) + 1)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].view(np.int64)))
            sk = sketch(tokens, counts)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "size": pa.array(counts), "sketch": pa.array([x.tobytes() for x in sk], pa.binary()), "keys": keys})

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, tokens, counts in sets_of(batches, set()):
            levels = level_keys(tokens, counts, DEPTH, runs, threshold, deep=deep.value)
            for rows in levels[1:]:
                pads = [pa.nulls(len(rows[0]), pa.int64())] * (DEPTH + 1 - len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(node[rows[0]]), *[pa.array(k.view(np.int64)) for k in rows[1:]], *pads], ["node", *[f"k{i}" for i in range(1, DEPTH + 1)]])

    weights = texts.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    sets = texts.mapInArrow(first_level, "node bigint, size bigint, sketch binary, keys array<bigint>").dropDuplicates(["node"])
    nodes = staged(sets.join(weights, "node"), "path-sets")

    met = nodes.select("node", F.explode("keys").alias("k1")).distinct()
    counts = staged(met.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "path-counts")
    leaves = met.join(counts.where(F.col("n") <= LIMIT), "k1").select("node", F.col("k1").alias("leaf"), "n")
    big = counts.where(F.col("n") > LIMIT).select("k1")  # of a staged table, one row a bucket
    if not big.isEmpty():
        deep = docs.sparkSession.sparkContext.broadcast(_filter_of(big))
        rows = texts.mapInArrow(deeper, "node bigint, " + ", ".join(f"k{i} bigint" for i in range(1, DEPTH + 1)))
        rows = staged(rows.join(big, "k1").distinct(), "path-deep")
        for level in range(2, DEPTH + 1):
            k, up = f"k{level}", f"k{level - 1}"
            own = rows.where(F.col(k).isNotNull() & (F.col(f"k{level + 1}").isNull() if level < DEPTH else F.lit(True)))
            if level > 2:
                own = own.join(big, up)
            own = own.select("node", k).distinct()
            counts = own.groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            last = level == DEPTH
            leaves = leaves.unionByName(own.join(counts if last else counts.where(F.col("n") <= LIMIT), k).select("node", F.col(k).alias("leaf"), "n"))
            if not last:
                big = staged(counts.where(F.col("n") > LIMIT).select(k), "path-big")
    leaves = staged(leaves, "path-leaves")

    split = F.ceil(F.col("n") / CHUNK).cast("bigint")
    members = leaves.join(leaves.groupBy("node").agg(F.collect_list("leaf").alias("leaves")), "node").join(nodes.select("node", "size", "sketch", "weight"), "node")
    members = members.withColumn("c", F.pmod(F.xxhash64("node", "leaf"), split)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), split - 1)))
    members = members.select("leaf", F.least("c", "o").alias("gi"), F.greatest("c", "o").alias("gj"), "c", "node", "size", "sketch", "weight", "leaves")

    def active(group: pa.Table) -> dict[str, np.ndarray] | None:
        if group.num_rows < 2:
            return None
        at = np.flatnonzero(_candidates(group, threshold).any(1))
        if not len(at):
            return None
        took = group.select(["leaf", "gi", "gj", "c", "node"]).take(at)
        return {k: took.column(k).to_numpy() for k in ("leaf", "gi", "gj", "c", "node")}

    def verify(group: pa.Table) -> dict[str, np.ndarray] | None:
        pairs = _candidates(group, threshold)
        tokens, counts = shingles(group.column("text").cast(pa.binary()).to_pylist(), words)
        cuts = np.cumsum(counts)[:-1]
        linked = pairs & (jaccard(np.split(tokens, cuts)) >= threshold)
        at = np.flatnonzero(linked.any(1))
        if not len(at):
            return None
        node = group.column("node").to_numpy()
        return {"node": node[at], "links": (linked[at] @ group.column("weight").to_numpy()).astype(np.int64), "root": node[stars(linked)[at]]}

    found = staged(by_group(members, ["leaf", "gi", "gj"], active, "leaf bigint, gi bigint, gj bigint, c bigint, node bigint"), "path-active")
    whole = found.join(leaves.groupBy("node").agg(F.collect_list("leaf").alias("leaves")), "node").join(nodes.select("node", "size", "sketch", "weight"), "node")
    wanted = staged(found.select("node").distinct(), "path-wanted")
    near = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def active_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node = batch.column("node").to_numpy()
            among = np.flatnonzero(in_bits(near.value, node.view(np.uint64))) if near.value is not None else np.arange(len(node))
            at = [i for i in among.tolist() if not (node[i] in seen or seen.add(node[i]))]
            if at:
                yield batch.take(pa.array(at))

    # the filter lets few other texts pass, and the joins drop those; without a filter the first one does it all
    passed = texts if near.value is not None else texts.join(wanted, "node", "left_semi")
    reps = passed.mapInArrow(active_texts, "node bigint, text string").groupBy("node").agg(F.first("text").alias("text"))
    links = by_group(whole.join(reps, "node"), ["leaf", "gi", "gj"], verify, "node bigint, links bigint, root bigint")
    return nodes.select("node", "size", "weight"), staged(links, "path-links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """Per row: id, n_links long (other documents at the threshold or above), class_id (smallest id reachable)."""
    nodes, links = similar_sets(docs, text_col, threshold, recall, words)
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("node"))
    least = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    known = nodes.join(roots, "node", "left").join(sums, "node", "left").join(least, "node").withColumn("root", F.coalesce("root", "node"))
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(classes, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(known, "node", "left")
    return named(out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id")), "id", id_col)
