"""Hard-negative mining: a vantage-point tree over norm-augmented vectors.

Components become integers floor(SCALE x); a row's score is its inner product with the anchor. An anchor's positives are
its first rows of the same label; the negatives of a positive are the first rows of other labels whose score is at
least `low` percent of the positive's score and not above it.

With a component sqrt(M^2 - |x|^2) added to each row (M: the largest norm) and 0 to the anchor, the squared distance is
|q|^2 + M^2 - 2 score: scores fall as distances grow, and a score window is a distance annulus. So a metric tree finds them:

1. A tree over a bounded sample (SAMPLE rows) deals the rows into leaves, close ones together; leaves above
   SHARD_ROWS are dealt further by a hash. The sample decides about where rows lie, not about results. Of rows equal in vector and label only the
   first few by id can be among the first of anything: as many as there are places stay, the others are not copied further.
2. Each shard builds a vantage-point tree of its rows: a node has a vantage row and, for its near and far half, the least and
   largest distance from it.
3. Anchors walk a tree together. The distances from its vantage rows bound the scores of each leaf for each anchor; an anchor first
   meets the leaf that can hold its highest scores, then those leaves that can still reach its annulus and what
   doesn't fill all places yet. A leaf's rows meet all anchors that open it in one product of matrices.
   What a shard finds stays in the task as the bound of its next shard. Equal scores come out by id.
4. The tasks' lists are merged. The first pass gives the positives, the second one all annuli of an anchor's positives.

Anchors are broadcast in blocks of ANCHOR_BYTES, a pass for each block.

Defined results: rows with a null label or id, a null vector, or null or non-finite components take no part; nor do rows whose length
isn't the anchor's; an empty vector is one of length 0, with score 0 to its like; rows that repeat an id are rows of
their own, but none is its own anchor's positive; anchors that agree in id, label and vector are one; ties by smaller id; an anchor without positives, or
a positive without negatives, has no rows; empty tables give empty tables; further columns are not read. Scores are exact as long
as squared norms stay below 2^62; larger ones are refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.blocks import small_batches, trim
from assay.llm.common import buckets, staged

SCALE, SAMPLE, SHARD_ROWS, LEAF, MOST_LEAVES = 256, 20_000, 4096, 256, 1024
ANCHOR_BYTES = 32 << 20
EXACT, MOST, NONE = float(1 << 53), float(1 << 62), -(1 << 62)
TOGETHER = 1024  # questions that walk a tree at a time


def _distances(rows: np.ndarray, norms: np.ndarray, at: int, most: float) -> np.ndarray:
    """Distances of augmented rows from the row `at`."""
    lift = np.sqrt(np.maximum(most - norms, 0))
    square = norms + norms[at] - 2 * (rows @ rows[at]) + (lift - lift[at]) ** 2
    return np.sqrt(np.maximum(square, 0))


class Places:
    """The first k rows (score, id) of each question, by falling score, then id; a place that nothing fills has the score NONE.

    Question i is the anchor anchor[i]'s: rows with low[i] <= score <= high[i]."""

    def __init__(self, k: int, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, kind: type):
        self.anchor, self.high = anchor, high.astype(kind)
        self.low = low.astype(kind)  # rises to the score of the last place once all are filled
        self.scores, self.ids = np.full((len(anchor), k), NONE, kind), np.zeros((len(anchor), k), np.int64)

    def add(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows within the limits of the questions `asked`, one each."""
        if not len(asked):
            return
        own, k = np.unique(asked), self.scores.shape[1]
        q = np.concatenate([asked, np.repeat(own, k)])
        scores, ids = np.concatenate([scores, self.scores[own].ravel()]), np.concatenate([ids, self.ids[own].ravel()])
        order = np.lexsort((ids, -scores, q))
        q = q[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        best = place < k
        self.scores[q[best], place[best]], self.ids[q[best], place[best]] = scores[order][best], ids[order][best]
        last = self.scores[own, -1]
        self.low[own] = np.where(last > NONE, last, self.low[own])


class VantageTree:
    """Nodes in arrays. A node's rows are rows[first:stop]; its vantage row is at `first`, its halves are the nodes near and far, if any."""

    def __init__(self, rows: np.ndarray, most: float, leaf: int = LEAF, seed: int = 0):
        self.most = most
        self.order = np.arange(len(rows))
        self.rows = rows.astype(np.float64)
        self.norms = (self.rows**2).sum(1)
        self.nodes: list[tuple[int, int, int, int, float, float, float, float]] = []
        random = np.random.default_rng(seed)
        todo = [(0, len(rows))] if len(rows) else []
        while todo:  # a node's halves get the next two numbers
            nexts = []
            base = len(self.nodes) + len(todo)
            for a, b in todo:
                if b - a <= leaf:
                    self.nodes.append((a, b, -1, -1, 0.0, 0.0, 0.0, 0.0))
                    continue
                self._swap(a, int(random.integers(a, b)))
                far = _distances(self.rows[a:b], self.norms[a:b], 0, most)[1:]
                order = np.argsort(far, kind="stable")
                self._arrange(a + 1, b, order)
                far = far[order]
                mid = len(far) // 2
                at = base + len(nexts)
                self.nodes.append((a, b, at, at + 1, far[0], far[mid - 1], far[mid], far[-1]))
                nexts += [(a + 1, a + 1 + mid), (a + 1 + mid, b)]
            todo = nexts

    def _swap(self, i: int, j: int) -> None:
        for x in (self.rows, self.norms, self.order):
            x[[i, j]] = x[[j, i]]

    def _arrange(self, a: int, b: int, order: np.ndarray) -> None:
        for x in (self.rows, self.norms, self.order):
            x[a:b] = x[a:b][order]

    def nearest_first(self, anchor: np.ndarray, ids: np.ndarray, ok: np.ndarray, low: float, high: float) -> Iterator[tuple[int, int, int]]:
        """(score, id, row) of the rows in `ok` (by row number) with low <= score <= high, by falling score, then id.

        `low` may rise while it runs: send() a new one.
        """
        if not self.nodes:
            return
        q = anchor.astype(np.float64)
        square = float(q @ q)
        total = square + self.most
        slack = 1e-9 * total + 1.0
        exact = max(self.most, square) < EXACT
        queue: list[tuple] = [(-np.inf, 0, 0, 0)]  # (key, 0, 0, node) or (key, 1, id, row)
        whole = anchor.astype(np.int64)
        while queue:
            key, is_row, id_, at = heapq.heappop(queue)
            if -key < low:
                return
            if is_row:
                got = yield int(-key), id_, at
                low = got if got is not None and got > low else low
                continue
            a, b, near, far, *reach = self.nodes[at]
            stop = b if near < 0 else a + 1
            own = self.order[a:stop]
            scores = (self.rows[a:stop] @ q).astype(np.int64) if exact else self.rows[a:stop].astype(np.int64) @ whole
            fit = np.flatnonzero(ok[own] & (scores >= low) & (scores <= high))
            for i in fit.tolist():
                heapq.heappush(queue, (-int(scores[i]), 1, int(ids[own[i]]), int(own[i])))
            if near < 0:
                continue
            # distance of the anchor from the vantage row, then the annulus of each half
            d = np.sqrt(max(total - 2 * float(scores[0]), 0.0))
            for child, (least, most) in ((near, reach[:2]), (far, reach[2:])):
                close, away = max(0.0, d - most, least - d), d + most
                top, bottom = (total - close * close) / 2 + slack, (total - away * away) / 2 - slack
                if top >= low and bottom <= high:
                    heapq.heappush(queue, (-min(top, high), 0, 0, child))


    def fill(self, places: Places, asked: np.ndarray, anchors: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray) -> None:
        """Add the tree's rows to the places of the questions `asked`. fits(anchors, rows), by numbers: a mask of the rows that may be theirs."""
        if not self.nodes or not len(asked):
            return
        exact = self.most < EXACT
        rows, kind = (self.rows, np.float64) if exact else (self.rows.astype(np.int64), np.int64)
        who, at = np.unique(places.anchor[asked], return_inverse=True)
        mine = anchors[who].astype(kind)
        inner = [i for i, n in enumerate(self.nodes) if n[2] >= 0]
        leaves = [i for i, n in enumerate(self.nodes) if n[2] < 0]
        vantage = np.array([self.nodes[i][0] for i in inner], np.int64)
        scores = mine @ rows[vantage].T
        tops, bottoms = self._reach(inner, (mine.astype(np.float64) ** 2).sum(1), scores.astype(np.float64))

        def meet(some: np.ndarray, own: np.ndarray, found: np.ndarray | None = None) -> None:
            """Questions (numbers in asked) with the rows at `own`."""
            q = asked[some]
            if found is None:
                each, back = np.unique(at[some], return_inverse=True)
                found = (mine[each] @ rows[own].T)[back]
            fit = (found >= places.low[q, None]) & (found <= places.high[q, None])
            fit &= fits(places.anchor[q], self.order[own])
            k = places.scores.shape[1]
            full = np.flatnonzero(np.count_nonzero(fit, axis=1) > k)
            if len(full):  # of many rows, only those that can be among the first
                kept = np.where(fit[full], found[full], NONE)
                fit[full] &= kept >= np.partition(kept, len(own) - k, axis=1)[:, len(own) - k, None]
            i, j = np.nonzero(fit)
            places.add(q[i], found[i, j], ids[self.order[own[j]]])

        every = np.arange(len(asked))
        if inner:
            meet(every, vantage, scores[at])
        top, bottom = tops[leaves][:, at], bottoms[leaves][:, at]
        left = (top >= places.low[asked]) & (bottom <= places.high[asked])
        best = np.where(left, np.minimum(top, places.high[asked]), -np.inf).argmax(0)
        first = left[best, every]
        left[best, every] = False
        for turn in (0, 1):
            for n, leaf in enumerate(leaves):
                some = first & (best == n) if turn == 0 else left[n]
                some = np.flatnonzero(some & (top[n] >= places.low[asked]))
                if len(some):
                    meet(some, np.arange(*self.nodes[leaf][:2]))

    def _reach(self, inner: list[int], squares: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and the lowest score that each node's rows can have, by node and anchor; scores: anchors with vantage rows."""
        total = squares + self.most
        slack = 1e-9 * total + 1.0
        tops, bottoms = np.full((len(self.nodes), len(squares)), np.inf), np.full((len(self.nodes), len(squares)), -np.inf)
        for i, own in zip(inner, scores.T, strict=True):
            _, _, near, far, *reach = self.nodes[i]
            d = np.sqrt(np.maximum(total - 2 * own, 0))
            for child, (least, most) in ((near, reach[:2]), (far, reach[2:])):
                close, away = np.maximum(np.maximum(d - most, least - d), 0), d + most
                tops[child] = np.minimum(tops[i], (total - close * close) / 2 + slack)
                bottoms[child] = np.maximum(bottoms[i], (total - away * away) / 2 - slack)
        return tops, bottoms


def _dealer(sample: np.ndarray, most: float, leaves: int) -> list[tuple]:
    """Nodes (vantage row or None, cut distance, near, far, leaf number) of a shallow tree over the sample."""
    nodes: list = []
    random = np.random.default_rng(7)

    def grow(own: np.ndarray, wanted: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if wanted <= 1 or len(own) < 4:
            nodes[at] = (None, 0.0, -1, -1, sum(n is not None and n[0] is None for n in nodes))
            return at
        v = own[random.integers(len(own))]
        rows = np.concatenate([sample[v : v + 1], sample[own]])
        d = _distances(rows, (rows**2).sum(1), 0, most)[1:]
        cut = float(np.median(d))
        near = grow(own[d <= cut], wanted // 2)
        far = grow(own[d > cut], wanted - wanted // 2)
        nodes[at] = (sample[v], cut, near, far, -1)
        return at

    grow(np.arange(len(sample)), leaves)
    return nodes


def _leaves(nodes: list[tuple], rows: np.ndarray, most: float) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    todo = [(0, np.arange(len(rows)))]
    while todo:
        at, own = todo.pop()
        v, cut, near, far, leaf = nodes[at]
        if not len(own):
            continue
        if v is None:
            out[own] = leaf
            continue
        both = np.concatenate([v[None, :], rows[own]])
        d = _distances(both, (both**2).sum(1), 0, most)[1:]
        todo += [(near, own[d <= cut]), (far, own[d > cut])]
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def scaled(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """Rows (id, label, vec) that take part, with integer components."""
    vec = F.col(f"`{vec_col}`")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.alias("label"), F.when(finite, F.transform(vec, lambda x: F.floor(scale * x.cast("double")))).alias("vec"))
    return own.where("id is not null and label is not null and vec is not null")


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    n_positives: int = 5,
    k: int = 5,
    low: int = 80,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all but rank long.

    anchors: a condition on a row's id, the column `id`; label: the label of a row, the column `label` if not given.
    """
    spark = rows.sparkSession
    own = scaled(rows, id_col, vec_col, F.col("label") if label is None else label)
    places = Window.partitionBy("label", "vec").orderBy("id")
    pool = staged(own.withColumn("nth", F.row_number().over(places)).where(F.col("nth") <= max(n_positives + 1, k)).drop("nth").withColumn("dim", F.size("vec")), "negatives-pool")
    asked = staged(own.where(anchors).distinct().withColumn("dim", F.size("vec")), "negatives-anchors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    out = spark.createDataFrame([], schema)
    sizes = {r.dim: r for r in pool.groupBy("dim").agg(F.max(square).alias("most"), F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    for dim, size in sizes.items():
        if size.most >= MOST:
            raise ValueError(f"vectors of length {dim} with a squared norm of {size.most:.3g} after scaling: scores would not fit 62 bits")
        shards = _dealt(pool.where(F.col("dim") == dim).drop("dim"), dim, size.n, size.most)
        asked_here = asked.where(F.col("dim") == dim).drop("dim")
        blocks = max(1, -(-asked_here.count() * 8 * max(dim, 1) // ANCHOR_BYTES))
        for block in range(blocks):
            some = asked_here.where(F.pmod(F.xxhash64("id", "label", "vec"), F.lit(blocks)) == block)
            out = out.unionByName(_mine(shards, some, dim, size.most, n_positives, k, low))
    return out


def _dealt(pool: DataFrame, dim: int, n: int, most: float) -> DataFrame:
    """Rows (shard, id, label, vec), staged."""
    leaves = int(min(MOST_LEAVES, max(1, n // SHARD_ROWS)))
    sample = _matrix(pool.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).select("vec").toArrow().column("vec"), dim).astype(np.float64)
    nodes = pool.sparkSession.sparkContext.broadcast(_dealer(sample, most, leaves))  # MOST_LEAVES rows at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = _leaves(nodes.value, _matrix(batch.column("vec"), dim).astype(np.float64), most)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])

    small_batches(pool)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields)
    rows = staged(pool.mapInArrow(deal, f"leaf bigint, {kinds}"), "negatives-leaves")
    parts = F.broadcast(rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("parts")))  # a row a leaf
    shard = F.xxhash64("leaf", F.pmod(F.xxhash64("id", "vec"), "parts"))
    return rows.join(parts, "leaf").select(shard.alias("shard"), "id", "label", "vec")


def _mine(shards: DataFrame, anchors: DataFrame, dim: int, most: float, n_positives: int, k: int, low: int) -> DataFrame:
    """The result for a block of anchors."""
    spark = shards.sparkSession
    asked = anchors.orderBy("id", "label").toArrow()  # ANCHOR_BYTES of vectors at most, or thereabouts
    ids, vecs = asked.column("id").to_numpy(), _matrix(asked.column("vec"), dim)
    names = {x: i for i, x in enumerate(sorted(set(asked.column("label").to_pylist())))}
    labels = np.array([names[x] for x in asked.column("label").to_pylist()], np.int64)
    sent = spark.sparkContext.broadcast((ids, vecs, labels, names))

    def each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[VantageTree, np.ndarray, np.ndarray]]:
        for table in _tables(batches):
            own = np.array([sent.value[3].get(x, -1) for x in table.column("label").to_pylist()], np.int64)
            yield VantageTree(_matrix(table.column("vec"), dim), most), table.column("id").to_numpy(), own

    def filled(batches: Iterator[pa.RecordBatch], places: Places, same: bool) -> Places:
        """Places of all questions after the task's shards: by rows of the anchor's label without the anchor's id, or of other labels."""
        ids, vecs, labels, _ = sent.value
        for tree, own_ids, own_labels in each_shard(batches):
            like = lambda anchors, rows: own_labels[rows] == labels[anchors, None]  # noqa: B023, E731
            fits = (lambda anchors, rows: like(anchors, rows) & (own_ids[rows] != ids[anchors, None])) if same else (lambda anchors, rows: ~like(anchors, rows))  # noqa: B023, E731
            for at in range(0, len(places.anchor), TOGETHER):
                tree.fill(places, np.arange(at, min(at + TOGETHER, len(places.anchor))), vecs, fits, own_ids)
        return places

    kind = np.float64 if most < EXACT else np.int64

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(sent.value[0])
        got = filled(batches, Places(n_positives, np.arange(n), np.full(n, NONE + 1), np.full(n, -NONE), kind), True)
        i, j = np.nonzero(got.scores > NONE)
        yield from _out(("anchor", "score", "id"), (i, got.scores[i, j], got.ids[i, j]))

    ranked = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))))
    dealt = shards.repartition(max(buckets(spark), 1), "shard").sortWithinPartitions("shard")
    small_batches(dealt)
    first = ranked(dealt.mapInArrow(positives, "anchor bigint, score bigint, id bigint"), "anchor").where(F.col("nth") <= n_positives)
    first = staged(first, "negatives-positives")
    pairs = first.orderBy("anchor", "nth").toArrow()  # n_positives for each anchor of the block at most
    # annuli that hold anything: low * p <= 100 n <= 100 p
    asked_of = [(a, nth, max(-(-low * p // 100), NONE + 1), p) for a, nth, p in zip(*(pairs.column(c).to_pylist() for c in ("anchor", "nth", "score")), strict=True) if low * p <= 100 * p]
    sent_windows = spark.sparkContext.broadcast(np.array(asked_of, np.int64).reshape(-1, 4))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, positive, least, high = sent_windows.value.T
        got = filled(batches, Places(k, anchor, least, high, kind), False)
        i, j = np.nonzero(got.scores > NONE)
        yield from _out(("anchor", "positive", "score", "id"), (anchor[i], positive[i], got.scores[i, j], got.ids[i, j]))

    second = ranked(dealt.mapInArrow(negatives, "anchor bigint, positive bigint, score bigint, id bigint"), "anchor", "positive").where(F.col("nth") <= k)
    own = first.select("anchor", F.col("nth").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchor_ids = F.broadcast(spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(ids))), "anchor_id": pa.array(ids, pa.int64())})))
    joined = second.join(own, ["anchor", "positive"]).join(anchor_ids, "anchor")
    return joined.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard."""
    held, last = [], None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and shard[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = shard[a]
    if held:
        yield pa.Table.from_batches(held)
    trim()


def _out(names: tuple[str, ...], columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000].astype(np.int64)) for c in columns], list(names))
