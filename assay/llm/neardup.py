"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Equal vectors of one label are one node (a group of copies, however large, is one row).
2. On a bounded sample (SAMPLE vectors with the smallest hashes) rotations are learned that make
   the signs of the projected vectors balanced binary codes (PCA, then ITQ). Any sample gives
   right links; a poor one only makes buckets uneven.
3. The code is cut into `tables` substrings of `bits` bits; nodes that agree in label and one substring meet
   in a bucket. bits follows the number of nodes of the largest label; tables follows from the
   share of bits that differ between vectors at the threshold, so that such a pair meets with
   probability RECALL; closer pairs meet more surely. The share is the worst of three: partners of
   the sample by noise in all directions, by noise in the coded axes alone (where not all are
   coded), and the sample's own pairs just over the threshold, if it has enough.
   A node's substrings are computed once and travel with it: where a pair first meets is read off them.
4. A bucket is a group of at most CHUNK nodes, larger ones are split into pairs of chunks. There
   the original vectors are compared in double precision, and a pair counts in the first table
   where it meets, so only sums per node and a spanning star leave the group, never pairs. Many small
   groups share a batch.

Vectors of each length have a model of their own, fitted one after another: lengths are few in practice, and
neither they nor the bits of a substring are capped (below 2^40 nodes of a label).

Defined results: very long vectors take memory for a batch of CHUNK of them; vectors that are null, empty, zero or hold null or non-finite components, and
those without a label, link with nothing; neither do vectors of different lengths. A null vec_id is
never a component's id unless the component has no other (then null); rows that repeat a vec_id
count as vectors of their own. An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.blocks import by_group, small_batches
from assay.llm.common import named, staged
from assay.llm.components import components, stars

SAMPLE, RECALL, CHUNK, ITERATIONS, MOST_BITS = 20_000, 0.995, 1024, 25, 128
PROBES, LEAST_PAIRS, MOST_PAIRS = 500, 100, 50_000


def learn_rotation(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors: principal axes, turned until signs lose least."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    k = min(x.shape[1], MOST_BITS)
    axes = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], -1))[1][:, ::-1][:, :k]
    turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
    v = (x - mean) @ axes
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def signs(x: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([(x - mean) @ p >= 0 for mean, p in rotations], 1)


def substrings(x: np.ndarray, model: dict) -> np.ndarray:
    """Tables x nodes: the substrings of the codes as integers."""
    bits, tables = model["bits"], model["tables"]
    code = signs(x, model["rotations"])[:, : bits * tables].reshape(len(x), tables, bits)
    return (code @ (1 << np.arange(bits, dtype=np.int64))).T


def fit_model(sample: np.ndarray, nodes: int, threshold: float) -> dict:
    """bits, tables and rotations for unit vectors of one length."""
    bits = int(np.clip(np.ceil(np.log2(max(nodes, 2))), 6, 40))
    if len(sample) < 2:
        sample = np.concatenate([sample, np.eye(sample.shape[1])])
    first = learn_rotation(sample, 0)
    rng = np.random.default_rng(1)
    aside = rng.normal(size=sample.shape)
    aside -= (aside * sample).sum(1, keepdims=True) * sample
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    pair = threshold * sample + np.sqrt(1 - threshold**2) * aside
    differ = float((signs(sample, [first]) != signs(pair, [first])).mean())
    if first[1].shape[1] < sample.shape[1]:  # real differences may lie in the coded axes alone
        aside = rng.normal(size=(len(sample), first[1].shape[1])) @ first[1].T
        aside -= (aside * sample).sum(1, keepdims=True) * sample
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        pair = threshold * sample + np.sqrt(1 - threshold**2) * aside
        differ = max(differ, float((signs(sample, [first]) != signs(pair, [first])).mean()))
    alike = sample[:PROBES] @ sample.T
    i, j = np.nonzero((alike >= threshold) & (alike < threshold + 0.2 * (1 - threshold)))
    if len(i) >= LEAST_PAIRS:
        at = slice(None, None, len(i) // MOST_PAIRS + 1)
        code = signs(sample, [first])
        differ = max(differ, float((code[i[at]] != code[j[at]]).mean()))
    meet = (1 - min(differ + 0.01, 0.45)) ** bits
    tables = int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet)))
    width = first[1].shape[1]
    rotations = [first] + [learn_rotation(sample, seed) for seed in range(1, -(-bits * tables // width))]
    return {"bits": bits, "tables": tables, "rotations": rotations}


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links long (other vectors within the threshold), component_id, kept."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)), F.xxhash64("label", "vec")))
    nodes = staged(rows.where("node is not null").groupBy("node").agg(F.min("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")), "itq-nodes").withColumn("dim", F.size("vec"))
    largest = {r.dim: r.n for r in nodes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).orderBy(F.desc("n")).collect()}  # a row a length
    models: dict[int, dict] = {}
    for dim, n in largest.items():
        got = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").toArrow()
        models[dim] = fit_model(_matrix(got.column("vec"), dim), n, threshold)
    model = spark.sparkContext.broadcast(models)  # a model a length, of MOST_BITS x dim x rotations numbers

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim")):
                own = batch.filter(pc.equal(batch.column("dim"), int(dim)))
                sub = np.ascontiguousarray(substrings(_matrix(own.column("vec"), int(dim)), model.value[int(dim)]).T)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sub) + 1, dtype=np.int32) * sub.shape[1]), pa.array(sub.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("node"), lists], ["node", "code"])

    small_batches(rows)
    codes = nodes.select("node", "dim", "vec").mapInArrow(coded, "node bigint, code array<bigint>")
    nodes = staged(nodes.join(codes, "node"), "itq-codes")

    light = nodes.select("node", F.xxhash64("label", "dim").alias("home"), F.posexplode("code").alias("t", "part")).select(F.xxhash64("home", "t", "part").alias("bucket"), "t", "node")
    busy = light.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / CHUNK).cast("int")
    met = light.join(busy, "bucket").withColumn("c", F.pmod(F.xxhash64("node", "bucket"), split).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), split - 1))).withColumn("gi", F.least("c", "o")).withColumn("gj", F.greatest("c", "o"))
    # labels travel as 64-bit hashes
    groups = met.join(nodes.select("node", F.xxhash64("label").alias("label"), "dim", "vec", "weight", "code"), "node").select("bucket", "t", "gi", "gj", "c", "node", "label", "dim", "vec", "weight", "code")

    def compare(group: pa.Table) -> dict[str, np.ndarray] | None:
        if group.num_rows < 2:
            return None
        out: dict[str, list] = {"node": [], "links": [], "root": []}
        # two buckets may share a key by chance: table, label and length must agree too
        t, label, dim, c = (group.column(k).to_numpy() for k in ("t", "label", "dim", "c"))
        apart = group.column("gi")[0].as_py() != group.column("gj")[0].as_py()
        for kind in np.unique(np.stack([t.astype(np.int64), dim.astype(np.int64)], 1), axis=0):
            own = np.flatnonzero((t == kind[0]) & (dim == kind[1]))
            part = group.take(own) if len(own) < group.num_rows else group
            x = _matrix(part.column("vec"), int(kind[1]))
            linked = (x @ x.T >= threshold) & (label[own][:, None] == label[own][None, :])
            if apart:
                linked &= c[own][:, None] != c[own][None, :]
            np.fill_diagonal(linked, False)
            if linked.any():
                flat = part.column("code").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
                linked &= flat[:, kind[0]][:, None] == flat[:, kind[0]][None, :]
                i, j = np.nonzero(linked)
                linked[i, j] = (flat[i, : kind[0]] != flat[j, : kind[0]]).all(1)
            at = np.flatnonzero(linked.any(1))
            if len(at):
                node, weight = part.column("node").to_numpy(), part.column("weight").to_numpy()
                out["node"].append(node[at])
                out["links"].append((linked[at] @ weight).astype(np.int64))
                out["root"].append(node[stars(linked)[at]])
        return {k: np.concatenate(v).astype(np.int64) for k, v in out.items()} if out["node"] else None

    found = staged(by_group(groups, ["bucket", "gi", "gj"], compare, "node bigint, links bigint, root bigint"), "itq-links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "weight", "least").join(roots, "node", "left").join(sums, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return named(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), "vec_id", id_col)
