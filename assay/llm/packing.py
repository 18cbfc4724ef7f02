"""Best-fit packing by patterns: which documents share a training sequence.

1. The histogram of piece lengths (at most `capacity` bins, so of bounded size) goes to the
   driver. Patterns are one to FEW pieces that fill a sequence exactly.
2. Repeat counts are fitted to the histogram by non-negative least squares: min |A x - have|, x >= 0,
   with a column for each pattern. Columns are generated, not listed: in turn each length that the
   fit leaves over is priced against the residual (the fit's dual), the pattern that lowers the
   error most enters or grows by the step that is best along it, and patterns that now cover too much
   shrink. So few patterns have a count, at most some for each length, and the counts survive
   rounding; a pattern never uses more pieces of a length than there are.
3. What is left is packed best-fit decreasing, by classes of equal bins rather than piece by
   piece, so its cost doesn't follow the number of documents.
4. The plan says for each length which ranks go where: (length, first rank, first sequence,
   offset). Its size is bounded by patterns and lengths, not by documents. Pieces get ranks
   within their length by salted counting, so a length that holds a third of all pieces is
   still spread over all tasks.

Defined results: null text counts as empty (its document is the closing id alone); a very long text
is cut into pieces like others; bytes that are not valid UTF-8 are read as Spark's make_valid_utf8
gives them; ids may be of any type; repeated rows are packed as documents of their own; a null
doc_id stays null; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.bpe import encode_with
from assay.llm.common import buckets, named, staged
from assay.sources.staging import collecting, release

FEW = 4
ROUNDS = 60


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens: id, piece, start, length, ids_crc32, block, row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(owner_ids: pa.Array, block: int, row: int, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(counts)
        full = np.insert(ids, ends, np.uint32(closing)).astype("<u4")
        raw = memoryview(full.tobytes())
        total = counts + 1
        firsts = np.cumsum(total) - total
        n = -(-total // capacity)
        owner = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, total[owner] - start)
        at = firsts[owner] + start
        crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
        return pa.RecordBatch.from_pydict(
            {
                "id": owner_ids.take(pa.array(owner)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "block": pa.array(np.full(len(owner), block)),
                "row": pa.array(owner + row, pa.int64()),
            }
        )

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, row bigint"
    return encode_with(docs, path, finish, schema, id_col, text_col)


def _priced(first: int, left: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """The pattern with a piece of length `first` that lowers the squared error most, of lengths with something left."""
    rest = capacity - first
    if not rest:
        return (first,)
    price = np.where(left > 0.5, left, -np.inf)
    best, found = 0.0, None

    def offer(members: tuple[int, ...]) -> None:
        nonlocal best, found
        times = {x: members.count(x) for x in members}
        gain = sum(k * price[x] for x, k in times.items())
        if gain > 0 and all(left[x] >= k for x, k in times.items()) and gain**2 / sum(k * k for k in times.values()) > best:
            best, found = gain**2 / sum(k * k for k in times.values()), members

    def pair(total: int) -> tuple[int, int] | None:
        if total < 2:
            return None
        half = price[1:total] + price[total - 1 : 0 : -1]
        at = int(half[: total // 2].argmax())
        return (at + 1, total - at - 1) if half[at] > -np.inf else None

    offer((first, rest))
    if got := pair(rest):
        offer((first, *got))
    if FEW > 3 and rest > 3:
        for third in np.argsort(price[1 : rest - 1])[-3:].tolist():  # its best price, then the best pair beside it
            if price[third + 1] > 0 and (got := pair(rest - third - 1)):
                offer((first, third + 1, *got))
    return found


def fit(have: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, whole repeat count): a non-negative least-squares fit by coordinates, rounded within `have`."""
    left = have.astype(float)
    left[0] = 0
    x: dict[tuple[int, ...], float] = {}
    shape: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, int]] = {}

    def move(p: tuple[int, ...], least: float) -> float:
        """Along one pattern to the least error, but not below `least` by itself."""
        at, times, square = shape[p]
        step = max(float(left[at] @ times) / square, least)
        x[p] = x.get(p, 0.0) + step
        left[at] -= step * times
        return abs(step)

    for _ in range(rounds):
        moved = 0.0
        for p in [p for p, n in x.items() if n > 0]:
            moved += move(p, -x[p])
        for first in range(capacity, 0, -1):
            if left[first] > 0.5 and (p := _priced(first, left, capacity)):
                p = tuple(sorted(p, reverse=True))
                if p not in shape:
                    at, times = np.unique(p, return_counts=True)
                    shape[p] = at, times, int((times**2).sum())
                moved += move(p, 0.0)
        if moved < 1 + 1e-4 * have.sum():
            break
    rest, out = have.copy(), []
    for p, n in sorted(x.items(), key=lambda e: (-e[1], e[0])):
        at, times, _ = shape[p]
        whole = int(min(np.floor(n + 0.5), (rest[at] // times).min()))
        if whole > 0:
            rest[at] -= whole * times
            out.append((p, whole))
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for what is left, longest first.

    Bins of equal room and content are one class, so a length costs as many steps as it meets classes.
    """
    rooms: dict[int, list[list]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = min(capacity // length, n)
                rooms.setdefault(capacity - each * length, []).append([(length,) * each, n // each])
                n -= each * (n // each)
                continue
            classes = rooms[room]
            content, count = classes.pop()
            take = min(n, count)
            if count > take:
                classes.append([content, count - take])
            if not classes:
                del rooms[room]
            rooms.setdefault(room - length, []).append([(*content, length), take])
            n -= take
    return [(tuple(c), k) for classes in rooms.values() for c, k in classes]


def plan(have: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, count), by length and rank."""
    groups = fit(have, capacity)
    left = have.copy()
    for p, k in groups:
        for x in p:
            left[x] -= k
    groups += best_fit(left, capacity)
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for p, k in groups:
        offset = 0
        for x in p:
            rows.append((x, int(rank[x]), sequence, offset, k))
            rank[x] += k
            offset += x
        sequence += k
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (as cut_pieces gives them, staged) with sequence_id long and offset long."""
    spark = pieces.sparkSession
    n = buckets(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("block", "row", "piece"), F.lit(n)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    have = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        have[row.length] = row.n
    table = plan(have, capacity)
    wide = np.int64(1) << np.int64(44)
    starts = table[:, 0] * wide + table[:, 1]

    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("block", "row", "piece")) - 1
    ranked = salted.withColumn("local", local).join(base, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("base")).select(*pieces.columns, "rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(starts, length * wide + rank, side="right") - 1]
            columns = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=schema.names)

    return ranked.mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut, plan and place: id, piece, start, length, ids_crc32, sequence_id, offset."""
    with collecting() as paths:
        pieces = staged(cut_pieces(docs, path, capacity, closing, id_col, text_col), "pack-pieces")
    release(docs.sparkSession, paths[:-1])  # what the pieces were made of
    return named(pack(pieces, capacity).drop("block", "row"), "id", id_col)
