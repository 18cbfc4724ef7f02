"""Block dictionaries: corpus-wide lookups without a row for each word occurrence.

`spread` reads the documents once. What it finds goes to the shared folder as rows (block, slot,
body): for each block of documents one packed list of its distinct keys for each key bucket
(slots below n), and the documents themselves as packed pieces that refer to those keys by number
(slots from n). `answered` sends the lists to their buckets, where each distinct key of the corpus is
resolved once; `gathered` brings the answers to the pieces. So the shuffles carry each distinct
key once a block (a map-side combine), a key that holds a third of all rows is still one entry a
block, and no text is read or split twice. Nothing is broadcast or collected.

Sizes: the number of buckets and of meeting places follows the input's size, one a BUCKET_BYTES of
it and never fewer than the session's shuffle partitions, so that what a task holds doesn't grow with the
corpus. A meeting task holds one block's answers at a time: its rows are sorted by block and slot,
the answers come first, and the pieces behind them are streamed.

A block is named by its task and a running number. The rows are written before anything refers to
them, so a task that is run again elsewhere can't give other names. Where disk is dearer than a
second scan, `spread_again` makes the lists and the pieces from a scan each and writes neither; the scans' partitions are held
fast (`fixed`), so that executors that come or go between them move no row to another block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import buckets, mix64, staged

BLOCK_BYTES = 16 << 20
PIECE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Bytes of words that are hashed at a time: numbers take some 50 times their bytes meanwhile.
HASH_BYTES = 256 << 10
ROWS = "block bigint, slot int, body binary"
#: A size that a plan's statistics give when they know nothing.
UNKNOWN = 1 << 56


def zip_bytes(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unzip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def join_parts(parts: list[bytes]) -> bytes:
    """Byte strings as one, behind their number and lengths."""
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def split_parts(data: bytes) -> list[memoryview]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int64, n, 8)) + 8 * (n + 1)
    view = memoryview(data)
    return [view[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def zip_ints(x: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte position, so that zero bytes lie together; the first byte says how many positions."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T
    used = max([k + 1 for k in range(4) if planes[k].any()], default=0)
    return bytes([used]) + np.int64([len(x)]).tobytes() + zip_bytes(np.ascontiguousarray(planes[:used]).tobytes())


def unzip_ints(data: bytes) -> np.ndarray:
    used, n = data[0], int(np.frombuffer(data, np.int64, 1, 1)[0])
    planes = np.frombuffer(unzip_bytes(data[9:]), np.uint8).reshape(used, n) if used else np.zeros((0, n), np.uint8)
    out = np.zeros((n, 4), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u4").ravel()


def zip_words(words: pa.Array) -> bytes:
    """An Arrow array of byte strings without nulls."""
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    data = b"" if words.buffers()[2] is None else bytes(memoryview(words.buffers()[2])[int(offsets[0]) : int(offsets[-1])])
    return join_parts([zip_ints(np.diff(offsets)), zip_bytes(data)])


def unzip_words(body: bytes) -> pa.Array:
    lengths, data = split_parts(body)
    offsets = np.concatenate([[0], np.cumsum(unzip_ints(lengths))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(unzip_bytes(data))])


def pack_table(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def stable(df: DataFrame, label: str) -> DataFrame:
    """df itself if it is a narrow plan over files, which can be read more than once, else a staged copy."""
    return df if is_scan(df) else staged(df, label)


def fixed(df: DataFrame) -> DataFrame:
    """df over the partitions that its scan has now.

    Each time Spark plans a scan it deals the files out by the cores that are there then; executors that come or go
    between two scans would move rows from one task's blocks to another's. A data set made of an RDD keeps the RDD's partitions:
    their files and offsets are set here, once, and a lost task reads the same rows again. Texts pass as bytes,
    as they stand."""
    spark, text = df.sparkSession, [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    rows = df.select([F.col(f"`{c}`").cast("binary").alias(c) if c in text else F.col(f"`{c}`") for c in df.columns])
    rdd = rows._jdf.rdd()
    rdd.getNumPartitions()  # deals them out
    held = type(df)(spark._jsparkSession.createDataFrame(rdd, rows._jdf.schema()), spark)
    return held.select([F.col(f"`{c}`").cast("string").alias(c) if c in text else F.col(f"`{c}`") for c in df.columns])


def is_scan(df: DataFrame) -> bool:
    """Whether df is a plan over files or rows at hand that needs no shuffle and stands for itself."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(line.lstrip(" :+-*").startswith(("Project", "Filter", "Relation", "LocalRelation", "Union")) for line in plan.splitlines() if line.strip())


def places(df: DataFrame) -> int:
    """Number of buckets and of meeting places: one a BUCKET_BYTES of a scan, one a shuffle partition at least."""
    least = buckets(df.sparkSession)
    if not is_scan(df):
        return least
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= UNKNOWN else max(least, -(-size // BUCKET_BYTES))


def cut_tables(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES, text: str = "text") -> Iterator[pa.Table]:
    """Whole rows, cut after about `size` bytes of text."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + size - have)) + 1)
            held.append(batch.slice(at, stop - at))
            have += int(ends[stop - 1]) - before
            at = stop
            if have >= size:
                yield pa.Table.from_batches(held)
                held, have = [], 0
    if held:
        yield pa.Table.from_batches(held)


def texts_of(table: pa.Table, column: str = "text") -> list[bytes]:
    """Texts as bytes, a null one empty."""
    return [x or b"" for x in table.column(column).cast(pa.binary()).to_pylist()]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words between ASCII white space one after another, their number in each text); a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.values, lists.offsets.to_numpy()
    flat = flat.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if len(offsets) else flat
    word = pc.binary_length(flat).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(word)])
    counts = np.diff(before[offsets - offsets[0]]) if len(offsets) > 1 else np.zeros(0, np.int64)
    return (flat if word.all() else flat.filter(pa.array(word))), counts


def word_runs(words: pa.Array) -> Iterator[pa.Array]:
    """Byte strings one after another, in runs of about HASH_BYTES; a longer string is a run of its own."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    at = 0
    while at < len(words):
        stop = min(max(int(np.searchsorted(offsets, int(offsets[at]) + HASH_BYTES, side="right")) - 1, at + 1), at + HASH_BYTES, len(words))
        yield words.slice(at, stop - at)
        at = stop


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each byte string: the sum of a mixed number for each (byte, position), mixed with the length."""
    return np.concatenate([np.zeros(0, np.uint64), *map(_run_hashes, word_runs(words.cast(pa.binary())))])


def _run_hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) if offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
    offsets -= offsets[0]
    lengths = np.diff(offsets)
    place = (np.arange(len(data)) - np.repeat(offsets[:-1], lengths)).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = mix64(data + (place << np.uint64(8)) + np.uint64(0x632BE59BD9B4E019))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        return mix64(sums[offsets[1:]] - sums[offsets[:-1]] + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, the number of each value's place among them), by hashing before sorting."""
    coded = pa.array(values).dictionary_encode()
    keys = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.arange(len(keys), dtype=np.int32)
    return keys[order], rank[coded.indices.to_numpy()]


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def small_batches(df: DataFrame) -> None:
    """Arrow batches of a few MB: both sides hold a batch as a whole, outside Spark's memory accounts.

    The setting is read when a plan runs, and plans are run by their users; so it stays in the session.
    A smaller one of the session's own is left alone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    had = conf.get(key, None)
    if had is None or not had.isdigit() or int(had) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, slot, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(slot, pa.int32()), pa.array(body, pa.binary())], ["block", "slot", "body"])


def batches_of(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about a megabyte."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size > 1 << 20:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def block_name(number: int) -> int:
    """Name of a task's block."""
    task = TaskContext.get()
    return (task.partitionId() if task else 0) << 32 | number


def spread(docs: DataFrame, send: Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple[int, int, bytes]]], n: int, label: str) -> DataFrame:
    """ROWS of what send(batches of a task, n) gives: (number of the block in the task, slot, body), staged."""
    return staged(spread_again(docs, send, n), label, packed=True)


def spread_again(docs: DataFrame, send: Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple[int, int, bytes]]], n: int) -> DataFrame:
    """The same, not staged: for lists and pieces from a scan each. docs must be `fixed`: the same rows in the same tasks each time."""
    small_batches(docs)

    def run(batches):
        yield from batches_of((block_name(k), slot, body) for k, slot, body in send(batches, n))
        trim()

    return docs.mapInArrow(run, ROWS)


def answered(sent: DataFrame, resolve: Callable[[list[bytes]], Iterator[bytes]], n: int, fine: int = 1) -> DataFrame:
    """ROWS: for each list that a block sent, what its bucket answers.

    resolve gets all packed lists of a bucket and gives the answers in the same order. There are
    n * fine buckets; a task resolves `fine` of them, one after another.
    """
    small_batches(sent)

    def run(batches):
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for block, slot, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(slot, []).append((block, body))
        for slot in sorted(held):
            got = held.pop(slot)
            yield from batches_of((block, slot, body) for (block, _), body in zip(got, resolve([body for _, body in got]), strict=True))
            trim()

    return sent.where(F.col("slot") < n * fine).repartitionById(n, F.floor(F.col("slot") / fine).cast("int")).mapInArrow(run, ROWS)


def gathered(sent: DataFrame, answers: DataFrame, apply: Callable[[int, dict[int, bytes], Iterator[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema, n: int, fine: int = 1) -> DataFrame:
    """apply(block, its answers by slot, its pieces (slot, body) in order) for each block; slots below n * fine are answers."""
    small_batches(sent)

    def run(batches):
        rows = ((b, s, body) for batch in batches for b, s, body in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            block, answer = row[0], {}
            while row is not None and row[0] == block and row[1] < n * fine:
                answer[row[1]] = row[2]
                row = next(rows, None)

            def pieces():
                nonlocal row
                while row is not None and row[0] == block:
                    yield row[1], row[2]
                    row = next(rows, None)

            own = pieces()
            yield from apply(block, answer, own)
            for _ in own:  # pieces that apply had no need of
                pass
            trim()

    rows = sent.where(F.col("slot") >= n * fine).unionByName(answers)
    return rows.repartition(n, F.col("block")).sortWithinPartitions("block", "slot").mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """work on each group of equal long keys; many small groups share a task and a batch.

    Unlike a grouped map there is no call into Python and no Arrow stream for each group.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last: tuple | None = None
        out: dict[str, list] = {n: [] for n in names}
        size = 0

        def put(got: dict[str, np.ndarray] | None) -> int:
            if got is None:
                return 0
            for n in names:
                out[n].append(got[n])
            return len(got[names[0]])

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(v)) for n, v in out.items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            key = np.stack([batch.column(k).to_numpy() for k in keys], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(key[a].tolist())
                if this != last and held:
                    size += put(work(pa.concat_tables(held) if len(held) > 1 else held[0]))
                    held = []
                    if size > 20_000:
                        yield made()
                        out, size = {n: [] for n in names}, 0
                held.append(whole.slice(a, b - a))
                last = this
        if held:
            size += put(work(pa.concat_tables(held)))
        if size:
            yield made()
        trim()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of counts[i] values."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]

