"""Suffix-array deduplication of passages: sparse, front-coded, merged by loser trees.

Marked are the bytes covered by a LENGTH-byte string that also starts in a document with a smaller id.

1. Anchors: the positions whose KMER-byte hash is least in some window of LENGTH bytes. Equal
   windows choose equal anchors, so every repeated window is seen through one; about 7 % of positions
   are anchors. Blocks exchange their distinct anchor hashes; only those in two or more distinct
   texts stay.
2. At each such anchor the suffix (its first LENGTH bytes, then the bytes before the anchor, read
   backwards) is an entry of a sparse suffix array. A block sorts its entries, merges equal ones
   (smallest id), and sends each bucket a front-coded run: the common prefix with the
   entry before, then the rest.
3. A bucket merges the runs with a loser tree that keeps common prefix lengths: entries whose known
   prefixes differ in length are ordered by that alone, others are compared behind the known
   prefix. The prefixes between neighbours come out with the order. For each of the windows
   around an anchor, runs of neighbours with a long enough prefix before and behind the anchor are its
   occurrences; each entry gets a bit for each window that a smaller id has too.
4. The bits go back to the blocks and mark the bytes. Texts are exact bytes throughout.

A block sends an entry once however many of its documents hold it, so a passage in a third of all
documents is one entry a block. Within a block anchors are worked on in runs of RUN_BYTES, into which
long texts are cut with overlaps; equal entries are merged run by run, and what is kept of a position
is packed. So a text of many millions of one byte, each of which is an anchor, needs little more than itself.

Defined results: a null text is empty; texts below LENGTH bytes lose nothing; a very long text is a
block of its own; bytes that are not valid UTF-8 are bytes like others; ids that are no integers
are compared in Spark's order of their type; a null id counts as larger than every id, and not
as smaller than another null; rows with equal ids don't remove from each other; an empty table
gives an empty table; columns of any name pass through (keep).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.blocks import ROWS, answered, batches_of, cut_tables, fixed, gathered, join_parts, pack_table, places, split_parts, spread_again, stable, texts_of, unpack_table, unzip_bytes, unzip_ints, zip_bytes, zip_ints
from assay.llm.common import mix64, staged
from assay.llm.lm import _cuts, _squeeze, _unsqueeze
from assay.sources.staging import release

LENGTH, KMER = 50, 24
WINDOWS = LENGTH - KMER + 1
BEFORE = LENGTH - KMER
#: bucket (HEAD bytes, big-endian), suffix, its length + 1, bytes before it backwards, their number + 1
HEAD = 4
ENTRY = HEAD + LENGTH + 1 + BEFORE + 1
SUFFIX_END = LENGTH + 1
NEVER = (1 << 63) - 1
RUN_BYTES = 256 << 10
SLICE = 8192
BLOCK_BYTES = 8 << 20
#: Buckets of entries for each bucket of anchors: a task merges one after another.
FINE = 4


def kmer_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes from each position, by doubling (8 + 8 + 8)."""
    with np.errstate(over="ignore"):
        h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for step, m in ((1, 0x100000001B3), (2, 0x9E3779B185EBCA87), (4, 0xC2B2AE3D27D4EB4F)):
            h = h[:-step] * np.uint64(m) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        h = h[:-16] * np.uint64(0xFF51AFD7ED558CCD) + (h[8:-8] ^ (h[8:-8] >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53) + h[16:]
    return mix64(h)


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of each w neighbours, by doubling."""
    k, n = 1, len(x) - w + 1
    while 2 * k <= w:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[:n], x[w - k : w - k + n]) if k < w else x[:n]


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the anchors of texts that lie one after another in b.

    A key is the hash mixed once more: the least of some hashes are small, and buckets are ranges of keys."""
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = kmer_hashes(b)
    least = _slide(h, WINDOWS, np.minimum)
    start = np.arange(len(least))
    inside = start + LENGTH <= ends[np.searchsorted(ends, start, side="right")]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(WINDOWS - 1, np.uint64)
    high = _slide(np.concatenate([pad, least, pad]), WINDOWS, np.maximum)
    at = np.flatnonzero((high == h) & (high > 0))
    return at, mix64(h[at])


class Run(NamedTuple):
    """Texts one after another, or a slice of one text; the anchors from `low` to `high` belong to it."""

    first: int  # number of the first text
    skipped: int  # bytes of it before this slice
    bytes: np.ndarray
    ends: np.ndarray
    low: int
    high: int

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at, h = anchors(self.bytes, self.ends)
        own = slice(*np.searchsorted(at, [self.low, self.high]))
        return at[own], h[own]


class Texts:
    """Distinct texts of a block with the smallest id of each, and what each row has to do with it."""

    def __init__(self, table: pa.Table):
        self.all = texts_of(table)
        rank = table.column("rank").fill_null(NEVER).to_pylist()
        least: dict[bytes, int] = {}
        for text, r in zip(self.all, rank, strict=True):
            least[text] = min(least.get(text, NEVER), r)
        self.texts = list(least)
        self.ids = np.fromiter(least.values(), np.int64, len(least))
        number = {t: i for i, t in enumerate(self.texts)}
        self.row_text = [number[t] for t in self.all]
        self.row_later = [r > least[t] for t, r in zip(self.all, rank, strict=True)]

    def runs(self) -> Iterator[Run]:
        """About RUN_BYTES each; a slice overlaps its neighbours by what a window around its anchors needs."""

        def made() -> Run:
            return Run(first, 0, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), 0, size)

        first, size, held = 0, 0, []
        for i, t in enumerate(self.texts):
            if len(t) > 2 * RUN_BYTES:
                if held:
                    yield made()
                for a in range(0, len(t), RUN_BYTES):
                    begin, stop = max(0, a - BEFORE), min(len(t), a + RUN_BYTES + LENGTH)
                    yield Run(i, begin, np.frombuffer(t, np.uint8, stop - begin, begin), np.array([stop - begin]), a - begin, min(a + RUN_BYTES, len(t)) - begin)
                first, size, held = i + 1, 0, []
                continue
            held.append(t)
            size += len(t)
            if size >= RUN_BYTES:
                yield made()
                first, size, held = i + 1, 0, []
        if held:
            yield made()


def _anchor_keys(texts: Texts, n: int) -> Iterator[tuple[int, bytes]]:
    """Distinct anchor hashes for each bucket, each with a bit: whether two or more of the block's texts have it."""
    keys, owners = [], []
    for run in texts.runs():
        at, h = run.anchors()
        owner = np.searchsorted(run.ends, at, side="right") + run.first
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        keys.append(h[new])
        owners.append(owner[new])
    h, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, owners))
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    key = h[at]
    many = np.maximum.reduceat(owner, at) > owner[at] if len(at) else np.zeros(0, bool)
    cuts = _cuts(key, n)
    for bucket in range(n):
        a, b = cuts[bucket], cuts[bucket + 1]
        if b > a:
            yield bucket, zip_bytes(np.packbits(many[a:b]).tobytes() + _squeeze(key[a:b]))


def _shared_anchors(lists: list[bytes]) -> Iterator[bytes]:
    """For each list those of its keys that are in two or more distinct texts."""
    parsed = []
    for body in lists:
        raw = unzip_bytes(body)
        n = (len(raw) * 8) // 65
        parsed.append((_unsqueeze(raw[len(raw) - 8 * n :]), np.unpackbits(np.frombuffer(raw, np.uint8, len(raw) - 8 * n))[:n].astype(bool)))
    every = np.sort(np.concatenate([k for k, _ in parsed] + [k[f] for k, f in parsed]))
    twice = np.zeros(len(every), bool)
    twice[1:] = every[1:] == every[:-1]
    shared = every[twice]
    del every, twice
    for k, _ in parsed:
        at = np.searchsorted(shared, k)
        at[at == len(shared)] = 0
        yield zip_bytes(_squeeze(k[shared[at] == k] if len(shared) else k[:0]))


def _merged(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct entries, the number of each row's)."""
    order = np.argsort(rows.view(f"S{ENTRY}").ravel(), kind="stable")
    sorted_ = rows[order]
    new = np.ones(len(order), bool)
    whole = sorted_.view(f"S{ENTRY}").ravel()  # an entry's last byte is never 0, so they compare whole
    new[1:] = whole[1:] != whole[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return sorted_[new], of


def _cut_entries(run: Run, at: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The entry of each anchor."""
    owner = np.searchsorted(run.ends, at, side="right")
    end, start = run.ends[owner], (run.ends - np.diff(run.ends, prepend=0))[owner]
    span, left = np.minimum(end - at, LENGTH), np.minimum(at - start, BEFORE)
    entry = np.zeros((len(at), ENTRY), np.uint8)
    entry[:, :HEAD] = home.astype(">u4").view(np.uint8).reshape(-1, HEAD)
    low, high = int(at[0]) - BEFORE, int(at[-1]) + LENGTH
    part = np.concatenate([np.zeros(max(0, -low), np.uint8), run.bytes[max(0, low) : high], np.zeros(max(0, high - len(run.bytes)), np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(part, BEFORE + LENGTH)[at - at[0]]
    entry[:, HEAD : HEAD + LENGTH] = around[:, BEFORE:] * (np.arange(LENGTH) < span[:, None])
    entry[:, HEAD + LENGTH] = span + 1
    entry[:, HEAD + LENGTH + 1 : -1] = around[:, BEFORE - 1 :: -1][:, :BEFORE] * (np.arange(1, BEFORE + 1) <= left[:, None])
    entry[:, -1] = left + 1
    return entry


def block_entries(texts: Texts, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(sorted distinct entries of a block at the anchors `key`, the smallest id of each, for each run its packed anchors and their entries)."""
    home = np.searchsorted(_cuts(key, n)[1:-1], np.arange(len(key)), side="right")
    held, leasts, packed = [], [], []
    for run in texts.runs():
        at, h = run.anchors()
        k = np.searchsorted(key, h)
        k[k == len(key)] = 0
        ok = key[k] == h if len(key) else np.zeros(len(h), bool)
        at, k = at[ok], k[ok]
        parts = [_merged(_cut_entries(run, at[i : i + SLICE], home[k[i : i + SLICE]])) for i in range(0, len(at), SLICE)]
        if parts:
            sizes = np.cumsum([0, *(len(d) for d, _ in parts)])
            rows, to = _merged(np.concatenate([d for d, _ in parts]))
            of = np.concatenate([to[o + s] for (_, o), s in zip(parts, sizes[:-1].tolist(), strict=True)])
        else:
            rows, of = np.zeros((0, ENTRY), np.uint8), np.zeros(0, np.int64)
        least = np.full(len(rows), NEVER, np.int64)
        np.minimum.at(least, of, texts.ids[np.searchsorted(run.ends, at, side="right") + run.first])
        held.append(rows)
        leasts.append(least)
        packed.append((zip_ints(np.diff(at, prepend=0)), zip_ints(of)))
    if not held:
        return np.zeros((0, ENTRY), np.uint8), np.zeros(0, np.int64), []
    sizes = np.cumsum([0, *map(len, held)])
    every = np.concatenate(held)
    held.clear()
    rows, of = _merged(every)
    del every
    least = np.full(len(rows), NEVER, np.int64)
    np.minimum.at(least, of, np.concatenate(leasts))
    state = [join_parts([a, b, zip_ints(of[s:e])]) for (a, b), s, e in zip(packed, sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
    return rows, least, state


def removed(texts: Texts, state: list[bytes], least: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """For each distinct text of a block the edges (start, end, start, ...) of its marked bytes."""
    owners, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for run, body in zip(texts.runs(), state, strict=True):
        at, of, to = (unzip_ints(x).astype(np.int64) for x in split_parts(body))
        if not len(at):
            continue
        at, of = np.cumsum(at), to[of]
        owner = np.searchsorted(run.ends, at, side="right")
        text_start = run.ends - np.diff(run.ends, prepend=0)
        span, left = np.minimum(run.ends[owner] - at, LENGTH), np.minimum(at - text_start[owner], BEFORE)
        valid = (1 << (left + 1)) - (1 << np.minimum(LENGTH - span, left + 1))
        hit = np.where(texts.ids[owner + run.first] > least[of], valid, bits[of])
        start = np.zeros(len(run.bytes) + 1, bool)
        for a in range(WINDOWS):
            start[at[(hit >> a) & 1 > 0] - a] = True
        at = np.flatnonzero(start)
        if not len(at):
            continue
        owner = np.searchsorted(run.ends, at, side="right")
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + LENGTH)
        last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
        shift = run.skipped - text_start[owner[new]]
        owners.append(owner[new] + run.first)
        starts.append(at[new] + shift)
        ends.append(at[last] + LENGTH + shift)
    owner, start, end = (np.concatenate(x) for x in (owners, starts, ends))
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if len(owner):  # slices of a long text meet
        wide = np.int64(1) << 40
        reach = np.maximum.accumulate(owner * wide + end)
        new = np.ones(len(owner), bool)
        new[1:] = (owner * wide + start)[1:] > reach[:-1]
        first = np.flatnonzero(new)
        end = reach[np.append(first[1:] - 1, len(owner) - 1)] - owner[first] * wide
        owner, start = owner[first], start[first]
    cuts = np.searchsorted(owner, np.arange(len(texts.texts) + 1))
    return [np.stack([start[a:b], end[a:b]], 1).ravel() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def front_code(sorted_: np.ndarray, ids: np.ndarray) -> bytes:
    """A run: number, common prefix with the entry before, ids, and what follows the prefixes."""
    common = np.zeros(len(sorted_), np.uint8)
    if len(sorted_) > 1:
        common[1:] = (sorted_[1:] != sorted_[:-1]).argmax(1)
    rest = sorted_[np.arange(sorted_.shape[1]) >= common[:, None]]
    return zip_bytes(np.int64([len(sorted_)]).tobytes() + ids.astype(np.int64).tobytes() + common.tobytes() + rest.tobytes())


def read_run(body: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    """(entries without the bucket, common prefixes, ids) of a front-coded run."""
    raw = unzip_bytes(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.frombuffer(raw, np.int64, n, 8)
    common = raw[8 + 8 * n : 8 + 9 * n]
    at, last, out = 8 + 9 * n, b"", []
    for c in common:
        end = at + ENTRY - c
        last = last[:c] + raw[at:end]
        at = end
        out.append(last)
    return out, list(common), ids


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Loser-tree merge: (run, position in it, common prefix with the entry before) of each entry in order.

    Each contestant carries its common prefix with the last winner. The longer prefix wins without
    a look at the strings; equal prefixes are compared behind them only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    end = b"\xff" * (ENTRY + 1)
    heads = [r[0][0] if r[0] else end for r in runs] + [end] * (k - len(runs))
    known = [0] * k
    place = [0] * k
    tree = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        if heads[x] == heads[y]:
            known[y] = len(heads[y])
        else:
            if heads[y] < heads[x]:
                x, y = y, x
            a, b = heads[x], heads[y]
            known[y] = ENTRY - (((int.from_bytes(a[:ENTRY], "big") ^ int.from_bytes(b[:ENTRY], "big")).bit_length() + 7) >> 3)
        tree[node] = y
        return x

    winner = play(1)
    prefix = 0
    which, where, common = [], [], []
    left = sum(len(r[0]) for r in runs)
    while left:
        left -= 1
        which.append(winner)
        where.append(place[winner])
        common.append(prefix)
        place[winner] += 1
        entries, prefixes = runs[winner]
        if place[winner] < len(entries):
            heads[winner] = entries[place[winner]]
            prefix = prefixes[place[winner]]
        else:
            heads[winner] = end
            prefix = 0
        # the new head knows its prefix with its predecessor, the last winner, as all losers on the path do
        node = (winner + k) >> 1
        while node:
            y = tree[node]
            other = known[y]
            if other > prefix:
                tree[node], known[winner], winner, prefix = winner, prefix, y, other
            elif other == prefix:
                a, b = heads[winner], heads[y]
                if a is end or b is end:
                    if b is not end:
                        tree[node], known[winner], winner = winner, 0, y
                    else:
                        known[y] = 0
                else:
                    ra, rb = a[prefix:], b[prefix:]
                    if ra == rb:
                        known[y] = ENTRY
                    else:
                        same = prefix + len(ra) - (((int.from_bytes(ra, "big") ^ int.from_bytes(rb, "big")).bit_length() + 7) >> 3)
                        if rb < ra:
                            tree[node], known[winner], winner = winner, same, y
                        else:
                            known[y] = same
            node >>= 1
    return which, where, common


def _window_bits(bodies: list[bytes]) -> Iterator[bytes]:
    """For each run a number for each entry: bit a is set if a smaller id has the window a bytes before the anchor."""
    runs = [read_run(b) for b in bodies]
    which, where, common = merge_runs([(e, c) for e, c, _ in runs])
    n = len(which)
    sizes = np.array([len(e) for e, _, _ in runs], np.int64)
    base = np.cumsum(sizes) - sizes
    source = base[np.array(which, np.int64)] + np.array(where, np.int64)
    ids = np.concatenate([i for _, _, i in runs])[source]
    flat = np.frombuffer(b"".join([e for entries, _, _ in runs for e in entries]), np.uint8).reshape(n, ENTRY)
    del runs, which, where
    entry = flat[source, HEAD:]
    del flat
    forward = np.minimum(np.array(common, np.int64) - HEAD, LENGTH)
    span, left = entry[:, LENGTH].astype(np.int64) - 1, entry[:, -1].astype(np.int64) - 1
    before = np.ascontiguousarray(entry[:, SUFFIX_END:])
    order = np.argsort(before.view(f"S{BEFORE + 1}").ravel(), kind="stable")
    behind = np.zeros(n, np.int64)
    behind[1:] = np.where((before[order[1:]] != before[order[:-1]]).any(1), (before[order[1:]] != before[order[:-1]]).argmax(1), BEFORE + 1)
    bits = np.zeros(n, np.int64)
    for a in range(WINDOWS):
        ok = np.flatnonzero((left >= a) & (span >= LENGTH - a))
        if len(ok) < 2:
            continue
        right = np.cumsum(forward < LENGTH - a)
        back = np.empty(n, np.int64)
        back[order] = np.cumsum(behind < a)
        key = (right[ok] << 32) | back[ok]
        by = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[by], prepend=-1))
        least = np.minimum.reduceat(ids[ok[by]], cut)
        least = np.repeat(least, np.diff(np.append(cut, len(by))))
        later = ok[by[least < ids[ok[by]]]]
        bits[later] |= 1 << a
    out = np.zeros(n, np.uint32)
    out[source] = bits
    for b, s in zip(base, sizes, strict=True):
        yield zip_ints(out[b : b + s])


def _ranks(docs: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, rank): a number for each id, in Spark's order of ids of any type."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct().sort("id")
    return staged(ids.withColumn("rank", F.monotonically_increasing_id()), "suffix-ranks")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: str = "dedup") -> DataFrame:
    """Per row of docs: the columns of keep (the id, if not given), and under one struct (`into`):

    n_bytes, n_removed, n_spans long, kept binary (the bytes that stay), starts, ends array<bigint>
    (the removed runs).
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c != text_col]
    columns = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]]
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        rows = docs.select(*columns).withColumn("rank", F.col("id").cast("bigint")).drop("id")
    else:
        rows = staged(docs.select(*columns).join(_ranks(docs, id_col), "id", "left").drop("id"), "suffix-docs")
    n = places(rows)
    fields = [(f"keep{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    lists = T.ArrayType(T.LongType())
    made = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()), ("starts", lists), ("ends", lists)]
    schema = T.StructType([T.StructField(k, t) for k, t in [*fields, *made]])

    def lists(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
        for block, table in enumerate(cut_tables(batches, BLOCK_BYTES)):
            yield from ((block, slot, body) for slot, body in _anchor_keys(Texts(table), n))

    def texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
        for block, table in enumerate(cut_tables(batches, BLOCK_BYTES)):
            yield block, n, pack_table(table)

    def entries(block: int, answer: dict[int, bytes], pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([_unsqueeze(unzip_bytes(answer[s])) for s in sorted(answer)] or [np.zeros(0, np.uint64)])

        def sent():
            for _, body in pieces:
                rows, least, state = block_entries(Texts(unpack_table(body)), key, n * FINE)
                bucket = np.ascontiguousarray(rows[:, :HEAD]).view(">u4").ravel().astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)][: len(cuts)], strict=True):  # none where nothing is shared
                    yield block, int(bucket[a]), front_code(rows[a:b], least[a:b])
                yield block, n * FINE + 1, join_parts([zip_bytes(least.tobytes()), *state])

        yield from batches_of(sent())

    def mark(block: int, answer: dict[int, bytes], pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        bits = np.concatenate([unzip_ints(answer[s]) for s in sorted(answer)] or [np.zeros(0, np.uint32)]).astype(np.int64)
        table = None
        for slot, body in pieces:
            if slot == n * FINE:
                table = unpack_table(body)
                continue
            least, *state = split_parts(body)
            own = Texts(table)
            verdict = removed(own, state, np.frombuffer(unzip_bytes(least), np.int64), bits)
            for first in range(0, len(own.all), 512):
                out: dict[str, list] = {k: [] for k, _ in made}
                for i in range(first, min(first + 512, len(own.all))):
                    text = own.all[i]
                    edges = np.array([0, len(text)]) if own.row_later[i] and len(text) >= LENGTH else verdict[own.row_text[i]]
                    starts, ends = edges[::2].tolist(), edges[1::2].tolist()
                    kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)) if starts else text
                    for k, v in zip(out, (len(text), len(text) - len(kept), len(starts), kept, starts, ends), strict=True):
                        out[k].append(v)
                kinds = {"kept": pa.binary(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
                columns = [table.column(k).slice(first, 512).combine_chunks() for k, _ in fields] + [pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # lists, and twice texts, from a scan each: no text is written down between; texts come first, so tasks name their blocks alike
    rows = fixed(stable(rows, "suffix-docs"))
    shared = answered(spread_again(rows, lists, n), _shared_anchors, n)
    runs = staged(gathered(spread_again(rows, texts, n), shared, entries, ROWS, n), "suffix-entries", packed=True)
    del shared
    release(docs.sparkSession, [])  # the shuffles of the first half are of no more use
    again = spread_again(rows, texts, n * FINE).unionByName(runs)
    got = gathered(again, answered(runs, _window_bits, n, FINE), mark, schema, n, FINE)
    return got.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], F.struct(*[k for k, _ in made]).alias(into))
