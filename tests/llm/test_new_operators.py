"""Reversible line dedup, ranked search and hard negatives against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import hardneg, linededup, search
from assay.llm.linededup import CuckooFilter, LineIndex, line_dedup

# ---- cuckoo filters and line dedup


def test_filter_holds_what_was_added_and_not_discarded():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    made = CuckooFilter.of(keys)
    assert made.holds(keys).all() and np.count_nonzero(made.table) == len(keys)
    others = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert made.holds(others).mean() < 0.001
    made.discard(keys[:15_000])
    assert made.holds(keys[15_000:]).all() and made.holds(keys[:15_000]).mean() < 0.001
    again = CuckooFilter.unpack(made.pack())
    assert again.add(keys[:15_000]) and again.holds(keys).all()
    again.discard(keys)
    assert not again.table.any()  # every fingerprint is gone, equal ones too


def test_full_filter_says_so():
    small = CuckooFilter(np.zeros((16, 4), np.uint16))
    assert not small.add(np.arange(100, dtype=np.uint64))
    assert CuckooFilter.of(np.zeros(0, np.uint64)).room() > 0


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, counted=None, min_docs=3, least=20):
    holders = defaultdict(set)
    for d, text in counted if counted is not None else rows:
        for line in (text or "").split("\n"):
            if d is not None and len(key_of(line)) >= least:
                holders[key_of(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key_of(x)]) >= min_docs and max(holders[key_of(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def some_docs(seed, n, first=0):
    rng = random.Random(seed)
    common = ["the same long line in many texts", "ANOTHER line that is Everywhere ", "\tünïcode line with twenty signs", "short", "exactly twenty signs"]
    docs = []
    for i in range(first, first + n):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"a line of its own, number {rng.randrange(40)}" for _ in range(rng.randrange(0, 7))]
        docs.append((i, "\n".join(x.upper() if rng.random() < 0.3 else x for x in lines)))
    return docs


def collected(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("filters", [True, False])
def test_lines_brute_force(spark, monkeypatch, filters):
    if not filters:
        monkeypatch.setattr(linededup, "FILTER_BYTES", -1)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    docs = [*some_docs(1, 60), (None, "the same long line in many texts\nmine alone, that nobody has"), (7, "exactly twenty signs\nexactly twenty signs"), (90, None), (91, ""), (92, "\n"), (93, "exactly twenty signs\n\nEXACTLY twenty signs\r")]
    assert collected(line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute_lines(docs)


def test_hot_lines_are_joined_by_broadcast(spark):
    docs = [(i, "a line that all of them hold, everywhere\n" + f"and one for {i // 4} alone, four times") for i in range(1200)]
    assert collected(line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute_lines(docs)


def test_inserting_and_deleting_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b, c = some_docs(2, 30), some_docs(3, 25, 30), some_docs(4, 20, 20)  # c's first ids are there already
    first = LineIndex.build(frame(a))
    both = first.insert(frame(b))
    assert collected(both.rewrite(frame(a + b))) == brute_lines(a + b)
    third = both.insert(frame(c))
    assert collected(third.rewrite(frame(c))) == brute_lines(c, a + b + c)
    back = both.delete(frame(b).select("doc_id"))
    for table in ("counts", "references"):
        rows = lambda i: sorted(tuple(r) for r in getattr(i, table).select(*sorted(getattr(i, table).columns)).collect())  # noqa: B023, E731
        assert rows(back) == rows(first)
    assert collected(back.rewrite(frame(a))) == brute_lines(a)
    size = lambda df: sum(np.count_nonzero(CuckooFilter.unpack(bytes(r.body)).table) for r in df.collect())
    assert size(back.seen) == back.counts.count() and size(back.common) == back.counts.where("docs >= 3").count()
    assert collected(first.delete(frame([(10**6, "")]).select("doc_id")).rewrite(frame(a))) == brute_lines(a)
    none = LineIndex.build(frame([]))
    assert collected(none.insert(frame(a)).rewrite(frame(a))) == brute_lines(a)
    assert none.rewrite(frame([])).collect() == []


def test_lines_of_other_ids_and_columns(spark):
    docs = some_docs(5, 20)
    df = spark.createDataFrame([(str(d), t, 1, 2) for d, t in docs], "id string, body string, hi int, places int")
    got = sorted((int(r.id), r.n_dropped, r.kept) for r in line_dedup(df, "id", "body").collect())
    want = [(int(d), n, k) for d, _, n, k in brute_lines([(str(d), t) for d, t in docs])]
    assert got == sorted(want)


# ---- search


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(x > 0 for _, _, x in held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for d, c, length in held:
            if d is None:
                continue
            m = 25 + 75 * length * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "délta", "x1", "the", "the", "of", "rare%d" % rng.randrange(30)]) for _ in range(n))


@pytest.mark.parametrize(("shard", "rows"), [(1 << 24, 200_000), (400, 7)])
def test_search_brute_force(spark, monkeypatch, shard, rows):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    monkeypatch.setattr(search, "QUERY_ROWS", rows)
    rng = random.Random(6)
    docs = [(i, words(rng, rng.randrange(1, 40))) for i in rng.sample(range(1000), 150)] + [(2000 + i, "the same copy rare1, again") for i in range(15)]
    docs += [(None, "rare1 rare2 alpha"), (3000, None), (3001, ""), (3002, "!?"), (5, "two rows rare3"), (5, "with one id rare3"), (3003, words(rng, 4000))]
    items = [(i, words(rng, rng.randrange(1, 12))) for i in range(12)] + [(50, "rare1 rare1 copy"), (51, None), (52, ""), (53, "unknown"), (None, "rare2 x1"), (54, "rare3"), (54, "rare4"), (50, "rare1 rare1 copy")]
    rng.shuffle(docs)
    got = search.ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=repr) == brute_search(docs, items)


def test_search_of_other_ids_and_empty_tables(spark):
    docs = [(f"d{i}", f"one two n{i % 3}", 0) for i in range(20)]
    frame = spark.createDataFrame(docs, "id string, body string, score int")
    items = spark.createDataFrame([("q", "n1 two", 5)], "item string, body string, rank int")
    got = search.ranked_search(frame, items, 4, "id", "body", "item").collect()
    assert [(r.item, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(i, r, d) for i, r, d, _ in sorted(brute_search([d[:2] for d in docs], [("q", "n1 two")], 4), key=lambda x: x[1])]
    assert search.ranked_search(frame.limit(0), items, 4, "id", "body", "item").collect() == []
    assert search.ranked_search(frame, items.limit(0), 4, "id", "body", "item").collect() == []


def test_postings_round_trip():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 1 << k, 50) for k in range(1, 50)])
    data, sizes = search.to_bytes(values)
    assert (search.from_bytes(data) == values).all() and sizes.sum() == len(data)


# ---- hard negatives


def brute_negatives(rows, anchor, n_positives=5, k=5, low=80):
    own = []
    for id_, label, vec in rows:
        if id_ is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        own.append((id_, label, tuple(math.floor(256 * x) for x in vec)))
    out = []
    for a in sorted({r for r in own if anchor(r[0])}):
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=True))  # noqa: B023, E731
        like = [r for r in own if len(r[2]) == len(a[2])]
        first = lambda rs: sorted((-score(r), r[0]) for r in rs)
        for p, positive in first([r for r in like if r[1] == a[1] and r[0] != a[0]])[:n_positives]:
            fit = [r for r in like if r[1] != a[1] and low * -p <= 100 * score(r) <= 100 * -p]
            out += [(a[0], positive, n, i, -p, -s) for n, (s, i) in enumerate(first(fit)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "anchors"), [(4096, 32 << 20), (40, 200)])
def test_negatives_brute_force(spark, monkeypatch, shard, anchors):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", shard)
    monkeypatch.setattr(hardneg, "LEAF", 8)
    monkeypatch.setattr(hardneg, "ANCHOR_BYTES", anchors)
    monkeypatch.setattr(hardneg.VantageTree.__init__, "__defaults__", (8, 0))
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 5)) * 0.3
    rows = []
    for i in range(400):
        v = (centre[rng.integers(6)] + rng.normal(size=5) * rng.choice([0.02, 0.2])).round(2).tolist()
        rows.append((i, int(rng.integers(4)), v))
    rows += [(1000 + i, i % 3, rows[10][2]) for i in range(60)] + [(1100 + i, 1, rows[10][2]) for i in range(40)]  # copies: ties
    rows += [(2000, None, [1.0] * 5), (2010, 1, None), (2020, 1, [float("nan")] * 5), (2030, 1, [None, 1.0, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 5), (2040, 1, [0.0] * 5), (2050, 1, [1.0, 2.0]), (2060, 2, [1.0, 2.0]), (2070, 1, [1.5, 2.0]), (20, 2, rows[20][2]), (30, 3, [0.1] * 5), (2080, 1, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    rows = [(i, y, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows]
    got = hardneg.hard_negatives(df, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_empty_and_lone_rows(spark):
    empty = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>, rank int")
    assert hardneg.hard_negatives(empty, F.col("id") % 10 == 0).collect() == []
    lone = spark.createDataFrame([(0, 1, [1.0])], "vec_id bigint, label int, embedding array<float>")
    assert hardneg.hard_negatives(lone, F.col("id") % 10 == 0).collect() == []
    with pytest.raises(ValueError, match="62 bits"):
        hardneg.hard_negatives(spark.createDataFrame([(0, 1, [1e9] * 3)], "vec_id bigint, label int, embedding array<float>"), F.col("id") % 10 == 0)


def test_annuli_open_few_nodes():
    """Rows come out nearest first, and a narrow annulus leaves most of a clustered tree closed."""
    rng = np.random.default_rng(4)
    rows = (rng.normal(size=(40, 1, 6)) * 4000 + rng.normal(size=(40, 50, 6)) * 40).reshape(-1, 6).round().astype(np.int64)
    most = float((rows**2).sum(1).max())
    tree = hardneg.VantageTree(rows, most, 16)
    q, ids = rows[77], np.arange(len(rows))
    score = rows @ q
    low = int(np.sort(score)[-40])
    got = list(tree.nearest_first(q, ids, np.ones(len(rows), bool), low, np.inf))
    assert [(s, i) for s, i, _ in got] == sorted(((int(s), i) for i, s in enumerate(score) if s >= low), key=lambda x: (-x[0], x[1]))
