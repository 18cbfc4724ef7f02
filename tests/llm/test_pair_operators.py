"""Near-duplicates, set joins, components, WARC and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import chosenpath, components, neardup, warc


def union(n, pairs):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = union(461, pairs)
    assert all(got.get(i, i) == want[i] for i in range(461))
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


@pytest.mark.parametrize(("limit", "chunk"), [(64, 1024), (3, 4)])
def test_chosen_path_brute_force(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(chosenpath, "LIMIT", limit)
    monkeypatch.setattr(chosenpath, "CHUNK", chunk)
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    base = [[word() for _ in range(rng.randrange(60, 120))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            t = list(b)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(300)) for _ in range(10)]
    texts += [texts[0], texts[0], "one two", "one two", "One  two", "solo", "", None, None]
    sets = brute_sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    n = np.bincount([x for p in links for x in p], minlength=len(texts))
    d = spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, node string, leaf int")
    got = {r.doc_id: r for r in chosenpath.jaccard_join(d, recall=0.9999).collect()}
    assert [got[i].n_links for i in range(len(texts))] == n.tolist()
    assert [got[i].class_id for i in range(len(texts))] == union(len(texts), links)


def test_chosen_path_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_links, r.class_id or -1) for r in chosenpath.jaccard_join(d).collect())
    assert got == [(-1, 0, -1), (-1, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert chosenpath.jaccard_join(d.limit(0)).collect() == []


def test_runs_reach_the_recall():
    assert chosenpath.runs_for(0.8, 0.99) >= 4 and chosenpath.runs_for(0.8, 0.999) > chosenpath.runs_for(0.8, 0.9)


def vectors(seed=1, groups=25, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        c = rng.normal(size=dim)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 12))):
            rows.append((label, (c + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32)))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = vectors()
    rows += [(1, rows[0][1]), (1, rows[0][1] * 2), (None, rows[0][1])]
    data = [(i, [float(v) for v in x], label, "n", 7) for i, (label, x) in enumerate(rows)]
    data += [(1000, None, 1, "n", 7), (1001, [0.0] * 32, 1, "n", 7), (1002, [float("nan")] + [1.0] * 31, 1, "n", 7), (1003, [], 1, "n", 7), (1004, [None] + [1.0] * 31, 1, "n", 7)]
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int, node string, weight int")
    got = {r.vec_id: r for r in neardup.near_duplicates(d).collect()}
    x = np.stack([v for _, v in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [k for k, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if label[i] is not None and label[i] == label[j] and x[i] @ x[j] >= 0.93]
    n = np.bincount([k for p in links for k in p], minlength=len(rows))
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found >= 0.99 * n.sum() and all(got[i].n_links <= n[i] for i in range(len(rows)))
    comp = union(len(rows), links)
    assert np.mean([got[i].component_id == comp[i] for i in range(len(rows))]) > 0.98
    for i in range(1000, 1005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicates_edges(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 1)], "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(d).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (4, 0, 4, True)]
    assert neardup.near_duplicates(d.limit(0)).collect() == []


HTML = ["<p>été</p>", "", None, "<p>été</p>", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb", "", "x"]


def test_warc_round_trip(spark):
    rows = [(i + 1, f"http://h/{i}\r\nX: y", t, "v") for i, t in enumerate(HTML)] + [(None, None, "x", "v"), (9, None, "only", "v"), (9, None, "only", "v")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        r = by[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        holders = [k for k, _, u, _ in rows if (u or "") == (t or "") and k is not None]
        first = min(holders)
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        if i == first:
            assert bytes(r.payload) == raw
    large = {r.page_id: r.record_type for r in warc.round_trip(pages, least=5).collect()}
    assert large[7] == "response" and large[None] == "response" and large[4] == "revisit"
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_predicates_are_pushed_down(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://c", "y")], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    df = warc.read_warc(spark, path).where((F.col("warc_type") == "response") & F.col("target_uri").isin("http://a", "http://b"))
    assert [r.target_uri for r in df.collect()] == ["http://a"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "= response" not in plan and "http://a" not in plan  # the source took both
    assert {r.payload for r in warc.read_warc(spark, path, payload=False).collect()} == {None}


def test_warc_reads_folded_headers_gzip_and_other_types(tmp_path):
    body = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\nX-Fold: a\r\n b\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    got = list(warc.read_records(io.BytesIO(body), {}))
    assert [(r["warc_type"], r["payload"]) for r in got] == [("warcinfo", b"abc"), ("resource", b"hi")]
    assert [r["payload"] for r in warc.read_records(io.BytesIO(body), {"warc_type": {"resource"}})] == [b"hi"]
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.read_records(io.BytesIO(b"junk\r\n"), {}))


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = cp.rules(spark, docs, sf)
    assert kept.columns == docs.columns
    rest = cp.near_duplicates(spark, kept, sf)
    assert rest.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    sets = dict(zip(sorted(ids), brute_sets([texts[i] for i in sorted(ids)]), strict=True))
    left = sorted(r.doc_id for r in rest.collect())
    for k, i in enumerate(left):
        for j in left[:k]:
            assert len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
    out = cp.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(left)
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
