"""Bounded work and methods: skipped payloads, splits, patterns, very long texts, brute-force models."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.llm import chosenpath, langid, lm, packing, pii, rules, suffixes, warc
from tests.llm.test_text_operators import brute_repeats, docs


class Bytes:
    """A file in memory, with the reads that a store's file has."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]

    def size(self):
        return len(self.data)


def archive(n=40, size=200_000):
    rng = random.Random(4)
    payload = ["".join(rng.choice("abcdefgh <>") for _ in range(size)) for _ in range(n)]
    record = lambda i, kind: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {size}\r\n\r\n{payload[i]}\r\n\r\n".encode()
    return payload, [warc.gzip_member(record(i, "response" if i % 10 else "resource")) for i in range(n)]


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    payload, members = archive()
    raw = Bytes(b"".join(members))
    made = []
    new = warc.Member.__init__

    def watched(self, *args):
        new(self, *args)
        made.append(self)

    monkeypatch.setattr(warc.Member, "__init__", watched)
    got = list(warc.read_members(raw, 0, raw.size(), raw.size(), {"warc_type": {"resource"}}))
    assert [r["payload"].decode() for r in got] == payload[::10]
    assert sum(m.inflated for m in made) < 5 * 200_000  # four payloads and the heads of all
    made.clear()
    heads = list(warc.read_members(raw, 0, raw.size(), raw.size(), {}, payload=False))
    assert len(heads) == 40 and sum(m.inflated for m in made) < 40 * 20_000


def test_splits_meet_each_record_once():
    _, members = archive(30, 3000)
    raw = Bytes(b"".join(members))
    offsets = np.cumsum([0, *map(len, members)])[:-1].tolist()
    for step in (700, 5000, 1 << 20):
        got = [r["record_offset"] for a in range(0, raw.size(), step) for r in warc.read_members(raw, a, a + step, raw.size(), {})]
        assert got == offsets


def test_patterns_place_most_pieces():
    rng = np.random.default_rng(2)
    have = np.bincount(np.clip(rng.lognormal(5, 1, 1100).astype(int), 1, 2048), minlength=2049)
    groups = packing.fit(have, 2048)
    used = np.zeros(2049, np.int64)
    for pattern, times in groups:
        assert sum(pattern) == 2048 and len(pattern) <= packing.FEW
        np.add.at(used, list(pattern), times)
    assert (used <= have).all()
    table = packing.plan(have, 2048)
    sequences = int((table[:, 2] + table[:, 4]).max())
    bound = math.ceil((have * np.arange(2049)).sum() / 2048)
    assert sequences <= bound * 1.02 + 1
    # where a few pieces fill a sequence, patterns place most of them, at any size
    for times in (1, 1000):
        mid = np.bincount(rng.integers(200, 1500, 1100), minlength=2049) * times
        assert sum(len(p) * n for p, n in packing.fit(mid, 2048)) > 0.5 * mid.sum()


def test_long_repeats_take_little():
    """Two documents that share a long run of one byte: a block each, few entries, all of the second marked."""
    n = 3 << 20
    table = pa.table({"rank": pa.array([5]), "text": pa.array(["a" * n])})
    texts = suffixes.Texts(table)
    keys = np.unique(np.concatenate([run.anchors()[1] for run in texts.runs()]))
    rows, least, state = suffixes.block_entries(texts, keys, 8)
    assert len(rows) < 200 and sum(map(len, state)) < 1 << 20
    edges = suffixes.removed(texts, state, np.full(len(least), 1, np.int64), np.zeros(len(rows), np.int64))
    assert edges[0].tolist() == [0, n]


def test_passages_across_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_BYTES", 64)
    rng = random.Random(3)
    shared = "".join(rng.choice("abc ") for _ in range(400))
    texts = [shared, "x" * 70 + shared[100:300] + "y" * 200 + shared[350:], shared[:60] + "zzz" * 60 + shared[20:90], "é" * 90, "é" * 40 + "b"]
    got = {r.doc_id: r.dedup for r in suffixes.remove_repeats(docs(spark, texts)).collect()}
    for i, want in brute_repeats(list(enumerate(texts))).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want


def test_passages_with_ids_of_text(spark):
    t = "this is one long passage that certainly has more than fifty bytes in it"
    d = spark.createDataFrame([("b", t), ("a", t), (None, t)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.dedup.n_removed) for r in suffixes.remove_repeats(d).collect()) == [("", len(t)), ("a", 0), ("b", len(t))]


def test_language_is_naive_bayes(spark):
    """Probabilities equal a plain computation over all n-grams, hashed the same way."""
    texts = ["the tree and the stone", "der Baum und der Stein", "the stone", "und der Baum", "stone Baum"]
    langs = ["en", "de", "en", "de", None]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, *langid.train(d)).collect()}
    grams = [[int(g) for part in langid._grams([t])[0] for g in part] for t in texts]
    counts = {x: Counter(g for own, k in zip(grams, langs, strict=True) if k == x for g in own) for x in ("de", "en")}
    for i, own in enumerate(grams):
        logs = []
        for x in ("de", "en"):
            total = sum(counts[x].values())
            logs.append(math.log(0.5) + sum(math.log((counts[x][g] + langid.ALPHA) / (total + langid.ALPHA * langid.BUCKETS)) for g in own))
        p = [math.exp(v - max(logs)) for v in logs]
        best = int(np.argmax(p))
        assert got[i][0] == ("de", "en")[best] and got[i][1] == pytest.approx(p[best] / sum(p), abs=1e-4)


def test_em_finds_the_best_weights():
    """The learned mixture is no worse on the held-out cells than any on a grid."""
    rng = np.random.default_rng(0)
    cells = np.stack([np.zeros(30, np.int64), rng.integers(0, 300, 30), rng.integers(1, 300, 30)], 1)
    times = rng.integers(1, 50, 30).astype(float)
    w = lm.em_weights(cells, times, 400)[0]
    p = np.stack([lm._ratio(cells[:, 1]), lm._ratio(cells[:, 2]), np.ones(30)], 1)
    own = float(times @ np.log(p @ w))
    grid = [(a / 20, b / 20, 1 - (a + b) / 20) for a in range(21) for b in range(21 - a)]
    assert own >= max(float(times @ np.log(np.maximum(p @ np.array(g), 1e-300))) for g in grid) - 0.02 * abs(own)
    assert w.sum() == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    got = lm.lm_scores(docs(spark, ["a b", ""]), F.lit(False), F.lit(False)).collect()
    assert all(r.score == pytest.approx(0) and r.train_tokens == 0 for r in got)


def test_large_groups_reach_the_recall(spark):
    """At the production recall, links within groups of far more than LIMIT sets that share few words too often to tell them apart."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(300):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    want = np.zeros(len(texts), int)
    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                want[i] += 1
                want[j] += 1
    got = {r.doc_id: r.n_links for r in chosenpath.jaccard_join(docs(spark, texts)).collect()}
    found = np.array([got[i] for i in range(len(texts))])
    assert (found <= want).all() and found.sum() >= chosenpath.RECALL * want.sum()


def test_names_share_their_parts(spark):
    texts = ["Mr. Smith and John Smith and Smith met. John left; Smith's dog stayed.", " ".join(f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"), "Dr. Wei Zhang; Zhang said"]
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs(spark, texts), "k").collect()}
    words = got[0].replace(".", "").replace(";", "").split()
    assert words[1] == words[4] == words[6] and words[3] == words[8] and words[10] == words[1] + "'s" and "Smith" not in got[0] and "John" not in got[0]
    made = got[1].split()
    assert len(set(made)) == 26 and all(len(m.split("@")[0]) == 1 for m in made)
    assert "Zhang" not in got[2] and "Wei" not in got[2]


@pytest.mark.parametrize("text", ["mail x@" + "a." * 400_000 + "com", "John " + "A-" * 400_000 + "b", "password=" + "a" * 800_000, "sk-" + "_" * 800_000, "+1" * 400_000, "1.2." * 200_000])
def test_patterns_stand_long_texts(spark, text):
    got = pii.pseudonymise(docs(spark, [text, "a"]), "k").collect()
    assert len(got) == 2


def test_rules_read_any_bytes_and_ids(spark):
    d = spark.sql("SELECT 'x' AS doc_id, cast(X'61FF0A62' AS string) AS text, 'h' AS source")
    r = rules.quality_rules(d).first()
    assert r.doc_id == "x" and r.rules.n_words == 2
