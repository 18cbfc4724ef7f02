"""Brute force and worked values of operators that SQL can't express, and of those whose edges it doesn't reach."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.features import hashing, raw
from assay.functions import bytes as B
from assay.functions import display as D
from assay.functions import grading as G
from assay.functions import pickles as PK
from assay.functions import scalars as S
from assay.loaders import trees as L
from assay.operators import metrics as M
from assay.operators import windows as W
from assay.plans import modules as MO
from assay.sources import corpora as C
from assay.sources import records as RC


def test_murmur3_of_many_is_that_of_one():
    tokens = [b"", b"a", b"ab", b"abc", b"abcd", "é日本".encode(), b"x" * 37, b"KERNEL32.dll:" * 9]
    assert hashing.murmur3_many(tokens).tolist() == [B.murmur3_32(t) for t in tokens]
    assert hashing.murmur3_many([b"hello"]).tolist() == [0x248BFA47] and len(hashing.murmur3_many([])) == 0


def test_hashed_blocks_add_signs():
    got = hashing.hash_rows([[("a", 2.0), ("b", -1.0)], []], 8, pairs=True)
    want = np.zeros((2, 8))
    for token, w in (("a", 2.0), ("b", -1.0)):
        bucket, sign = hashing.hash_bucket(token, 8)
        want[0, bucket] += sign * w
    assert (got == want).all()
    assert hashing.hash_matrix([["a", "a"]], 8, signed=False).sum() == 2


def test_feature_hasher_is_the_sum_of_signs(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "kernel32.dll")]
    got = {(r.row_id, r.bucket): r.weight for r in B.hashed_features(spark.createDataFrame(rows, "row_id int, token string"), 8).collect()}
    want: dict = {}
    for i, t in rows:
        bucket, sign = hashing.hash_bucket(t, 8)
        want[i, bucket] = want.get((i, bucket), 0) + sign
    assert got == want


def test_module_seed(spark):
    import zlib

    df = spark.createDataFrame([(7, "drift"), (0, "x")], "seed bigint, module string")
    got = [r[0] for r in df.select(S.module_seed(F.col("seed"), F.col("module"))).collect()]
    assert got == [(7 * 1000003 + zlib.crc32(b"drift")) % 2**32, zlib.crc32(b"x")]


def test_durations_and_sizes(spark):
    df = spark.createDataFrame([(0.8,), (192.0,), (90000.0,), (42.4,), (7500.0,), (None,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(D.duration_text(F.col("s"))).collect()] == ["0.8s", "3m 12s", "1d 1h", "42s", "2h 5m", "—", "—"]
    df = spark.createDataFrame([(0.0,), (1536.0,), (float("nan"),)], "s double")
    assert [r[0] for r in df.select(D.bytes_text(F.col("s"))).collect()] == ["0 B", "1.5 KiB", "—"]
    df = spark.createDataFrame([(0.0123,), (1.0,), (0.0,)], "s double")
    assert [r[0] for r in df.select(D.percent_text(F.col("s"))).collect()] == ["1.23%", "100%", "0%"]


def test_file_names(spark):
    names = ["../../evil adapter.py", ".x", "", "a/b\\c.txt", "___", "x" * 500 + ".json"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.safe_file_name(F.col("n"))).collect()]
    assert got[:5] == ["evil_adapter.py", None, None, "c.txt", None] and len(got[5]) == 128 and got[5].endswith(".json")


@pytest.mark.parametrize(("cutoff", "step"), [("2024-01-30", "month"), ("2023-12-30", "month"), ("2023-11-29", "quarter"), ("2024-02-28", "year"), ("2024-01-14", "month"), ("2024-01-14", "week")])
def test_windows_are_chained_periods(spark, cutoff, step):
    """Every day is in the window that chained bounds say."""
    import calendar
    import datetime

    start = datetime.date.fromisoformat(cutoff) + datetime.timedelta(days=1)
    bounds = [start]
    while bounds[-1] < datetime.date(2030, 1, 1):
        d = bounds[-1]
        if step == "week":
            bounds.append(d + datetime.timedelta(days=7))
        else:
            m = d.year * 12 + d.month - 1 + W.STEPS[step]
            bounds.append(datetime.date(m // 12, m % 12 + 1, min(d.day, calendar.monthrange(m // 12, m % 12 + 1)[1])))
    days = spark.range(1200).select(F.date_add(F.lit(cutoff).cast("date"), F.col("id").cast("int") - 2).alias("day"))
    first, last = W.window_bounds(F.col("k"), cutoff, step)
    got = days.withColumn("k", W.window_number(F.col("day"), cutoff, step)).withColumns({"first": first, "last": last}).collect()
    for r in got:
        want = sum(b <= r.day for b in bounds) or None
        assert r.k == want
        if want and want < len(bounds):
            assert r.first == bounds[want - 1] and r.last == bounds[want] - datetime.timedelta(days=1)


def test_calibrated_threshold(spark):
    rows = lambda xs: spark.createDataFrame([(0, float(x)) for x in xs], "label int, score double")
    s = [i / 100 for i in range(100)]
    got = M.calibrated_threshold(rows(s), 0.05).first()
    assert got.threshold == np.nextafter(0.94, 1) and got.achieved == 0.05 and got.n == 100
    assert M.calibrated_threshold(rows([0.5, 0.6]), 1.0).first().threshold == 0
    assert M.calibrated_threshold(rows([0.3] * 10 + [0.9]), 0.5).first().achieved == pytest.approx(1 / 11)
    for bad, why in (([1.0] * 10, "no threshold"), ([0.5, float("nan")], "finite")):
        with pytest.raises(Exception, match=why):
            M.calibrated_threshold(rows(bad), 0.01).collect()


def test_quantile_cells_take_piled_scores(spark):
    """Running counts where nearly all scores are below every fixed cell's edge, and margins beyond [0, 1]."""
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.uniform(0, 1e-5, 3000), rng.normal(0, 30, 500)]).round(9)
    y = rng.integers(0, 2, len(s))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    got = {r.score: (r.tp, r.fp) for r in M.score_steps(df).collect()}
    for v in rng.choice(s, 200):
        assert got[float(v)] == (int((y[s >= v] == 1).sum()), int((y[s >= v] == 0).sum()))
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = int(y.sum())
    assert M.auroc(df).first().auroc == pytest.approx((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def test_bootstrap_is_that_of_drawn_rows(spark):
    """Its threshold and rates are spread as those of replicates that draw every row."""
    rng = np.random.default_rng(3)
    cal, ben, mal = rng.beta(2, 8, 400).round(4), rng.beta(2, 8, 900).round(4), rng.beta(6, 3, 700).round(4)
    frame = lambda *parts: spark.createDataFrame([(y, float(v)) for y, x in parts for v in x], "label int, score double")
    got = MO.threshold_bootstrap(frame((0, cal)), frame((0, ben), (1, mal)), 0.05, 0.06, 0.8, 1500).toPandas()
    k, want = int(0.05 * 400 + 1e-9), []
    for _ in range(1500):
        t = np.nextafter(np.sort(rng.choice(cal, 400))[::-1][k], 2)
        want.append((t, (rng.choice(ben, 900) >= t).mean(), (rng.choice(mal, 700) >= t).mean()))
    want = np.array(want)
    for i, c in enumerate(("threshold", "fpr", "detection_rate")):
        assert got[c].mean() == pytest.approx(want[:, i].mean(), abs=0.2 * want[:, i].std()) and got[c].std() == pytest.approx(want[:, i].std(), rel=0.15)
    assert len(got) == 1500 and (got.fpr_ok == (got.fpr <= 0.06)).all()


def test_shap_is_the_mean_over_orders():
    """Attributions of a tree against the definition: expected values given subsets of the features, over all orders."""
    rng = np.random.default_rng(2)
    nodes = [(0, 0, 1, 2, 0, 0.0, 0, 10.0), (0, 1, 3, 4, 1, 0.5, 0, 6.0), (0, 2, 5, 6, 0, 1.0, 0, 4.0), *[(0, n, -1, -1, -1, 0.0, float(v), c) for n, v, c in ((3, 1, 2.0), (4, -2, 4.0), (5, 3, 1.0), (6, 5, 3.0))]]
    tree = {k: np.array([r[i] for r in nodes]) for i, k in enumerate(("tree", "node", "left", "right", "feature", "threshold", "value", "cover"))}

    def expected(x, known, at=0):
        if tree["left"][at] < 0:
            return tree["value"][at]
        a, b = int(tree["left"][at]), int(tree["right"][at])
        if tree["feature"][at] in known:
            return expected(x, known, a if x[tree["feature"][at]] <= tree["threshold"][at] else b)
        return (tree["cover"][a] * expected(x, known, a) + tree["cover"][b] * expected(x, known, b)) / tree["cover"][at]

    leaves, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        if tree["left"][at] < 0:
            leaves.append((float(tree["value"][at]), [(f, *v) for f, v in path.items()]))
            continue
        f, cut = int(tree["feature"][at]), float(tree["threshold"][at])
        lo, hi, z = path.get(f, (-math.inf, math.inf, 1.0))
        for kid, bound in ((int(tree["left"][at]), (lo, min(hi, cut))), (int(tree["right"][at]), (max(lo, cut), hi))):
            stack.append((kid, path | {f: (*bound, z * float(tree["cover"][kid] / tree["cover"][at]))}))
    x = rng.normal(size=(20, 3))
    got = L.shap_values(leaves, x)
    for row, own in zip(x, got, strict=True):
        want = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for i, f in enumerate(order):
                want[f] += (expected(row, set(order[: i + 1])) - expected(row, set(order[:i]))) / 6
        assert own == pytest.approx(want)


def test_vectors_by_hand():
    record = {"histogram": [1] * 256, "byteentropy": [0] * 255 + [4], "strings": {"numstrings": 2, "avlength": 5.0, "printables": 10, "printabledist": [1] * 96, "entropy": 1.5, "paths": 0, "urls": 1, "registry": 0, "MZ": 1}, "general": {k: i for i, k in enumerate(raw.GENERAL2)}, "header": {"coff": {"timestamp": 9, "machine": "I386", "characteristics": ["DLL", "DLL"]}, "optional": {"subsystem": "GUI", "dll_characteristics": [], "magic": "PE32"} | dict.fromkeys(raw.OPTIONAL2, 3)}, "section": {"entry": ".t", "sections": [{"name": ".t", "size": 0, "entropy": 2.0, "vsize": 7, "props": ["MEM_READ", "MEM_EXECUTE"]}, {"name": "", "size": 5, "entropy": 1.0, "vsize": 0, "props": ["MEM_WRITE"]}]}, "imports": {"A.dll": ["f", "g"], "a.DLL": ["f"]}, "exports": ["e"], "datadirectories": [{"size": 1, "virtual_address": 2}]}
    x, at = raw.vectorize2([record])[0], raw.starts(raw.LAYOUT2)
    assert x.shape == (2381,) and x[0] == np.float32(1 / 256) and x[511] == 1 and x[at["section"] : at["section"] + 5].tolist() == [2, 1, 1, 1, 1]
    want = np.zeros(256)
    bucket, sign = hashing.hash_bucket("a.dll", 256)
    want[bucket] = sign  # two spellings are one library
    assert x[at["imports"] : at["imports"] + 256].tolist() == want.tolist()
    fn = np.zeros(1024)
    for t in ("a.dll:f", "a.dll:g", "a.dll:f"):
        bucket, sign = hashing.hash_bucket(t, 1024)
        fn[bucket] += sign
    assert x[at["imports"] + 256 : at["exports"]].tolist() == fn.tolist()
    flags = np.zeros(10)
    bucket, sign = hashing.hash_bucket("DLL", 10)
    flags[bucket] = 2 * sign
    assert x[at["header"] + 11 : at["header"] + 21].tolist() == flags.tolist()
    for broken, why in (({**record, "exports": "e"}, "exports"), ({k: v for k, v in record.items() if k != "general"}, "general")):
        with pytest.raises(ValueError, match=why):
            raw.vectorize2([broken])
    assert len(set(raw.feature_names2())) == 2381


def test_manifests(spark):
    a, b = "a" * 64, "B" * 64
    frame = lambda lines: spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    for lines in (["size;hash", f"1;{a}", f'2;"{b}"'], [f"{a} # seen", f"{b}\tx"], ["name,sha256", f'"x,y",{a}', f"z,{b}"], ["sha256", a, b]):
        assert sorted(r.sha256 for r in C.manifest_hashes(frame(lines)).collect()) == [a, b.lower()]
    with pytest.raises(Exception, match="not a SHA-256"):
        C.manifest_hashes(frame(["size,sha256", "1,zz"])).collect()


def test_records_are_refused(spark):
    good = json.dumps({"sha256": "a" * 64, "label": 1, "appeared": "2018-03"})
    frame = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    assert str(RC.checked(frame(good)).first().timestamp) == "2018-03-01"
    for bad, why in (("[1]", "not a JSON object"), (json.dumps({"sha256": "a", "label": 1}), "sha256"), (json.dumps({"sha256": "a" * 64, "label": 2}), "label")):
        with pytest.raises(Exception, match=why):
            RC.checked(frame(good, bad)).collect()


def test_anchors_and_checks(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    got = df.select(G.graded_check("d", F.col("v"), ">=", 1.0, 1.0, 0.85).alias("c")).first().c
    assert got.passed and got.score == 0.75  # the ideal was the threshold itself
    got = df.select(G.gate_check("d", F.lit(float("nan")), "<", 0.5, 0.1, 0.9).alias("c")).first().c
    assert got.passed is None and got.score is None
    with pytest.raises(ValueError, match="p must"):
        G.number_param(True, "p", 0, 1)


def test_triggers_and_budgets():
    assert MO.parse_triggers([{"name": "t", "features": {"f1": 2, "0": 1}}], {"f0": 0, "f1": 1}, 2) == {"t": {1: 2.0, 0: 1.0}}
    with pytest.raises(ValueError, match="near: \\['f1'\\]"):
        MO.parse_triggers([{"name": "t", "features": {"f11": 2}}], {"f1": 1}, 2)
    assert MO.budget_list([100, 10, 100], 50) == [10, 50, 100]
    with pytest.raises(ValueError, match="positive"):
        MO.budget_list([0], 5)


def test_unreadable_pickles_are_swept():
    found, seen = PK.opcode_globals(b"\x80\x04junk")
    assert not found and not seen["complete"]
    assert PK.byte_sweep(b"xxcos\nsystem\n") == [("os", "system", "GLOBAL")]
    assert PK.sniff(b"\x1f\x8b\x08x") == "joblib-compressed" and PK.sniff(b"") == "unknown"


def test_splits_of_other_kinds(spark):
    onnx = {"nodes_treeids": [0] * 5, "nodes_nodeids": [0, 1, 2, 3, 4], "nodes_modes": ["BRANCH_GT", "BRANCH_GTE", "LEAF", "LEAF", "LEAF"], "nodes_values": [1.0, 0.5, 0, 0, 0], "nodes_truenodeids": [1, 3, 0, 0, 0], "nodes_falsenodeids": [2, 4, 0, 0, 0], "nodes_featureids": [0, 1, 0, 0, 0], "target_treeids": [0, 0, 0], "target_nodeids": [2, 3, 4], "target_weights": [1.0, 2.0, 3.0]}
    tree = next(iter(L.arrays_of(L.node_table(spark, L.from_onnx(onnx))).values()))
    x = np.array([[1.0, 9], [1.1, 0.5], [1.1, 0.4], [0.9, 0]], np.float32)
    assert tree["value"][L.leaf_of(tree, x)].tolist() == [1.0, 2.0, 3.0, 1.0]
    with pytest.raises(ValueError, match="twice"):
        L.renumbered(0, {0: (1, 1)}, {0: {}, 1: {}})
    bounds, left = L.category_bounds([0, 2, 3])
    for c in (-2.5, -0.5, 0, 0.9, 1, 2, 3.9, 4, 7):
        assert left[int(np.searchsorted(bounds, c))] == (int(c) in (0, 2, 3) and c > -1)
    assert L.ubj(b"[$i#i\x03\x01\x02\x03") == [1, 2, 3]
    for bad in (b"[$S#L\x7f\xff\xff\xff\xff\xff\xff\xff", b"{i\x01a", b"[" * 100):
        with pytest.raises((ValueError, IndexError)):
            L.ubj(bad)
