from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.catalog.sql import EVENTS, LINES, MEMBERS
from assay.operators import pairing as P
from assay.operators import selection as S
from assay.catalog.base import query
from assay.sources.corpora import ROLES, events_corpus, line_corpus, training_hashes

NOT_MEMBER = "sha256 NOT IN (SELECT sha256 FROM members)"


def eval_rows(spark, sf) -> DataFrame:
    """Test rows of known label that no manifest member equals; one row a hash and class."""
    ev = events_corpus(spark, sf)
    return S.dedup_first(S.select_rows(ev, "eval", exclude=training_hashes(ev)), "label", "sha256")


@query("scan_corpus", f"WITH {EVENTS} SELECT * FROM ev")
def _(spark, sf):
    return events_corpus(spark, sf)


@query("corpus_lines", f"WITH {LINES} SELECT label, split, count(*) AS n, count(DISTINCT sha256) AS n_hashes, round(avg(score), 6) AS mean_score FROM li GROUP BY label, split")
def _(spark, sf):
    return line_corpus(spark, sf).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("n_hashes"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("select_rows", f"WITH {EVENTS} SELECT row_id, sha256, label FROM ev WHERE split IN ('train', 'test') AND label >= 0 AND timestamp > DATE '2024-01-05' AND timestamp < DATE '2024-01-20'")
def _(spark, sf):
    return S.select_rows(events_corpus(spark, sf), "temporal", after="2024-01-05", before="2024-01-20").select("row_id", "sha256", "label")


@query("select_eval", f"WITH {MEMBERS} SELECT row_id, score FROM ev WHERE split = 'test' AND label = 1 AND {NOT_MEMBER}")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return S.select_rows(ev, "eval", 1, exclude=training_hashes(ev)).select("row_id", "score")


@query("semi_join_members", f"WITH {MEMBERS} SELECT row_id, split FROM ev WHERE sha256 IN (SELECT sha256 FROM members) AND label >= 0")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return S.select_rows(ev, include=training_hashes(ev)).select("row_id", "split")


@query("anti_join_members", f"WITH {MEMBERS} SELECT row_id, split FROM ev WHERE {NOT_MEMBER} AND label >= 0")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return S.select_rows(ev, exclude=training_hashes(ev)).select("row_id", "split")


@query("count_excluded", f"WITH {MEMBERS} SELECT count(*) AS n_excluded FROM ev WHERE split = 'test' AND label >= 0 AND sha256 IN (SELECT sha256 FROM members)")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return S.select_rows(ev, "eval", include=training_hashes(ev)).agg(F.count(F.lit(1)).alias("n_excluded"))


@query("manifest_in_corpus", f"WITH {MEMBERS} SELECT count(*) AS n_members, count(*) FILTER (sha256 IN (SELECT sha256 FROM ev WHERE split = 'test')) AS n_in_test FROM members")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    test = ev.where("split = 'test'").select("sha256").distinct().withColumn("hit", F.lit(1))
    return training_hashes(ev).join(test, "sha256", "left").agg(F.count(F.lit(1)).alias("n_members"), F.count("hit").alias("n_in_test"))


@query("role_to_splits", f"WITH {EVENTS} SELECT role, count(*) AS n FROM ev JOIN (VALUES ('eval','test'),('temporal','train'),('temporal','test'),('challenge','challenge')) r(role, s) ON split = s GROUP BY role")
def _(spark, sf):
    roles = spark.createDataFrame([(r, s) for r, ss in ROLES.items() for s in ss], "role string, split string")
    return events_corpus(spark, sf).join(F.broadcast(roles), "split").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("has_timestamps", f"WITH {EVENTS} SELECT split, bool_or(timestamp IS NOT NULL) AS has_timestamps, count(*) FILTER (timestamp IS NULL) AS n_undated FROM ev GROUP BY split")
def _(spark, sf):
    return events_corpus(spark, sf).groupBy("split").agg(F.bool_or(F.col("timestamp").isNotNull()).alias("has_timestamps"), F.count_if(F.col("timestamp").isNull()).alias("n_undated"))


@query("hash_mod_slice", f"WITH {EVENTS} SELECT row_id FROM ev WHERE ('0x' || substr(sha256, 1, 8))::BIGINT % 10 = 0")
def _(spark, sf):
    return events_corpus(spark, sf).where(S.hash_slice(F.col("sha256"))).select("row_id")


@query("hash_index", f"WITH {EVENTS} SELECT sha256, max(row_id) AS row_id FROM ev GROUP BY sha256")
def _(spark, sf):
    return S.hash_index(events_corpus(spark, sf))


@query("dedup_first", f"WITH {EVENTS} SELECT ev.row_id, ev.label, ev.score FROM ev JOIN (SELECT sha256, min(row_id) AS row_id FROM ev GROUP BY sha256) f ON ev.row_id = f.row_id")
def _(spark, sf):
    return S.dedup_first(events_corpus(spark, sf)).select("row_id", "label", "score")


@query("plan_dedup", f"WITH {EVENTS} SELECT split, sha256, row_id, kept_row FROM (SELECT *, min(row_id) OVER (PARTITION BY split, sha256) AS kept_row FROM ev) WHERE row_id > kept_row")
def _(spark, sf):
    return S.duplicates_dropped(events_corpus(spark, sf))


@query("dup_conflict_join", f"WITH {EVENTS}, k AS (SELECT *, first(label) OVER w AS l0, first(score) OVER w AS s0, first(row_id) OVER w AS r0 FROM ev WINDOW w AS (PARTITION BY split, sha256 ORDER BY row_id)) SELECT row_id AS lost_row, r0 AS kept_row FROM k WHERE row_id > r0 AND (label <> l0 OR score <> s0)")
def _(spark, sf):
    return S.duplicate_conflicts(events_corpus(spark, sf))


@query("hash_closure", f"WITH {EVENTS} SELECT row_id FROM ev WHERE sha256 IN (SELECT sha256 FROM ev WHERE row_id % 100 = 0)")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return S.hash_closure(ev, ev.where("row_id % 100 = 0")).select("row_id")


@query("corpus_summary", f"WITH {EVENTS} SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS malicious, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = -1) AS unlabeled, min(timestamp) AS first_day, max(timestamp) AS last_day FROM ev GROUP BY split")
def _(spark, sf):
    return S.summary(events_corpus(spark, sf))


@query("take_rows", f"WITH {EVENTS} SELECT row_id, score FROM ev WHERE row_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    from assay.sources.corpora import table

    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("row_id"))
    return events_corpus(spark, sf).join(wanted, "row_id", "left_semi").select("row_id", "score")


@query("subsample", f"WITH {EVENTS} SELECT row_id FROM ev WHERE label = 0 ORDER BY sha256('7/' || CAST(row_id AS VARCHAR)), row_id LIMIT 200")
def _(spark, sf):
    return S.ordered_sample(events_corpus(spark, sf).where("label = 0"), 200, 7).select("row_id")


@query("class_balanced_sample", f"WITH {EVENTS}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('3/' || CAST(row_id AS VARCHAR)), row_id) AS rn FROM ev WHERE label >= 0) SELECT row_id, label FROM r WHERE rn <= 150")
def _(spark, sf):
    return S.balanced_sample(events_corpus(spark, sf), 300, 3).select("row_id", "label")


@query("class_interleave", f"WITH {EVENTS} SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('5/' || CAST(row_id AS VARCHAR)), row_id) AS turn FROM ev WHERE split = 'challenge' OR (split = 'train' AND label = 1)")
def _(spark, sf):
    ev = events_corpus(spark, sf).where("split = 'challenge' or (split = 'train' and label = 1)")
    return S.interleaved(ev, 5).select("row_id", "label", "turn")


@query("query_prefix", f"WITH {EVENTS}, r AS (SELECT row_id, row_number() OVER (ORDER BY sha256('9/' || CAST(row_id AS VARCHAR)), row_id) AS rn FROM ev WHERE label >= 0) SELECT budget, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS row_sum FROM r JOIN (VALUES (100), (1000)) b(budget) ON rn <= budget GROUP BY budget")
def _(spark, sf):
    pool = events_corpus(spark, sf).where("label >= 0")
    parts = [S.ordered_sample(pool, k, 9).agg(F.lit(k).alias("budget"), F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("row_sum")) for k in (100, 1000)]
    return parts[0].unionByName(parts[1])


@query("pool_minus_eval", f"WITH {EVENTS} SELECT sha256 FROM ev EXCEPT SELECT sha256 FROM ev WHERE split = 'test'")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return ev.select("sha256").distinct().join(ev.where("split = 'test'").select("sha256").distinct(), "sha256", "left_anti")


@query("rest_minus_slice", f"WITH {EVENTS} SELECT row_id FROM ev WHERE label = 0 AND NOT ('0x' || substr(sha256, 1, 8))::BIGINT % 10 = 0")
def _(spark, sf):
    return events_corpus(spark, sf).where((F.col("label") == 0) & ~S.hash_slice(F.col("sha256"))).select("row_id")


@query("candidates_union", f"WITH {EVENTS} SELECT sha256 FROM ev WHERE split = 'train' AND label >= 0 UNION SELECT sha256 FROM ev WHERE split = 'challenge'")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return ev.where("split = 'train' and label >= 0").select("sha256").unionByName(ev.where("split = 'challenge'").select("sha256")).distinct()


@query("exclude_challenge", f"WITH {EVENTS} SELECT row_id FROM ev WHERE label >= 0 AND split <> 'challenge'")
def _(spark, sf):
    return events_corpus(spark, sf).where("label >= 0 and split <> 'challenge'").select("row_id")


@query("query_eval_split", f"WITH {EVENTS}, e AS (SELECT * FROM ev WHERE split = 'test' AND ('0x' || substr(sha256, 1, 8))::BIGINT % 10 = 0) SELECT 'eval' AS part, row_id FROM e UNION ALL SELECT 'pool', row_id FROM ev WHERE sha256 NOT IN (SELECT sha256 FROM e)")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    e = ev.where((F.col("split") == "test") & S.hash_slice(F.col("sha256")))
    return e.select(F.lit("eval").alias("part"), "row_id").unionByName(S.select_rows(ev, labeled_only=False, exclude=e).select(F.lit("pool").alias("part"), "row_id"))


_PAIR = "row_number() OVER (PARTITION BY {s} ORDER BY sha256('11/' || CAST(row_id AS VARCHAR)), row_id) AS position"


@query("stratified_pairing", f"WITH {EVENTS}, d AS (SELECT *, date_trunc('week', timestamp) AS w FROM ev WHERE label >= 0 AND timestamp IS NOT NULL), m AS (SELECT w, label, row_id AS member_row, {_PAIR.format(s='w, label')} FROM d WHERE split = 'train'), o AS (SELECT w, label, row_id AS other_row, {_PAIR.format(s='w, label')} FROM d WHERE split = 'test') SELECT label, member_row, other_row FROM m JOIN o USING (w, label, position)")
def _(spark, sf):
    d = events_corpus(spark, sf).where("label >= 0 and timestamp is not null").withColumn("w", F.date_trunc("week", "timestamp"))
    return P.stratified_pairs(d.where("split = 'train'"), d.where("split = 'test'"), 11, ["w", "label"]).select("label", "member_row", "other_row")


@query("label_pairing", f"WITH {EVENTS}, m AS (SELECT label, row_id AS member_row, {_PAIR.format(s='label')} FROM ev WHERE split = 'train' AND label >= 0), o AS (SELECT label, row_id AS other_row, {_PAIR.format(s='label')} FROM ev WHERE split = 'test' AND label >= 0) SELECT label, member_row, other_row FROM m JOIN o USING (label, position)")
def _(spark, sf):
    d = events_corpus(spark, sf).where("label >= 0")
    return P.stratified_pairs(d.where("split = 'train'"), d.where("split = 'test'"), 11, ["label"]).select("label", "member_row", "other_row")


_NEAR = f"WITH {EVENTS}, t AS (SELECT DISTINCT timestamp AS d FROM ev WHERE split = 'challenge' AND timestamp IS NOT NULL), q AS (SELECT row_id, timestamp FROM ev WHERE split = 'train' AND label = 1), n AS (SELECT row_id, min(abs(datediff('day', timestamp, d))) AS days_apart FROM q LEFT JOIN t ON q.timestamp IS NOT NULL GROUP BY row_id)"


@query("nearest_time_distance", f"{_NEAR} SELECT row_id, CAST(days_apart AS INTEGER) AS days_apart FROM n")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return P.nearest_days(ev.where("split = 'train' and label = 1"), ev.where("split = 'challenge'")).select("row_id", "days_apart")


@query("k_nearest_time", f"{_NEAR} SELECT row_id FROM n WHERE days_apart IS NOT NULL ORDER BY days_apart, sha256('13/' || CAST(row_id AS VARCHAR)), row_id LIMIT 50")
def _(spark, sf):
    ev = events_corpus(spark, sf)
    return P.k_nearest(ev.where("split = 'train' and label = 1"), ev.where("split = 'challenge'"), 50, 13).select("row_id")


@query("asof_join", "SELECT l.event_id, r.value AS last_purchase FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts")
def _(spark, sf):
    from assay.sources.corpora import table

    e = table(spark, sf, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return P.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "last_purchase").select("event_id", "last_purchase")
