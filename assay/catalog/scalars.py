from pyspark.sql import functions as F

from assay.catalog.metrics import R
from assay.catalog.sql import LINES
from assay.functions import bytes as B
from assay.functions import scalars as S
from assay.catalog.base import query
from assay.sources.corpora import line_corpus, table


def _score_sql(v: str, op: str, t: float, i: float, f: float, log: bool) -> str:
    sign = 1 if op.startswith(">") else -1
    ax = (lambda x: f"({sign} * log10(greatest(({x})::DOUBLE, 1e-12::DOUBLE)))") if log else (lambda x: f"({sign} * ({x})::DOUBLE)")
    a, b, c, d = ax(v), ax(str(t)), ax(str(i)), ax(str(f))
    s = f"CASE WHEN {a} >= {c} THEN 1 WHEN {a} >= {b} THEN 0.75::DOUBLE + 0.25::DOUBLE * ({a} - {b}) / ({c} - {b}) WHEN {a} <= {d} THEN 0 ELSE 0.75::DOUBLE * ({a} - {d}) / ({b} - {d}) END"
    ok = f"{a} {'>=' if op.endswith('=') else '>'} {b}"
    return f"round(CASE WHEN {ok} THEN greatest({s}, 0.75) ELSE least({s}, 0.749999) END, 6)"


@query("metric_score", f"WITH {LINES} SELECT row_id, score, {_score_sql('score', '>=', 0.5, 0.9, 0.2, False)} AS detection, {_score_sql('score', '<=', 0.3, 0.03, 0.9, True)} AS rate FROM li")
def _(spark, sf):
    s = F.col("score")
    return R(line_corpus(spark, sf).select("row_id", "score", S.metric_score(s, ">=", 0.5, 0.9, 0.2).alias("detection"), S.metric_score(s, "<=", 0.3, 0.03, 0.9, log=True).alias("rate")), "detection", "rate")


@query("ramp_log", "SELECT c_custkey, round(least(greatest((ln(greatest(c_acctbal, 10::DOUBLE)) - ln(10::DOUBLE)) / (ln(5000::DOUBLE) - ln(10::DOUBLE)), 0), 1), 6) AS ramp FROM customer")
def _(spark, sf):
    return R(table(spark, sf, "customer").select("c_custkey", S.ramp_log(F.col("c_acctbal"), 10, 5000).alias("ramp")), "ramp")


@query("log_confidence", f"WITH {LINES} SELECT row_id, label, score, round(CASE WHEN label = 1 THEN ln(greatest(score, 1e-300::DOUBLE)) ELSE ln(1 - least(score, 1 - pow(2.0::DOUBLE, -53))) END, 6) AS confidence FROM li WHERE label >= 0")
def _(spark, sf):
    rows = line_corpus(spark, sf).where("label >= 0")
    return R(rows.select("row_id", "label", "score", S.log_confidence(F.col("score"), F.col("label")).alias("confidence")), "confidence")


@query("logistic", "SELECT c_custkey, round(1 / (1 + exp(-0.001::DOUBLE * c_acctbal)), 6) AS p FROM customer")
def _(spark, sf):
    return R(table(spark, sf, "customer").select("c_custkey", S.logistic(F.col("c_acctbal"), 0.001).alias("p")), "p")


@query("round1", "SELECT c_custkey, floor(c_acctbal * 10::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS r FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (F.floor(F.col("c_acctbal") * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)).alias("r"))


@query("month_start", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.month_start(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("month"))


@query("parse_cutoff", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN last_day(o_orderdate) ELSE CAST(o_orderdate AS DATE) END AS cutoff FROM orders")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", S.parse_cutoff(text).alias("cutoff"))


@query("epoch_to_day", "SELECT event_id, CAST(to_timestamp(1700000000 + event_id * 3600) AT TIME ZONE 'UTC' AS DATE) AS day FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_date(F.timestamp_seconds(F.lit(1700000000) + F.col("event_id") * 3600)).alias("day"))


@query("norm_key", "SELECT DISTINCT o_orderpriority, regexp_replace(lower(trim(o_orderpriority)), '[\\s-]+', '_', 'g') AS key FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority", S.norm_key(F.col("o_orderpriority")).alias("key")).distinct()


@query("alias_hex", "SELECT c_name, 'enc-' || lower(hex(encode(c_name))) AS alias FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_name", S.alias_hex(F.col("c_name")).alias("alias"))


@query("alias_unhex", "SELECT c_name AS name FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(S.alias_unhex(S.alias_hex(F.col("c_name"))).alias("name"))


@query("public_items", "SELECT o_orderkey, 'batch=' || o_orderpriority || ',keyring=' || o_orderstatus || ',zone=' || o_custkey AS items FROM orders")
def _(spark, sf):
    pairs = {"zone": "o_custkey", "run_token": "o_orderstatus", "api_key": "o_orderpriority", "keyring": "o_orderstatus", "Password": "o_orderstatus", "batch": "o_orderpriority"}
    items = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.col(v).cast("string"))])
    shown = F.array_join(F.transform(S.public_items(items), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("items"))


@query(
    "sanitize_name",
    "SELECT DISTINCT o_orderkey % 6 AS kind, CASE o_orderkey % 6 WHEN 0 THEN regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g') || '.txt' WHEN 2 THEN 'a_b_c.json' WHEN 4 THEN repeat('x', 123) || '.json' WHEN 5 THEN repeat('y', 128) END AS name FROM orders",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("../../"), "o_orderpriority", F.lit(".txt"))).when(k == 1, ".x").when(k == 2, "C:\\models\\a  b&c.json").when(k == 3, "___").when(k == 4, F.concat(F.repeat(F.lit("x"), F.lit(500)), F.lit(".json"))).otherwise(F.repeat(F.lit("y"), F.lit(200)))
    # a name that many orders share is cleaned once; the count keeps Spark from dropping the inner of two distincts
    names = table(spark, sf, "orders").groupBy(k.alias("kind"), raw.alias("raw")).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return names.select("kind", S.safe_file_name(F.col("raw")).alias("name")).distinct()


_RUNS = "regexp_extract_all(text, '[\\x20-\\x7e]{5,}')"


@query("string_features", f"SELECT doc_id, len({_RUNS}) AS n_runs, coalesce(list_sum(list_transform({_RUNS}, lambda x: length(x))), 0)::BIGINT AS run_chars FROM documents")
def _(spark, sf):
    p = B.printable_profile(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", p["n_runs"].cast("bigint").alias("n_runs"), p["run_chars"].cast("bigint").alias("run_chars"))


@query("printable_profile", f"SELECT doc_id, round(CASE WHEN len({_RUNS}) > 0 THEN list_sum(list_transform({_RUNS}, lambda x: length(x))) / len({_RUNS}) END, 6) AS mean_run, len(list_filter({_RUNS}, lambda x: contains(lower(x), 'http')))::INTEGER AS urls FROM documents")
def _(spark, sf):
    p = B.printable_profile(F.col("text"))
    return R(table(spark, sf, "documents").select("doc_id", p["mean_run"].alias("mean_run"), p["urls"].cast("int").alias("urls")), "mean_run")


@query("byte_histogram", "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS blanks, length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS e FROM documents")
def _(spark, sf):
    h = B.byte_counts(table(spark, sf, "documents"), "doc_id", "text")
    return h.select("doc_id", "n_bytes", F.col("histogram")[32].alias("blanks"), F.col("histogram")[101].alias("e"))


_ENT = "SELECT page_id, ch, count(*)::DOUBLE AS c FROM (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS ch FROM pages) GROUP BY ALL"


@query("byte_entropy", f"WITH b AS ({_ENT}), n AS (SELECT page_id, sum(c) AS n FROM b GROUP BY page_id) SELECT page_id, n::BIGINT AS n_bytes, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM b JOIN n USING (page_id) GROUP BY page_id, n")
def _(spark, sf):
    return R(B.byte_counts(table(spark, sf, "pages"), "page_id", "html").select("page_id", "n_bytes", "entropy"), "entropy")


_BYTES = "octet_length(encode(coalesce(text, '')))"


@query(
    "block_entropy",
    """WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents), w AS (SELECT doc_id, x, n, unnest(range(0, greatest((n - 2048) // 1024, 0) + 1)) AS block FROM x),
  c AS (SELECT doc_id, block, list_transform(range(16), lambda k: length(s) - length(replace(s, substr('0123456789ABCDEF', k + 1, 1), ''))) AS counts FROM (SELECT doc_id, block, array_to_string(list_transform(range(least(2048, n)), lambda i: substr(x, 2 * (1024 * block + i) + 1, 1)), '') AS s FROM w))
  SELECT doc_id, block::INTEGER AS block, least(15, floor(4 * coalesce(-list_sum(list_transform(list_filter(counts, lambda k: k > 0), lambda k: (k / 2048.0::DOUBLE) * log2(k / 2048.0::DOUBLE))), 0) + 1e-7))::INTEGER AS bin FROM c""",
)
def _(spark, sf):
    """The entropy bin of each window of 2,048 bytes."""
    return B.block_entropy(table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")


@query("byte_entropy_hist", f"SELECT doc_id, CASE WHEN {_BYTES} < 2048 THEN {_BYTES} ELSE 2048 * (({_BYTES} - 2048) // 1024 + 1) END::BIGINT AS counted FROM documents")
def _(spark, sf):
    """Every nibble of every window is counted once."""
    h = B.block_entropies(table(spark, sf, "documents"), "doc_id", "text")
    return h.select("doc_id", F.aggregate("hist", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("counted"))


@query("start_bytes", "SELECT page_id, octet_length(encode(html)) AS size, substr(hex(encode(html)), 1, 8) AS head, substr(html, 1, 2) = 'MZ' AS is_pe FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("size"), F.hex(F.substring(F.col("html").cast("binary"), 1, 4)).alias("head"), F.substring("html", 1, 2).eqNullSafe(F.lit("MZ")).alias("is_pe"))


@query("regex_counts", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::INTEGER AS numbers, len(regexp_extract_all(text, '[A-Z][a-z]+'))::INTEGER AS capitalised, len(regexp_extract_all(text, '[.!]'))::INTEGER AS stops FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"), F.regexp_count("text", F.lit("[A-Z][a-z]+")).alias("capitalised"), F.regexp_count("text", F.lit("[.!]")).alias("stops"))


@query("sniff_format", "SELECT page_id, CASE WHEN left(html, 1) = '{' THEN 'json' ELSE 'unknown' END AS format FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.sniff_format(F.col("html").cast("binary")).alias("format"))


@query("normalized_counts", "WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM c")
def _(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return R(c.select("l_returnflag", "l_linestatus", (F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag"))).alias("share")), "share")
