"""Queries of hashed features, against the hash functions written in SQL."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.catalog.records import _AT, TEXT, records
from assay.catalog.sql import crc32, murmur
from assay.features import hashing, raw
from assay.functions import bytes as B
from assay.functions import scalars as S
from assay.catalog.base import query
from assay.sources import records as RC
from assay.sources.corpora import table


def _udf(make, kind=T.ArrayType(T.DoubleType())):
    @F.pandas_udf(kind)
    def run(lists):
        import pandas as pd

        return pd.Series(list(make([list(x) for x in lists])))

    return run


_PRIORITIES = f"m AS {murmur('SELECT o_orderpriority AS token FROM orders')}"
_WORDS = "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS token FROM orders"
_SUMS = "SELECT o_orderkey, b, coalesce(sum(CASE WHEN abs(h) % 8 = b THEN {sign} END), 0)::DOUBLE AS v FROM w JOIN m USING (token), range(8) t(b) GROUP BY ALL"


@query("hash_bucket", f"WITH {_PRIORITIES} SELECT token, (abs(h) % 16)::INTEGER AS bucket, (CASE WHEN h >= 0 THEN 1 ELSE -1 END)::INTEGER AS sign FROM m")
def _(spark, sf):
    words = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("token")).distinct()

    @F.pandas_udf("struct<bucket:int,sign:int>")
    def bucket(tokens):
        import pandas as pd

        h = hashing.murmur3_many([hashing.token_bytes(t) for t in tokens]).astype("int64")
        return pd.DataFrame({"bucket": (abs(h) % 16).astype("int32"), "sign": (1 - 2 * (h < 0)).astype("int32")})

    return words.select("token", bucket("token").alias("h")).select("token", "h.*")


@query("hash_rows", f"WITH w AS ({_WORDS}), m AS {murmur(_WORDS)}, s AS ({_SUMS.format(sign='1')}) SELECT o_orderkey, b::INTEGER AS bucket, v AS value FROM s WHERE v <> 0")
def _(spark, sf):
    """Words of each order's priority, unsigned."""
    udf = _udf(lambda lists: hashing.hash_rows(lists, 8, signed=False))
    got = table(spark, sf, "orders").select("o_orderkey", udf(F.split("o_orderpriority", "-")).alias("x"))
    return got.select("o_orderkey", F.posexplode("x").alias("bucket", "value")).where("value <> 0")


@query("hash_matrix", f"WITH w AS ({_WORDS}), m AS {murmur(_WORDS)}, s AS ({_SUMS.format(sign='CASE WHEN h >= 0 THEN 1 ELSE -1 END')}) SELECT o_orderkey, b::INTEGER AS bucket, v AS value FROM s WHERE v <> 0")
def _(spark, sf):
    udf = _udf(lambda lists: hashing.hash_matrix(lists, 8))
    got = table(spark, sf, "orders").select("o_orderkey", udf(F.split("o_orderpriority", "-")).alias("x"))
    return got.select("o_orderkey", F.posexplode("x").alias("bucket", "value")).where("value <> 0")


@query("hash_matmul", f"WITH p AS (SELECT DISTINCT o_custkey AS row, o_orderpriority AS token FROM orders), {_PRIORITIES} SELECT row, (abs(h) % 4)::INTEGER AS bucket, sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END)::BIGINT AS value FROM p JOIN m USING (token) GROUP BY ALL")
def _(spark, sf):
    presence = table(spark, sf, "orders").select(F.col("o_custkey").alias("row"), F.col("o_orderpriority").alias("token")).distinct()
    h = presence.select("token").distinct().withColumn("h", B.murmur3(F.col("token")).cast("bigint"))
    return RC.hash_matmul(presence, h.select("token", (F.abs("h") % 4).cast("int").alias("bucket"), F.when(F.col("h") >= 0, 1).otherwise(-1).alias("sign")))


@query("murmur3_signed", f"WITH n AS (SELECT p_partkey, p_partkey::VARCHAR || '/' || p_brand AS token FROM part), m AS {murmur('SELECT token FROM n')} SELECT p_partkey, h FROM n JOIN m USING (token)")
def _(spark, sf):
    text = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", B.murmur3(text).cast("bigint").alias("h"))


_PARTS = "SELECT page_id, token FROM (SELECT page_id, unnest(regexp_split_to_array(url, '[/.:?&=#]+')) AS token FROM pages) WHERE token <> ''"


@query("feature_hasher", f"WITH t AS ({_PARTS}), m AS {murmur('SELECT token FROM t')} SELECT page_id AS row_id, (abs(h) % 64)::INTEGER AS bucket, sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END)::BIGINT AS weight FROM t JOIN m USING (token) GROUP BY ALL")
def _(spark, sf):
    tokens = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.explode(F.split("url", "[/.:?&=#]+")).alias("token")).where("token <> ''")
    return B.hashed_features(tokens, 64)


@query("module_seed", f"SELECT event_id, (event_id * 1000003 + c) % 4294967296 AS seed FROM events JOIN (SELECT event_type, {crc32('event_type')}::BIGINT AS c FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.module_seed(F.col("event_id"), F.col("event_type")).alias("seed"))


# ---- hashed groups of the second layout: tokens with the first column and width of their block

_WORD = "[^\\x20\\x09-\\x0D]+"
_TOKENS = {
    "header": "SELECT doc_id, 1 + 10 * k AS base, 10 AS width, token, 1 AS weight FROM d, (VALUES (0, 'I386'), (1, 'EXECUTABLE_IMAGE'), (2, 'WINDOWS_GUI'), (4, 'PE32')) t(k, token)",
    "section": """SELECT doc_id, 5 + 50 * k AS base, 50 AS width, '.s' || (i - 1) % 3 AS token, [length(line), length(line) % 8, 2 * length(line)][k + 1] AS weight FROM l, range(3) t(k)
      UNION ALL SELECT doc_id, 155, 50, c, 1 FROM d, (VALUES ('.'), ('s'), ('0')) t(c) UNION ALL SELECT doc_id, 205, 50, c, 1 FROM d, (VALUES ('MEM_READ'), ('MEM_EXECUTE')) t(c) UNION ALL SELECT doc_id, 205, 50, 'MEM_WRITE', 1 FROM l WHERE i = 4""",
    "imports": """SELECT DISTINCT doc_id, 0 AS base, 256 AS width, substr(w, 1, 1) || '.dll' AS token, 1 AS weight FROM (SELECT doc_id, unnest(six) AS w FROM s)
      UNION ALL SELECT doc_id, 256, 1024, substr(w, 1, 1) || '.dll:' || w, 1 FROM (SELECT doc_id, unnest(six) AS w FROM s)""",
    "exports": "SELECT doc_id, 0 AS base, 128 AS width, unnest(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))[1:5]) AS token, 1 AS weight FROM d",
}


def _checksum(group: str) -> str:
    return f"""WITH d AS (SELECT doc_id, {TEXT} AS t, regexp_extract_all({TEXT}, '{_WORD}') AS ws FROM documents), l AS (SELECT doc_id, i, string_split(t, chr(10))[i] AS line FROM d, range(1, 5) r(i) WHERE i <= len(string_split(t, chr(10)))),
      p AS (SELECT doc_id, list_filter(ws, lambda x: regexp_full_match(x, '[a-z]+')) AS ps FROM d), s AS (SELECT doc_id, list_filter(ps, lambda x, i: list_position(ps, x) = i)[1:6] AS six FROM p),
      k AS ({_TOKENS[group]}), m AS {murmur('SELECT token FROM k')}, c AS (SELECT doc_id, base + abs(h) % width AS col, sum(weight * CASE WHEN h >= 0 THEN 1 ELSE -1 END) AS v FROM k JOIN m USING (token) GROUP BY ALL)
      SELECT doc_id, coalesce(sum(abs(v)), 0)::DOUBLE AS mass, coalesce(sum(v * (col % 97 + 1)), 0)::DOUBLE AS checksum FROM d LEFT JOIN c USING (doc_id) GROUP BY doc_id"""


def _group(group: str, first: int, n: int):
    """Of a hashed block of each record: the sum of sizes, and one that tells the columns apart."""

    def run(spark, sf):
        own = F.slice("x", _AT[group] + first + 1, n)
        add = lambda term: F.aggregate(F.transform(own, term), F.lit(0.0), lambda a, v: a + v)
        x = raw.vectors(records(spark, sf), "doc_id", "value")
        return x.select("doc_id", add(lambda v, i: F.abs(v).cast("double")).alias("mass"), add(lambda v, i: v.cast("double") * ((i + first) % 97 + 1)).alias("checksum"))

    return run


for _key, _name, _first, _n in (("vec_header", "header", 1, 50), ("vec_section", "section", 5, 250), ("vec_imports", "imports", 0, 1280), ("vec_exports", "exports", 0, 128)):
    query(_key, _checksum(_name))(_group(_name, _first, _n))


_FLAGS = "SELECT DISTINCT o_orderpriority AS token, ['info', 'opt_in', 'structural'][1 + length(o_orderpriority) % 3] AS role FROM orders"


@query("flag_bucket_levels", f"WITH f AS ({_FLAGS}), m AS {murmur('SELECT token FROM f')}, r AS (SELECT b, list(DISTINCT role) FILTER (role IS NOT NULL) AS roles FROM range(10) t(b) LEFT JOIN (SELECT abs(h) % 10 AS b, role FROM f JOIN m USING (token)) USING (b) GROUP BY b) SELECT b::INTEGER AS bucket, CASE WHEN roles = ['info'] THEN 'controllable' WHEN roles IS NULL OR roles = ['structural'] THEN 'fixed' ELSE 'derived' END AS level FROM r")
def _(spark, sf):
    """Flags named as the orders' priorities, with roles by their length."""
    token = F.col("o_orderpriority")
    role = F.element_at(F.array(F.lit("info"), F.lit("opt_in"), F.lit("structural")), (1 + F.length(token) % 3).cast("int"))
    return RC.flag_levels(table(spark, sf, "orders").select(token.alias("flag"), role.alias("role")).distinct(), 10)
