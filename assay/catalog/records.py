"""Queries of raw records, their vectors, and corpora built of them."""

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.catalog.metrics import R
from assay.features import hashing, raw
from assay.catalog.base import query
from assay.sources import archives as A
from assay.sources import corpora as C
from assay.sources import records as RC
from assay.sources.staging import shared_path, staged

TEXT = "coalesce(text, '')"
_SPLIT = f"CASE WHEN octet_length(encode({TEXT})) % 2 = 0 THEN 'train' ELSE 'test' END"
_LABEL = f"length({TEXT}) % 3 - 1"


def records(spark, sf):
    return staged(RC.text_records(C.table(spark, sf, "documents")), "records")


def rows(spark, sf):
    """Records with their text's split, as checked rows."""
    split = F.when(F.octet_length(F.coalesce("text", F.lit(""))) % 2 == 0, "train").otherwise("test")
    docs = C.table(spark, sf, "documents")
    return RC.checked(records(spark, sf).join(docs.select("doc_id", split.alias("split")), "doc_id"))


@query("jsonl_scan_2018", f"SELECT {_LABEL} AS label, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    path = shared_path(spark, "jsonl")
    records(spark, sf).select("value").write.text(path)
    return RC.checked(RC.jsonl(spark, path)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_AT = raw.starts(raw.LAYOUT2)


def _some(x):
    at = lambda group, k: F.col("x")[_AT[group] + k].cast("double")
    return x.select("doc_id", F.size("x").alias("width"), at("general", 0).alias("size"), at("general", 1).alias("vsize"), at("general", 9).alias("symbols"), at("header", 0).alias("timestamp"), at("datadirectories", 3).alias("address"))


_SOME = f"SELECT doc_id, 2381 AS width, octet_length(encode({TEXT}))::DOUBLE AS size, length({TEXT})::DOUBLE AS vsize, 7.0::DOUBLE AS symbols, length({TEXT})::DOUBLE AS timestamp, 16.0::DOUBLE AS address FROM documents"


@query("vectorize_v2", _SOME)
def _(spark, sf):
    return _some(raw.vectors(records(spark, sf), "doc_id", "value"))


@query("jsonl_vectorize_2018", _SOME)
def _(spark, sf):
    r = RC.checked(records(spark, sf))
    return _some(RC.vectorised(r.select("doc_id", "sha256", "value")))


@query("iter_vectorized", f"SELECT count(*) AS n, 2381 AS width, sum(octet_length(encode({TEXT})))::DOUBLE AS bytes FROM documents")
def _(spark, sf):
    x = _some(raw.vectors(records(spark, sf), "doc_id", "value"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.sum("size").alias("bytes"))


@query("validate_matrix", "SELECT count(*) AS n FROM embeddings")
def _(spark, sf):
    return raw.matrix_ok(C.table(spark, sf, "embeddings"), "embedding", 64).agg(F.count(F.lit(1)).alias("n"))


@query("build_2018", f"SELECT {_SPLIT} AS split, {_LABEL} AS label, count(DISTINCT {TEXT}) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    return RC.build(rows(spark, sf).select("sha256", "label", "timestamp", "split", "value"), shared_path(spark, "corpus"))


@query("vec_general", f"SELECT doc_id, octet_length(encode({TEXT})) + length({TEXT}) + 8 + least(len(string_split({TEXT}, chr(10))), 4) + len(regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+')) AS total FROM documents")
def _(spark, sf):
    x = raw.vectors(records(spark, sf), "doc_id", "value")
    own = F.slice("x", _AT["general"] + 1, 10)
    return x.select("doc_id", F.aggregate(own, F.lit(0.0), lambda a, v: a + v.cast("double")).cast("bigint").alias("total"))


@query("vec_strings", f"SELECT doc_id, len(regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+'))::DOUBLE AS numstrings, length({TEXT})::DOUBLE AS printables, 1.5::DOUBLE AS entropy, 3.0::DOUBLE AS mz FROM documents")
def _(spark, sf):
    at = lambda k: F.col("x")[_AT["strings"] + k].cast("double")
    return raw.vectors(records(spark, sf), "doc_id", "value").select("doc_id", at(0).alias("numstrings"), at(2).alias("printables"), at(99).alias("entropy"), at(103).alias("mz"))


@query("vec_datadirs", f"SELECT doc_id, list_sum(list_transform(range(15), lambda i: length({TEXT}) % (i + 1)))::BIGINT AS sizes, (16 * 105)::BIGINT AS addresses FROM documents")
def _(spark, sf):
    own = F.slice("x", _AT["datadirectories"] + 1, 30)
    part = lambda k: F.aggregate(F.filter(own, lambda _, i: i % 2 == k), F.lit(0.0), lambda a, v: a + v.cast("double")).cast("bigint")
    return raw.vectors(records(spark, sf), "doc_id", "value").select("doc_id", part(0).alias("sizes"), part(1).alias("addresses"))


@query("entry_section_join", f"SELECT doc_id, 1 + (len(string_split({TEXT}, chr(10))) >= 4)::INTEGER AS n FROM documents")
def _(spark, sf):
    s = F.from_json("value", "section struct<entry:string,sections:array<struct<name:string>>>")["section"]
    return records(spark, sf).select("doc_id", F.size(F.filter(s["sections"], lambda x: x["name"] == s["entry"])).alias("n"))


@query("validate_raw_v2", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no field general.vsize' WHEN 2 THEN 'histogram must have 256 counts' ELSE 'no field exports' END AS problem FROM documents")
def _(spark, sf):
    def spoilt(i, value):
        r = json.loads(value)
        if i % 4 == 1:
            del r["general"]["vsize"]
        elif i % 4 == 2:
            r["histogram"].pop()
        elif i % 4 == 3:
            del r["exports"]
        return r

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # records are large beside what is said of them
                ids, values = (c.to_pylist() for c in batch.slice(at, 256).columns)
                found = [raw.problem(spoilt(i, v)) for i, v in zip(ids, values, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(found, pa.string())], ["doc_id", "problem"])

    own = records(spark, sf).select("doc_id", "value")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, problem string")


VOCABULARY = raw.Vocabulary(["url", "html"], ["I386", "AMD64"], ["WINDOWS_GUI"], [("coff", "timestamp"), ("coff", "machine"), ("optional", "subsystem")], ["EXECUTABLE_IMAGE", "DLL"], ["NX_COMPAT"], ["e_cblp"], signature=["num_certs"], warnings=["Suspicious flags...", "...is corrupt"])


def _v3(spark, sf):
    return raw.vectors(records(spark, sf), "doc_id", "value", VOCABULARY)


_AT3 = raw.starts(VOCABULARY.layout())
_V3 = f"SELECT doc_id, {raw.width_of(VOCABULARY.layout())} AS width, octet_length(encode({TEXT}))::DOUBLE AS size, length({TEXT})::DOUBLE AS timestamp, 1.0::DOUBLE AS executable, least(len(string_split({TEXT}, chr(10))), 4)::DOUBLE AS n_sections FROM documents"


def _some3(x):
    at = lambda group, k: F.col("x")[_AT3[group] + k].cast("double")
    return x.select("doc_id", F.size("x").alias("width"), at("general", 0).alias("size"), at("header", 0).alias("timestamp"), at("header", 3).alias("executable"), at("section", 0).alias("n_sections"))


def _v3_records(spark, sf):
    """The records with the size ratios that the third layout knows."""
    return staged(RC.text_records(C.table(spark, sf, "documents"), ratio=0.5), "records")


@query("vectorize_v3", _V3)
def _(spark, sf):
    return _some3(raw.vectors(_v3_records(spark, sf), "doc_id", "value", VOCABULARY))


@query("vectorize_2024", _V3)
def _(spark, sf):
    r = _v3_records(spark, sf).withColumn("sha256", RC.scan_hash(F.col("value")))
    return _some3(RC.vectorised(r, VOCABULARY))


@query("group_of", "SELECT vec_id, CASE " + " ".join(f"WHEN vec_id * 7 % 2381 < {_AT[g] + n} THEN '{g}'" for g, n in raw.LAYOUT2.items()) + " END AS \"group\" FROM embeddings")
def _(spark, sf):
    """The group of a feature by a join with the dimension of features."""
    asked = C.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") * 7 % 2381).cast("int").alias("feature"))
    return asked.join(F.broadcast(raw.features2(spark)), "feature").select("vec_id", "group")  # a row a feature


@query("cat_hash_token", "SELECT o_orderpriority AS token, octet_length(encode(o_orderpriority))::INTEGER AS n, count(*) AS rows FROM orders GROUP BY 1")
def _(spark, sf):
    @F.pandas_udf(T.IntegerType())
    def size(tokens):
        return tokens.map(lambda t: len(hashing.token_bytes(t))).astype("int32")

    return C.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("rows")).select("token", size("token").alias("n"), "rows")


@query("normalized_hist", "WITH c AS (SELECT l_suppkey, list(n ORDER BY k) AS counts FROM (SELECT l_suppkey, k, count(*) FILTER (l_linenumber = k) AS n FROM lineitem, range(1, 8) t(k) GROUP BY ALL) GROUP BY l_suppkey) SELECT l_suppkey, round(counts[1] / list_sum(counts), 4) AS first, round(list_sum(list_transform(counts, lambda x: x / list_sum(counts))), 4) AS total FROM c")
def _(spark, sf):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def share(lists):
        import pandas as pd

        return pd.Series(list(raw.normalised([list(map(int, x)) for x in lists], 7, 0.0)))

    li = C.table(spark, sf, "lineitem")
    counts = li.groupBy("l_suppkey").agg(F.array(*[F.count_if(F.col("l_linenumber") == k) for k in range(1, 8)]).alias("c")).withColumn("x", share("c"))
    return counts.select("l_suppkey", F.round(F.col("x")[0].cast("double"), 4).alias("first"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


@query("section_general_v3", f"SELECT doc_id, least(len(string_split({TEXT}, chr(10))), 4)::DOUBLE AS n, list_max(list_transform(string_split({TEXT}, chr(10))[1:4], lambda x: length(x) % 8))::DOUBLE AS max_entropy, 0.0::DOUBLE AS min_entropy FROM documents")
def _(spark, sf):
    at = lambda k: F.col("x")[_AT3["section"] + k].cast("double")
    return raw.vectors(_v3_records(spark, sf), "doc_id", "value", VOCABULARY).select("doc_id", at(0).alias("n"), at(5).alias("max_entropy"), at(6).alias("min_entropy"))


@query("vec_header_v3", f"SELECT doc_id, length({TEXT})::DOUBLE AS timestamp, 0.0::DOUBLE AS machine, 1.0::DOUBLE AS executable, 0.0::DOUBLE AS dll FROM documents")
def _(spark, sf):
    at = lambda k: F.col("x")[_AT3["header"] + k].cast("double")
    return raw.vectors(_v3_records(spark, sf), "doc_id", "value", VOCABULARY).select("doc_id", at(0).alias("timestamp"), at(1).alias("machine"), at(3).alias("executable"), at(4).alias("dll"))


@query("vec_strings_v3", f"SELECT doc_id, len(regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+'))::DOUBLE AS numstrings, 1.5::DOUBLE AS entropy, 0.0::DOUBLE AS urls FROM documents")
def _(spark, sf):
    at = lambda k: F.col("x")[_AT3["strings"] + k].cast("double")
    return raw.vectors(_v3_records(spark, sf), "doc_id", "value", VOCABULARY).select("doc_id", at(0).alias("numstrings"), at(99).alias("entropy"), at(100).alias("urls"))


# Warnings by the document: two known ones, an odd one, none, one known one twice.
_CASES = [(["Suspicious flags set for section 0", "the file is corrupt"], 2), (["odd"], 0), ([], 0), (["Suspicious flags 1", "Suspicious flags 2"], 1)]
_N_KNOWN = f"[{', '.join(str(n) for _, n in _CASES)}][1 + doc_id % 4]"


def _warned(spark, sf):
    """(doc_id, found): the warnings of each document."""
    found = F.element_at(F.array(*[F.array(*map(F.lit, w)).cast("array<string>") for w, _ in _CASES]), (1 + F.col("doc_id") % 4).cast("int"))
    return C.table(spark, sf, "documents").select("doc_id", RC.known_warnings(found, VOCABULARY.warnings).alias("found"))


@query("normalize_warnings", f"SELECT doc_id, {_N_KNOWN} AS n FROM documents")
def _(spark, sf):
    return _warned(spark, sf).select("doc_id", F.size("found").alias("n"))


def _more3(spark, sf):
    """Vectors of records with warnings, directories and signatures that follow the document."""
    k = F.col("doc_id")
    directories = F.array(*[F.struct(F.lit(n).alias("name"), (k % 50 * i).alias("size"), F.lit(i).alias("virtual_address"), (k % 2).alias("has_relocs"), F.lit(0).alias("has_dynamic_relocs")) for i, n in ((0, VOCABULARY.directories[0]), (3, VOCABULARY.directories[3]), (4, VOCABULARY.directories[4]))])
    record = F.struct(F.col("found").alias("pefilewarnings"), directories.alias("datadirectories"), F.struct((k % 5).alias("num_certs"), F.lit(1).alias("other")).alias("authenticode"))
    return raw.vectors(_warned(spark, sf).select("doc_id", F.to_json(record).alias("value")), "doc_id", "value", VOCABULARY)


@query("warnings_vec", f"SELECT doc_id, {_N_KNOWN}::DOUBLE AS total, (doc_id % 4 IN (0, 3))::DOUBLE AS suspicious, (doc_id % 4 = 0)::DOUBLE AS corrupt FROM documents")
def _(spark, sf):
    at = lambda i: F.col("x")[_AT3["pefilewarnings"] + i].cast("double")
    return _more3(spark, sf).select("doc_id", at(2).alias("total"), at(0).alias("suspicious"), at(1).alias("corrupt"))


@query("datadir_vec_v3", "SELECT doc_id, (doc_id % 50 * 3)::DOUBLE AS size, 3.0::DOUBLE AS address, (doc_id % 2)::DOUBLE AS relocs, 0.0::DOUBLE AS last FROM documents")
def _(spark, sf):
    n = 2 * len(VOCABULARY.directories)
    at = lambda i: F.col("x")[_AT3["datadirectories"] + i].cast("double")
    return _more3(spark, sf).select("doc_id", at(6).alias("size"), at(7).alias("address"), at(n).alias("relocs"), at(8).alias("last"))


@query("authenticode_vec", "SELECT doc_id, (doc_id % 5)::DOUBLE AS num_certs FROM documents")
def _(spark, sf):
    return _more3(spark, sf).select("doc_id", F.col("x")[_AT3["authenticode"]].cast("double").alias("num_certs"))


# Weekly archives of the documents: three zips, one loose challenge file, and a loose file that stands for a zip's of its name.
_WEEK = "'2024-1' || doc_id % 3 || '-01_2024-1' || doc_id % 3 || '-07_'"
_KIND = "CASE doc_id % 4 WHEN 2 THEN 'Win64' WHEN 3 THEN 'ELF' ELSE 'Win32' END"
_LOOSE = "2024-12-01_2024-12-07_Win64_test.jsonl"
_SEEN = f"""seen AS (SELECT * FROM (SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN '2024-10-01_2024-10-07_challenge.jsonl' WHEN 3 THEN '{_LOOSE}' ELSE 'x/' || {_WEEK} || {_KIND} || '_test.jsonl' END AS name,
  CASE doc_id % 5 WHEN 4 THEN 'challenge' ELSE 'test' END AS split, CASE doc_id % 5 WHEN 4 THEN NULL WHEN 3 THEN 'Win64' ELSE {_KIND} END AS file_type, doc_id % 5 < 3 AS in_zip FROM documents) WHERE file_type IS DISTINCT FROM 'ELF' AND name <> 'x/{_LOOSE}')"""


def _archives(spark, sf):
    path, k = shared_path(spark, "archives"), F.col("doc_id")
    kind = F.when(k % 4 == 2, "Win64").when(k % 4 == 3, "ELF").otherwise("Win32")
    month = F.concat(F.lit("2024-1"), (k % 3).cast("string"))
    loose = F.when(k % 5 == 4, "2024-10-01_2024-10-07_challenge.jsonl").when(k % 5 == 3, _LOOSE)
    file = F.coalesce(loose, F.concat(F.lit("week"), (k % 3).cast("string"), F.lit(".zip")))
    member = F.when(loose.isNull(), F.concat(F.lit("x/"), month, F.lit("-01_"), month, F.lit("-07_"), kind, F.lit("_test.jsonl")))
    value = F.to_json(F.struct(F.sha2(k.cast("string"), 256).alias("sha256"), F.when(k % 2 == 0, "Win32").otherwise("PDF").alias("file_type"), "text"))
    A.write_archives(C.table(spark, sf, "documents").select(file.alias("file"), member.alias("member"), value.alias("value")), path).write.format("noop").mode("overwrite").save()
    return path


@query("discover_members", f"WITH {_SEEN} SELECT DISTINCT name, split, file_type, in_zip FROM seen")
def _(spark, sf):
    return A.discover_members(spark, _archives(spark, sf), ["Win32", "Win64"]).select("name", "split", "file_type", "in_zip")


@query("iter_zip_rows", f"WITH {_SEEN} SELECT name, split, sha256(doc_id::VARCHAR) AS sha256, count(*) OVER (PARTITION BY name) AS n FROM seen")
def _(spark, sf):
    lines = A.read_archives(spark, _archives(spark, sf), ["Win32", "Win64"])
    n = lines.groupBy("name").agg((F.max("line") + 1).alias("n"))
    return lines.join(n, "name").select("name", "split", RC.scan_hash(F.col("value")).alias("sha256"), "n")


@query("select_file_type", f"WITH {_SEEN} SELECT split, count(*) AS n FROM seen WHERE split = 'test' OR doc_id % 2 = 0 GROUP BY split")
def _(spark, sf):
    lines = A.read_archives(spark, _archives(spark, sf), ["Win32", "Win64"])
    return RC.selected(lines.select("split", "value"), ["Win32"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("scan_hashes", f"SELECT doc_id, sha256({TEXT}) AS sha256 FROM documents")
def _(spark, sf):
    return records(spark, sf).select("doc_id", RC.scan_hash(F.col("value")).alias("sha256"))


@query("feature_digest", f"SELECT count(*) AS n, count(DISTINCT {TEXT}) AS n_digests FROM documents")
def _(spark, sf):
    return records(spark, sf).select(RC.feature_digest(F.col("value")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("d").alias("n_digests"))


@query("build_2024", f"SELECT {_SPLIT} AS split, CASE WHEN length({TEXT}) % 2 = 0 THEN 'Win32' ELSE 'PDF' END AS file_type, count(DISTINCT {TEXT}) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    r = rows(spark, sf).withColumnRenamed("doc_id", "line").withColumn("name", F.lit("all"))
    r = r.withColumn("digest", RC.feature_digest(F.col("value")))
    bad = RC.conflicts(r).unionByName(RC.across_splits(r).withColumn("split", F.lit("both")))
    kept = RC.planned(r).groupBy("split", "file_type").agg(F.count(F.lit(1)).alias("n"))
    return kept.where(F.lit(bad.isEmpty()))


@query("synthetic_row_sha", "SELECT o_orderkey AS row_id, sha256('synthetic/toy/seed0/n' || (SELECT count(*) FROM orders) || '/' || o_orderkey) AS sha256 FROM orders")
def _(spark, sf):
    """The hashes that name a row for each order."""
    orders = C.table(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("row_id"), RC.synthetic_sha("toy", 0, orders.count(), F.col("o_orderkey")).alias("sha256"))


_U = lambda seed, salt: f"(('0x' || substr(sha256('{seed}/' || id || '/' || {salt}), 1, 12))::BIGINT / {1 << 48}::DOUBLE)"


def _toy(seed: int, width: int) -> str:
    x = f"(sqrt(-2 * ln(1 - {_U(seed, chr(39) + 'a' + chr(39) + ' || k')})) * cos(2 * pi() * {_U(seed, chr(39) + 'b' + chr(39) + ' || k')}) + CASE WHEN k % 4 = 0 THEN label * (1 - month / 24.0::DOUBLE) ELSE 0 END)::FLOAT"
    return f"""WITH i AS (SELECT o_orderkey AS id FROM orders), r AS (SELECT id, floor({_U(seed, "'month'")} * 12)::INTEGER AS month, ({_U(seed, "'label'")} < 0.5)::INTEGER AS label FROM i),
      toy AS (SELECT id AS row_id, label, strftime(DATE '2018-01-01' + to_months(month), '%Y-%m-%d') AS timestamp, CASE WHEN month < 6 THEN 'train' ELSE 'test' END AS split, list_transform(range({width}), lambda k: {x}) AS x FROM r)"""


def _toy_rows(spark, sf, width, seed):
    """A row for each order."""
    orders = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return RC.toy_corpus(orders, orders.count(), width, seed).withColumn("timestamp", F.col("timestamp").cast("string"))


@query("toy_corpus", f"{_toy(0, 8)} SELECT row_id, label, timestamp, split, round(x[1]::DOUBLE, 4) AS first, round(list_sum(list_transform(x, lambda v: v::DOUBLE)), 4) AS total FROM toy")
def _(spark, sf):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return _toy_rows(spark, sf, 8, 0).select("row_id", "label", "timestamp", "split", F.round(F.col("x")[0].cast("double"), 4).alias("first"), F.round(total, 4).alias("total"))


@query("synthetic_source", f"{_toy(3, 4)} SELECT split, label, count(*) AS n, round(avg(x[1]::DOUBLE), 4) AS mean FROM toy GROUP BY ALL")
def _(spark, sf):
    return _toy_rows(spark, sf, 4, 3).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x")[0].cast("double")), 4).alias("mean"))


@query("synthetic_rows", f"{_toy(3, 1)} SELECT timestamp, label, split, count(*) AS n FROM toy GROUP BY ALL")
def _(spark, sf):
    return _toy_rows(spark, sf, 1, 3).groupBy("timestamp", "label", "split").agg(F.count(F.lit(1)).alias("n"))


_BASE = "c AS (SELECT l_returnflag AS label, l_linenumber AS cluster, sum(l_quantity) AS base, l_linenumber % 3 AS born, 4 + l_linenumber % 2 AS lifetime FROM lineitem GROUP BY ALL)"


@query("cluster_weights", f"WITH {_BASE}, w AS (SELECT label, cluster, month, base * CASE WHEN month < born OR month >= born + lifetime THEN 0 ELSE least((month - born + 1) / 2.0::DOUBLE, 1, (born + lifetime - month) / 2.0::DOUBLE) END AS w FROM c, range(8) m(month)) SELECT label, cluster, month, round(weight, 6) AS weight FROM (SELECT *, w / sum(w) OVER (PARTITION BY label, month) AS weight FROM w) WHERE w > 0")
def _(spark, sf):
    n = F.col("l_linenumber")
    clusters = C.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label"), n.alias("cluster")).agg(F.sum("l_quantity").alias("base")).withColumns({"born": F.col("cluster") % 3, "lifetime": 4 + F.col("cluster") % 2})
    return R(RC.cluster_weights(clusters, spark.range(8).select(F.col("id").alias("month"))), "weight")


def _written(spark, sf):
    path = shared_path(spark, "corpus")
    C.write_corpus(C.events_corpus(spark, sf), path, "events", "1")
    return path


@query("corpus_write", "SELECT count(*) AS n_rows, true AS ok FROM events")
def _(spark, sf):
    return C.verify_corpus(spark, _written(spark, sf)).select("n_rows", "ok")


@query("corpus_write_rows", "SELECT count(*) AS n_rows, true AS ok FROM events")
def _(spark, sf):
    path, ev = shared_path(spark, "corpus"), C.events_corpus(spark, sf)
    for part in (ev.where("row_id % 2 = 0"), ev.where("row_id % 2 = 1")):
        C.write_rows(part, path)
    C.finish_corpus(spark, path, "events", "1")
    return C.verify_corpus(spark, path).select("n_rows", "ok")


@query("corpus_write_all", "SELECT count(*) AS n FROM region")
def _(spark, sf):
    small = C.table(spark, sf, "region").select(F.col("r_regionkey").alias("row_id"), F.sha2("r_name", 256).alias("sha256"), F.lit(0).alias("label"), F.lit("test").alias("split"))
    path = shared_path(spark, "corpus")
    C.write_corpus(small.coalesce(1), path, "regions", "1")
    return C.load_corpus(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("verify_corpus", "SELECT false AS ok")
def _(spark, sf):
    """A corpus that lost a row after its manifest was written."""
    path = _written(spark, sf)
    staged(C.events_corpus(spark, sf).where("row_id <> 1"), "part").write.partitionBy("split").mode("overwrite").parquet(f"{path}/rows")
    return C.verify_corpus(spark, path).select("ok")


@query("content_hash", "SELECT count(*) AS n_rows, 1 AS n_distinct FROM events")
def _(spark, sf):
    """The same for two partitionings of the rows."""
    ev = C.events_corpus(spark, sf)
    both = C.content_hash(ev, C.IDENTITY).unionByName(C.content_hash(ev.repartition(3, "row_id"), C.IDENTITY))
    return both.agg(F.max("n_rows").alias("n_rows"), F.countDistinct("digest_sum").cast("int").alias("n_distinct"))


@query("provider_load", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN CAST(ts AS DATE) < DATE '2024-01-11' THEN 'train' WHEN event_type = 'error' AND event_id % 23 = 0 THEN 'challenge' ELSE 'test' END AS split FROM events) GROUP BY 1")
def _(spark, sf):
    """By the provider: found in a root, of the right name, format, hash, shape and feature version."""
    root = shared_path(spark, "corpora")
    made = C.write_corpus(C.events_corpus(spark, sf, vectors=True), f"{root}/events", "events", "1", "events_v1")
    provider = C.Provider("events", "events_v1", made["content_hash"])
    return provider.load(spark, root).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_corpus", "SELECT count(*) AS n FROM events")
def _(spark, sf):
    root = shared_path(spark, "corpora")
    C.write_corpus(C.events_corpus(spark, sf), f"{root}/events", "events", "1")
    return C.load_corpus(spark, C.resolve_corpus(spark, root, "events")).agg(F.count(F.lit(1)).alias("n"))


@query("file_sha256", f"SELECT doc_id::VARCHAR AS path, octet_length(encode({TEXT}))::BIGINT AS n_bytes, sha256({TEXT}) AS sha256 FROM documents")
def _(spark, sf):
    return C.file_sha256(C.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))


_KEYS = "SELECT DISTINCT sha256(CAST(o_custkey AS VARCHAR)) AS sha256 FROM orders"


def _keys(spark, sf, form):
    return C.manifest_hashes(form(C.table(spark, sf, "orders").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("h"), F.col("o_orderkey").alias("line"))))


def _with_head(rows_, head):
    return rows_.unionByName(rows_.sparkSession.createDataFrame([(head, -1)], "value string, line bigint"))


@query("manifest_hash_scan", _KEYS)
def _(spark, sf):
    return _keys(spark, sf, lambda d: d.select(F.when(F.col("line") % 2 == 0, F.upper("h")).otherwise(F.concat("h", F.lit("  # seen twice"))).alias("value"), "line"))


@query("manifest_csv", _KEYS)
def _(spark, sf):
    return _keys(spark, sf, lambda d: _with_head(d.select(F.concat_ws(",", "line", F.concat(F.lit('"'), "h", F.lit('"')), F.lit("x")).alias("value"), "line"), "size,SHA256,name"))


@query("manifest_lines", _KEYS)
def _(spark, sf):
    return _keys(spark, sf, lambda d: _with_head(d.select(F.concat_ws(" ", "h", F.lit("file.exe")).alias("value"), "line"), "# one a line"))


@query("manifest_dedup", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def _(spark, sf):
    return _keys(spark, sf, lambda d: d.select(F.col("h").alias("value"), "line")).agg(F.count(F.lit(1)).alias("n"))
