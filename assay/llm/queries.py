"""Registry of this subpackage: queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.oracle import ORACLE_SQL as ORACLE_SQL

WORD_BPE = "word_bpe_49k.json"
#: Key of the surrogates; a deployment passes its own secret.
KEY = "assay-surrogates"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.bpe import encode

    out = encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.common import crc_mod
    from assay.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    return predict(docs, *train(docs.where(~held_out)), more={"held_out": held_out})


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.common import crc_mod
    from assay.llm.lm import lm_scores

    rest = crc_mod("doc_id", 7)
    return lm_scores(table(spark, sf_dir, "documents"), learn=rest != 2, tune=rest == 3, more={"held_out": rest == 2})


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.suffixes import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), KEY).select("doc_id", "pii.n_entities", "text")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.chosenpath import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "rules.*")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.linededup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.hardneg import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_neardup": op3_neardup,
    "op4_lm": op4_lm,
    "op5_warc": op5_warc,
    "op6_suffixes": op6_suffixes,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_rules": op9_rules,
    "op10_packing": op10_packing,
    "op11_lines": op11_lines,
    "op12_search": op12_search,
    "op13_negatives": op13_negatives,
}
