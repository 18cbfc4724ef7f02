"""The cleaning pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last give the columns
of documents (n_chars follows the text).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.blocks import is_scan
from assay.llm.chosenpath import jaccard_join
from assay.llm.common import free, staged
from assay.llm.packing import best_fit_packing
from assay.llm.pii import pseudonymise
from assay.llm.queries import KEY, tokenizer_path
from assay.llm.rules import quality_rules
from assay.llm.suffixes import remove_repeats
from assay.sources.staging import collecting, release, shared_dir


def _with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    """The given columns in order, with the new text and its number of characters."""
    fresh = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return df.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines above the limit.

    Copies of a text count once here: which of them stays is the next stage's decision. Null and empty
    texts fail; ties and rows that repeat an id are judged each; an empty table stays empty; columns may
    have any names.
    """
    into = free("rules", docs.columns)
    got = quality_rules(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")], count_texts=True, into=into)
    return _with_text(got.where(F.col(into)["kept"]), docs.columns, F.col(into)["text"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id.

    Documents without words stay (a null or empty text is no copy of another), and so do rows with a
    null id and all rows that repeat the smallest id. An empty table stays empty; columns may have
    any names.
    """
    classes = jaccard_join(docs.select("doc_id", "text")).where(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    return docs.join(classes.select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat a smaller document's; a character that lost bytes goes.

    A null text becomes empty; rows that repeat an id lose nothing to each other; an empty table
    stays empty; columns may have any names.
    """
    into = free("dedup", docs.columns)
    got = remove_repeats(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")], into=into)
    return _with_text(got, docs.columns, _whole(F.col(into)["kept"]))


def _whole(kept):
    """Bytes as text; what is no character any more is left out."""
    text = F.make_valid_utf8(kept.cast("string"))
    return F.when(F.is_valid_utf8(kept.cast("string")), kept.cast("string")).otherwise(F.replace(text, F.lit("�"), F.lit("")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data.

    A null text stays null; repeated rows get the same text; an empty table stays empty; columns may
    have any names.
    """
    into = free("pii", docs.columns)
    return _with_text(pseudonymise(docs, KEY, into=into), docs.columns, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: a null or empty text is its closing id alone; repeated rows are packed each."""
    return best_fit_packing(docs, tokenizer_path())


#: In the metadata of a result's doc_id, which Parquet keeps: the tables that were staged for it.
STAGED = "assay_staged"


def _stage(work):
    """A stage that first deletes what was staged for the result that it reads, now that this one has been written.

    The result itself says what that was, so stages on other files, side by side or in other threads, lose nothing; a result that is
    handed on unwritten still reads its tables, and they stay."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = lambda path: path.split(":", 1)[-1].lstrip("/")
        files, ours = [plain(f) for f in docs.inputFiles()], plain(shared_dir(spark))
        # only a plain scan of files is a written result; what is handed on unwritten still needs its tables
        written = bool(files) and is_scan(docs) and "doc_id" in docs.columns
        past = docs.schema["doc_id"].metadata.get(STAGED, []) if written else []
        release(spark, [p for p in past if plain(p).startswith(ours + "/") and not any(f.startswith(plain(p)) for f in files)])
        with collecting() as paths:
            out = work(spark, docs, sf_dir)
        return out.withMetadata("doc_id", {STAGED: paths})

    return run_stage


STAGES = [(f.__name__, _stage(f)) for f in (rules, near_duplicates, passages, personal_data, packing)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
