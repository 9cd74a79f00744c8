"""A training corpus in five stages: quality, language, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulletin.llm import exact_dedup, jaccard, language, packing, quality
from bulletin.llm.common import fresh_names, id_bucket, stored, table

#: Documents whose predicted language has less probability are rejected, as are those without letters.
LEAST_LANGUAGE_SCORE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from this table's labels, gives 0.5 or more.

    A null text is scored as empty.  Repeated and equal rows have equal scores, so all or none
    stay; rows with a null id are judged like others (none is learned from).  Without labels of
    both kinds every row stays.  All columns are kept; an empty table stays empty.
    """
    name = fresh_names(docs, "quality")[0]
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 3) != 1)
    return quality.with_quality(docs, model, name=name).where(f"{name} >= 0.5").drop(name)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is surely in one of the languages learned from this table.

    Null texts and those without a letter go, as does every row if no language could be learned.
    Repeated and equal texts stay or go together; ids do not matter but for what is learned from.
    All columns are kept; an empty table stays empty.
    """
    prefix = "lang_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "x_"
    model = language.train(docs, id_bucket("doc_id", 4) != 2)
    told = language.with_language(docs, model, prefix=prefix)
    sure = (F.col(f"{prefix}pred") != "und") & (F.col(f"{prefix}score") >= LEAST_LANGUAGE_SCORE)
    return told.where(sure).drop(f"{prefix}pred", f"{prefix}score")


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest id.

    Rows that repeat that id and text all stay, as do rows with a null id.  All columns are kept;
    an empty table stays empty.
    """
    return exact_dedup.without_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingle similarity of 0.75 join, the smallest id.

    Null texts and those without words link with nothing and stay, as do rows with a null id;
    rows that repeat an id stay or go together.  All columns are kept; an empty table stays empty.
    """
    return jaccard.one_per_group(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 token ids; ``ids`` are unsigned 32-bit, little-endian.

    A null or empty text is the end id alone; repeated rows are packed each; a null id stays
    null; other columns are left out; an empty table gives no rows.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("exact dedup", no_exact_copies),
    ("n-gram Jaccard join", no_near_copies),
    ("packing", packed),
]
#: Tokenisation and the classifiers are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
