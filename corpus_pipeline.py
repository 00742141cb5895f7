"""From raw documents to packed training sequences: five stages, each on what the one before kept."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigbook.llm import decontamination, exact_dedup, near_dedup, packing, quality
from rigbook.session import configure, cut_lineage

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of its own for each row, in the order of reading. ``docs`` is a stored table,
    which numbers its rows alike whenever it is read."""
    return docs.select(*DOCUMENT_COLUMNS, F.monotonically_increasing_id().alias("row"))


def as_documents(docs: DataFrame) -> DataFrame:
    """The texts under their rows' numbers, for operators to which an id is but a name."""
    return numbered(docs).select(F.col("row").alias("doc_id"), "text")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of these numbers. Rows are told apart whatever ids they have, null or the same; further columns
    than those of documents are left out."""
    return numbered(docs).join(kept.select("row"), "row", "left_semi").select(*DOCUMENT_COLUMNS)


def _first_of(docs: DataFrame, groups: DataFrame, order: Column) -> DataFrame:
    """Of each group, the row that comes first. ``groups`` holds row and group, ``order`` is made of doc_id and row.
    Found by aggregation, so that a group of most rows costs one row per task."""
    ids = numbered(docs).select("doc_id", "row")
    return groups.join(ids, "row").groupBy("group").agg(F.min_by("row", order).alias("row"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like any other, a null id has
    no label, and each row is decided for itself."""
    scored = quality.quality_scores(numbered(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), row="row")
    return _only(docs, scored.where("predicted = 1"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, one with the largest id; of several with that id, the first read. Half of the rows, by
    a hash of their numbers, count as history. Null texts count as empty, and null ids as smaller than all."""
    rows = as_documents(docs)
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    groups = exact_dedup.exact_dedup(rows.where(~early), rows.where(early)).select(
        F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    last = F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20)"), F.col("row"))
    return _only(docs, _first_of(docs, groups, last))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8), the one with the smallest id; of several with
    that id, the first read. Null ids count as larger than all. Texts without words are in no group and stay."""
    groups = near_dedup.near_dedup(as_documents(docs)).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    return _only(docs, _first_of(docs, groups, first))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate, each row decided for itself. A null text has no words
    and stays, and an empty benchmark contaminates nothing."""
    found = decontamination.decontaminate(as_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, found.where("not contaminated").select(F.col("doc_id").alias("row")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there. A null text is an empty document."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The classifier and the tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again by the next."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
