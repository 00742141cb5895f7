"""Inputs and outputs that are plain files: page tables and feeds."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigbook import schemas
from rigbook.functions.text import bind, whole_json
from rigbook.session import freeing_shuffles


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched pages. Keep the table partitioned by ``source``: each profile then reads its own part."""
    return spark.read.schema(schemas.PAGES).format(fmt).load(path)


#: Bytes of a row group of pages. They count as compressed, which pages are to a tenth or less, and a task reads whole
#: row groups: of Spark's default, 128 MB, one task reads all pages of a shop.
PAGE_GROUP = 1 << 20


def write_pages(pages: DataFrame, path: str) -> None:
    # Rebalancing splits a shop that holds most of the pages over many tasks and files.
    (pages.hint("rebalance", "source").write.mode("append").partitionBy("source")
     .option("parquet.block.size", str(PAGE_GROUP)).parquet(path))


def read_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.FEED).format(fmt).load(path)


def read_prebuilt_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.PREBUILT_FEED).format(fmt).load(path)


#: Rows of a compressed file: one task alone reads it, so it is cut to some 40 MB of a feed.
GZIP_ROWS = 500_000


def write_json(rows: DataFrame, path: str) -> None:
    """Export rows as UTF-8 JSON lines, one file per task; fields that are NULL are written out.

    A path that ends in ``.gz`` gets compressed files, a fifth as large. Readers see by the files' names what they are.
    """
    writer = rows.write.mode("errorifexists").option("ignoreNullFields", "false")
    if path.endswith(".gz"):
        writer = (writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
                  .option("maxRecordsPerFile", GZIP_ROWS))
    with freeing_shuffles(rows.sparkSession):
        writer.json(path)


def add_missing_columns(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring an older table to ``schema``: absent columns become NULL, present ones stay untouched."""
    present = set(rows.columns)
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in present}
    return rows.withColumns(absent) if absent else rows


def as_json(struct: Column) -> Column:
    """A struct as JSON text without its NULL fields; NULL stays NULL."""
    return F.to_json(struct)


def from_json_text(text: Column, schema: T.StructType) -> Column:
    """JSON text as a struct. NULL, empty and malformed text and an empty object all become NULL."""
    return bind(whole_json(text, schema.simpleString()), lambda parsed: F.when(
        F.coalesce(*[parsed[f.name] for f in schema]).isNotNull(), parsed))
