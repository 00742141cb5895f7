"""Counts over feeds and over the catalogue."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigbook import fixed


def source_dimension(spark: SparkSession, sources=fixed.PART_SOURCES) -> DataFrame:
    """The expected shops; a handful of fixed rows."""
    rows = ", ".join(f"('{source}')" for source in sources)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS shops(source)")


def feed_counts(feed: DataFrame) -> DataFrame:
    """(source, category, n) of a feed."""
    return feed.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


def source_report(feed: DataFrame, sources=fixed.PART_SOURCES) -> DataFrame:
    """Rows per expected shop, with a warning where there are none."""
    counts = feed.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    return (source_dimension(feed.sparkSession, sources).join(counts, "source", "left")
            .select("source", rows.alias("n"), (rows == 0).alias("warning")))


def spec_coverage(parts: DataFrame) -> DataFrame:
    """By category: parts, parts with any specification, parts with a brand, and both as percentages."""
    counts = parts.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("specs").alias("with_specs"),
        F.count("specs.brand").alias("with_brand"))
    return counts.withColumns({
        "specs_percent": F.col("with_specs") * 100 / F.col("total"),
        "brand_percent": F.col("with_brand") * 100 / F.col("total")})
