"""Checks on a loaded catalogue, as one table of results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.operators.reports import source_dimension

_COLUMNS = ["check_name", "subject", "ok", "observed", "total"]


def _sum(column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _percent_reached(observed: Column, total: Column, percent) -> Column:
    """In whole numbers, so that a share exactly on the threshold counts."""
    return observed * 100 >= total * percent


def _result(check: str, subject: Column, ok: Column, observed: Column, total: Column) -> Column:
    values = [F.lit(check), subject, ok, observed.cast("bigint"), total.cast("bigint")]
    return F.struct(*[value.alias(name) for name, value in zip(_COLUMNS, values)])


def _facts(parts: DataFrame, price_log: DataFrame, now: Column) -> DataFrame:
    """Both tables folded by shop and category; price rows without a part have neither.

    The log is folded by part first, so that a part with very many rows costs one row per task in the
    join. Parts and log are read once each.
    """
    low, high = fixed.PRICE_SANE_RANGE
    recent = F.col("scraped_at") >= now - F.expr(f"interval {fixed.FRESH_HOURS} hours")
    log_by_part = price_log.groupBy("part_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(recent).alias("recent"),
        F.count_if(~F.col("price_pkr").between(low, high)).alias("outliers"))
    known = parts.select("part_id", "source", "category", F.lit(1).alias("part"),
                         F.col("thumbnail_url").isNotNull().cast("int").alias("thumbnail"),
                         F.col("specs").isNotNull().cast("int").alias("specs"))
    return (known.join(log_by_part, "part_id", "full_outer").groupBy("source", "category")
            .agg(_sum("part").alias("parts"), _sum("thumbnail").alias("thumbnails"),
                 _sum("specs").alias("specs"), _sum("rows").alias("rows"),
                 _sum("recent").alias("recent"), _sum("outliers").alias("outliers"),
                 _sum(F.when(F.col("part").isNull(), F.col("rows"))).alias("orphans")))


def quality_report(parts: DataFrame, price_log: DataFrame, now: Column,
                   sources=fixed.PART_SOURCES) -> DataFrame:
    """(check_name, subject, ok, observed, total), one row per check and shop or per check of all."""
    return report_of(_facts(parts, price_log, now), sources)


def report_of(facts: DataFrame, sources=fixed.PART_SOURCES) -> DataFrame:
    """The report from facts by shop and category, wherever they were folded.

    Expected shops without any part are added to the folded facts; one rollup then gives the figures of
    each shop and of the whole catalogue.
    """
    c, source, everything = F.col, F.col("source"), F.lit("all")
    facts = facts.unionByName(source_dimension(facts.sparkSession, sources), allowMissingColumns=True)
    found = F.when((c("parts") > 0) & source.isin(*sources), source)
    measures = ("parts", "thumbnails", "specs", "rows", "recent", "outliers", "orphans")
    figures = facts.rollup("source").agg(
        F.grouping("source").alias("is_total"), F.count_distinct("category").alias("categories"),
        F.count_distinct(found).alias("found"), *[_sum(m).alias(m) for m in measures])

    percent = F.lit(fixed.THUMBNAIL_PERCENT)
    for shop, lower in fixed.THUMBNAIL_PERCENT_BY_SOURCE.items():
        percent = F.when(source == shop, lower).otherwise(percent)
    of_shop = F.array(
        _result("source_has_parts", source, c("parts") > 0, c("parts"), c("parts")),
        _result("source_is_fresh", source, c("recent") > 0, c("recent"), c("recent")),
        _result("source_thumbnails", source, _percent_reached(c("thumbnails"), c("parts"), percent),
                c("thumbnails"), c("parts")))
    of_all = F.array(
        _result("all_sources_present", everything, c("found") == len(sources), c("found"),
                F.lit(len(sources))),
        _result("spec_coverage", everything, (c("parts") > 0) & _percent_reached(
            c("specs"), c("parts"), fixed.SPEC_COVERAGE_PERCENT), c("specs"), c("parts")),
        _result("distinct_categories", everything, c("categories") >= fixed.MIN_DISTINCT_CATEGORIES,
                c("categories"), F.lit(fixed.MIN_DISTINCT_CATEGORIES)),
        _result("sane_prices", everything, c("outliers") == 0, c("outliers"), c("rows")),
        _result("no_orphan_prices", everything, c("orphans") == 0, c("orphans"), c("rows")))
    checks = F.when(c("is_total") == 1, of_all).when(source.isin(*sources), of_shop)
    # A shop without parts has no thumbnails to judge.
    return (figures.select("parts", F.inline(checks))
            .where("check_name <> 'source_thumbnails' or parts > 0").drop("parts"))


def quality_summary(report: DataFrame) -> DataFrame:
    """(passed, total, ok): how many checks hold, and whether all do."""
    return (report.agg(F.count_if(F.col("ok")).alias("passed"), F.count(F.lit(1)).alias("total"))
            .withColumn("ok", F.col("passed") == F.col("total")))
