"""Quality checks from stored profiles, so that a report reads neither all parts nor all of the price log.

A profile holds, for each file of the log, how many rows it has by shop and hour, and how many of their prices are
out of range. Files never change, so profiles are only ever added: those of files that no profile knows yet. A load
that dies between its rows and their profile loses nothing, as the next call finds the file. What the checks ask of
the parts comes from the counts that loads store with their buckets.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.operators.quality import report_of
from rigbook.sources.tables import CatalogueTables

HOUR = 3600


def _hour(time: Column) -> Column:
    """Hours since 1970, whatever the session's time zone."""
    return F.floor(F.unix_seconds(time) / HOUR)


def profile_prices(tables: CatalogueTables) -> int:
    """Profile the log files that have none yet; returns their number. Call it after loads, or before reports.

    Rows are folded by part before they meet the parts, so a part with most rows costs one row per task, file and hour.
    Rows without a part keep their part's key, as a later load may bring the part.
    """
    files = tables.unprofiled_files()
    if files:
        low, high = fixed.PRICE_SANE_RANGE
        folded = tables.price_files(files).groupBy("file", "part_id", _hour(F.col("scraped_at")).alias("hour")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("price_pkr").between(low, high)).alias("outliers"))
        owners = tables.parts().select("part_id", "source")
        orphan = F.when(F.col("source").isNull(), F.col("part_id")).alias("part_id")
        tables.append_profiles(folded.join(owners, "part_id", "left").groupBy("file", "source", orphan, "hour")
                               .agg(F.sum("rows").alias("rows"), F.sum("outliers").alias("outliers")))
    return len(files)


def part_facts(counts: DataFrame) -> DataFrame:
    """Counts of parts as the quality report wants them: source, category, parts, thumbnails, specs."""
    return counts.groupBy("source", "category").agg(
        F.sum("n").alias("parts"), F.sum("thumbnails").alias("thumbnails"),
        F.sum(F.when(F.col("specs").isNotNull(), F.col("n"))).alias("specs"))


def price_facts(tables: CatalogueTables, now: Column) -> DataFrame:
    """source, rows, recent, outliers and orphans of the whole log, from its profiles.

    Recent rows are counted by whole hours; only those of the hour in which they begin are looked up in the log, in
    one month's directory. Two runs that profiled one file at the same time wrote the same rows, which count once.
    """
    owners = tables.parts().select("part_id", F.col("source").alias("owner"))
    begin = now - F.expr(f"interval {fixed.FRESH_HOURS} hours")
    first = _hour(begin)
    rows = tables.price_profiles().groupBy("file", "source", "part_id", "hour").agg(
        F.max("rows").alias("rows"), F.max("outliers").alias("outliers"))
    measures = [F.sum("rows").alias("rows"), F.sum("outliers").alias("outliers"),
                F.sum(F.when(F.col("hour") > first, F.col("rows"))).alias("recent")]
    known = rows.where("part_id is null").groupBy("source").agg(*measures)
    adopted = (rows.where("part_id is not null").drop("source").join(owners, "part_id", "left")
               .groupBy(F.col("owner").alias("source")).agg(*measures))
    end = F.timestamp_seconds((first + 1) * HOUR)
    begun = tables.price_log().where((F.col("scraped_month") == F.trunc(begin, "month"))
                                     & (F.col("scraped_at") >= begin) & (F.col("scraped_at") < end))
    border = (begun.groupBy("part_id").agg(F.count(F.lit(1)).alias("n")).join(owners, "part_id", "left")
              .groupBy(F.col("owner").alias("source")).agg(F.sum("n").alias("recent")))
    every = known.unionByName(adopted).unionByName(border, allowMissingColumns=True)
    return every.withColumn("orphans", F.when(F.col("source").isNull(), F.col("rows")))


def quality_from_profiles(tables: CatalogueTables, now: Column, sources=fixed.PART_SOURCES) -> DataFrame:
    """The report of :func:`rigbook.operators.quality.quality_report` on the stored tables; log files that came
    since the last one are profiled first. ``now`` should be a literal, which prunes the log to one directory."""
    profile_prices(tables)
    facts = part_facts(tables.part_counts()).unionByName(price_facts(tables, now), allowMissingColumns=True)
    return report_of(facts, sources)
