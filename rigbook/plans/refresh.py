"""Whole refresh runs: from a feed or from fetched pages into the stored tables."""

import contextvars
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JNetworkError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.operators.cleaning import clean_feed
from rigbook.operators.crawl import first_seen, unmatched_pages
from rigbook.operators.details import extract_details
from rigbook.operators.listing import extract_listing
from rigbook.operators.loading import (backfill_specs, fold_listing, fold_prebuilts, fold_prices, merge_listing,
                                       merge_prebuilts, new_prices)
from rigbook.session import cut_lineage, scratch_run
from rigbook.sources.tables import CatalogueTables


def listing_feed(pages: DataFrame, source: str) -> DataFrame:
    """One shop's feed: its listing pages extracted, without what later pages repeat."""
    return first_seen(extract_listing(pages, source), ["source", "category", "url"], F.col("seq.page"))


def load_feed(tables: CatalogueTables, feed: DataFrame, now: Column | None = None) -> int:
    """Clean a feed and merge it into the stored tables; returns the number of new price rows.

    The cleaned batch is written out first, because the merges read it and parsing pages is the dear part. That
    also evaluates every row's checks before anything is written. Only buckets of parts that the batch falls into
    are read and rewritten, each with names and latest prices at once. Loading a batch twice adds no price row, so
    a run that died half-way is simply run again. Scratch tables are removed at the end.
    """
    spark = tables.spark
    now = F.lit(spark.sql("select current_timestamp()").first()[0]) if now is None else now
    with scratch_run(spark):
        batch = cut_lineage(clean_feed(feed))
        tables.merge_parts(fold_listing(batch), lambda stored, folded: merge_listing(stored, folded, now))
        # Months of one batch are few; as literals they prune the log to the directories the batch touches.
        months = [row[0] for row in batch.where("scraped_at is not null")
                  .select(F.trunc("scraped_at", "month")).distinct().collect()]
        log = tables.price_log().where(F.col("scraped_month").isin(months))
        if log.isEmpty():       # nothing stored that a row could repeat
            return tables.append_prices(cut_lineage(fold_prices(batch)))
        return tables.append_prices(cut_lineage(new_prices(log, batch)))


def load_prebuilts(tables: CatalogueTables, feed: DataFrame, now: Column | None = None) -> int:
    """Merge a prebuilt feed into the stored table; returns the number of feed rows."""
    spark = tables.spark
    now = F.lit(spark.sql("select current_timestamp()").first()[0]) if now is None else now
    counted = Observation()
    with scratch_run(spark):
        batch = cut_lineage(feed.observe(counted, F.count(F.lit(1)).alias("rows")))
        tables.merge_prebuilts(fold_prebuilts(batch), lambda stored, folded: merge_prebuilts(stored, folded, now))
    return counted.get["rows"]


def enrich_stored_parts(tables: CatalogueTables) -> None:
    """Read the specifications of all stored parts anew."""
    tables.replace_parts(backfill_specs(tables.listing()))


#: Shops whose pages are extracted at the same time: one shop's last tasks leave cores to the next.
SHOPS_AT_ONCE = 4


def is_cluster_error(spark: SparkSession, error: BaseException) -> bool:
    """Whether an error is about machines, disks or connections, and not about a shop's pages: an error of input or
    output or of memory anywhere in its chain of causes, here or on the executors."""
    if isinstance(error, (OSError, MemoryError, Py4JNetworkError)):
        return True
    cause = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while cause is not None:
        if any(is_instance_of(spark.sparkContext._gateway, cause, kind)
               for kind in ("java.io.IOException", "java.lang.VirtualMachineError")):
            return True
        cause = cause.getCause()
    return any(sign in str(error) for sign in ("ExecutorLostFailure", "FetchFailed", "No space left on device"))


def run_shops(spark: SparkSession, jobs: dict[str, Callable[[], int]], at_once: int = 1) -> DataFrame:
    """Run one job per shop, so many at once; a shop that fails does not stop the others.

    Returns the report, one row per shop: source, n, warning (no rows), error. An error of the cluster is no shop's
    failure: it would hit the next shop too, so the run ends with it.
    """
    def one(source: str) -> tuple:
        spark.sparkContext.setJobDescription(f"shop {source}")
        try:
            n = jobs[source]()
            return source, n, n == 0, None
        except Exception as error:  # whatever one shop's pages do, the other shops go on
            if is_cluster_error(spark, error):
                raise
            return source, 0, True, str(error).splitlines()[0]
        finally:
            spark.sparkContext.setJobDescription(None)

    with ThreadPoolExecutor(at_once) as pool:
        waiting = [pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(one), source)
                   for source in jobs]
        report = [each.result() for each in waiting]
    return spark.createDataFrame(report, "source string, n bigint, warning boolean, error string")


def collect_sources(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]]):
    """The shops' feeds, written out and united (None if none worked), with the report of :func:`run_shops`. Rows
    are counted as they are written."""
    feeds = {}

    def collect(source: str) -> int:
        counted = Observation()
        feeds[source] = cut_lineage(jobs[source]().observe(counted, F.count(F.lit(1)).alias("rows")))
        return counted.get["rows"]

    report = run_shops(spark, {s: (lambda s=s: collect(s)) for s in jobs}, SHOPS_AT_ONCE)
    united = reduce(DataFrame.unionByName, [feeds[s] for s in jobs if s in feeds]) if feeds else None
    return united, report


def refresh_parts(tables: CatalogueTables, pages: DataFrame, now: Column | None = None,
                  sources=fixed.PART_SOURCES):
    """All shops' listing pages into the catalogue, all or nothing; returns (new price rows, report). The shops'
    feeds are one batch: a product without category aborts the load of all of them, as rows are checked before
    anything is written. The report also has ``unmatched``: each shop's pages that belong to no known seed and so
    gave no rows."""
    jobs = {s: (lambda s=s: listing_feed(pages, s)) for s in sources}
    with scratch_run(tables.spark):
        feed, report = collect_sources(tables.spark, jobs)
        # A row for each shop, worked out now: the pages may be gone when the report is read.
        strays = {r.source: r.unmatched for r in unmatched_pages(pages.where(F.col("source").isin(*sources))).collect()}
        report = tables.spark.createDataFrame(
            [(*r, strays.get(r.source, 0)) for r in report.collect()],
            "source string, n bigint, warning boolean, error string, unmatched bigint")
        return (load_feed(tables, feed, now) if feed is not None else 0), report


def refresh_prebuilts(tables: CatalogueTables, pages: DataFrame, now: Column | None = None,
                      sources=fixed.PREBUILT_SOURCES):
    """All shops' detail pages into the prebuilts table, each shop committed on its own; returns (feed rows,
    report)."""
    jobs = {s: (lambda s=s: load_prebuilts(tables, extract_details(pages, s), now)) for s in sources}
    report = run_shops(tables.spark, jobs)
    return report.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], report
