"""Each check on a catalogue that passes all of them but, in turn, that one."""

import datetime

import pytest
from pyspark.sql import functions as F

from rigbook import fixed, schemas
from rigbook.operators import reports
from rigbook.operators.loading import fold_listing
from rigbook.operators.quality import quality_report, quality_summary
from rigbook.plans import profiles, refresh
from rigbook.session import scratch_path
from rigbook.sources.tables import CatalogueTables

NOW = datetime.datetime(2024, 3, 2, 12)
RECENT, OLD = NOW - datetime.timedelta(hours=24), NOW - datetime.timedelta(hours=24, seconds=1)
SPECS = ("AMD",) + (None,) * 13


def catalogue_rows():
    """Ten parts per shop, two of each of five categories, each with one recent price."""
    parts, log = [], []
    for source in fixed.PART_SOURCES:
        for i in range(10):
            key = f"{source}{i}"
            parts.append([key, source, str(i), "n", fixed.CATEGORIES[i % 5], "u", "t", SPECS, NOW, NOW])
            log.append([key, 5000, RECENT, None])
    return parts, log


def report(spark, parts, log):
    return quality_report(spark.createDataFrame(parts, schemas.PARTS),
                          spark.createDataFrame(log, schemas.PRICE_LOG), F.lit(NOW))


def failures(rows):
    return {(r["check_name"], r["subject"]) for r in rows.where("not ok").collect()}


def test_all_pass(spark):
    rows = report(spark, *catalogue_rows())
    assert failures(rows) == set()
    assert quality_summary(rows).first().asDict() == {"passed": 32, "total": 32, "ok": True}


def test_shop_without_parts(spark):
    parts, log = catalogue_rows()
    rows = report(spark, [p for p in parts if p[1] != "techarc.pk"],
                  [p for p in log if not p[0].startswith("techarc.pk")])
    assert failures(rows) == {("all_sources_present", "all"), ("source_has_parts", "techarc.pk"),
                              ("source_is_fresh", "techarc.pk")}
    # Its thumbnails are not judged.
    assert quality_summary(rows).first().asDict() == {"passed": 28, "total": 31, "ok": False}


def test_stale_shop(spark):
    parts, log = catalogue_rows()
    for entry in log:
        if entry[0].startswith("redtech.pk"):
            entry[2] = OLD
    assert failures(report(spark, parts, log)) == {("source_is_fresh", "redtech.pk")}


@pytest.mark.parametrize("source, without, ok", [
    ("redtech.pk", 3, True), ("redtech.pk", 4, False), ("amdhouse.pk", 9, True), ("amdhouse.pk", 10, False)])
def test_thumbnails(spark, source, without, ok):
    parts, log = catalogue_rows()
    for part in [p for p in parts if p[1] == source][:without]:
        part[6] = None
    assert failures(report(spark, parts, log)) == (set() if ok else {("source_thumbnails", source)})


@pytest.mark.parametrize("without, ok", [(18, True), (19, False)])
def test_spec_coverage(spark, without, ok):
    parts, log = catalogue_rows()
    for part in parts[:without]:
        part[7] = None
    assert failures(report(spark, parts, log)) == (set() if ok else {("spec_coverage", "all")})


@pytest.mark.parametrize("price, ok", [(99, False), (100, True), (2_000_000, True), (2_000_001, False),
                                       (None, True)])
def test_prices(spark, price, ok):
    parts, log = catalogue_rows()
    log[0][1] = price
    assert failures(report(spark, parts, log)) == (set() if ok else {("sane_prices", "all")})


def test_orphans(spark):
    parts, log = catalogue_rows()
    rows = report(spark, parts, log + [["gone", 5000, RECENT, None]])
    assert failures(rows) == {("no_orphan_prices", "all")}


def test_categories(spark):
    parts, log = catalogue_rows()
    for part in parts:
        part[4] = "gpu" if part[4] == "psu" else part[4]
    for part in parts:
        part[4] = "gpu" if part[4] == "hdd" else part[4]
    assert failures(report(spark, parts, log)) == {("distinct_categories", "all")}


def test_empty_catalogue(spark):
    rows = report(spark, [], [])
    assert ("spec_coverage", "all") in failures(rows)
    assert {r["total"] for r in rows.where("check_name = 'spec_coverage'").collect()} == {0}


def test_reports(spark):
    feed = spark.createDataFrame([("techarc.pk", "gpu"), ("techarc.pk", "gpu")], "source string, category string")
    assert [tuple(r) for r in reports.feed_counts(feed).collect()] == [("techarc.pk", "gpu", 2)]
    rows = {r["source"]: (r["n"], r["warning"]) for r in reports.source_report(feed).collect()}
    assert len(rows) == 9 and rows["techarc.pk"] == (2, False) and rows["redtech.pk"] == (0, True)
    parts, _ = catalogue_rows()
    coverage = reports.spec_coverage(spark.createDataFrame(parts, schemas.PARTS)).where("category = 'gpu'")
    assert coverage.first().asDict() == {"category": "gpu", "total": 18, "with_specs": 18, "with_brand": 18,
                                         "specs_percent": 100.0, "brand_percent": 100.0}


def stored_feed(spark, load, shops, times):
    """Rows of some shops, scraped at these times; some prices are out of range, some rows have no thumbnail."""
    rows = [(f"AMD Ryzen 5 {k}", 50 if (k + load) % 7 == 0 else 40_000 + k, f"https://{shop}/p{k}", fixed.CATEGORIES[(k + load) % 6], shop,
             time, "t" if k % 3 else None, (0, 0, load, 100 * k + n))
            for shop in shops for k in range(8) for n, time in enumerate(times)]
    return spark.createDataFrame(rows, schemas.FEED)


def test_report_from_profiles_equals_the_one_from_the_tables(spark):
    """After each load, after one that profiled nothing, with rows in the border hour, orphans and orphans adopted."""
    tables, now = CatalogueTables(spark, scratch_path(spark, "tables")), NOW + datetime.timedelta(minutes=20)
    border = now - datetime.timedelta(hours=24)
    second, hour = datetime.timedelta(seconds=1), datetime.timedelta(hours=1)

    def check():
        got = profiles.quality_from_profiles(tables, F.lit(now)).collect()
        want = quality_report(tables.parts(), tables.price_log(), F.lit(now)).collect()
        assert sorted(got) == sorted(want) and got
        return {(r.check_name, r.subject): r for r in got}

    assert not check()["no_orphan_prices", "all"].total
    shops = fixed.PART_SOURCES
    refresh.load_feed(tables, stored_feed(spark, 0, shops[:3], [border - hour, border - second, border, border + second]))
    assert profiles.profile_prices(tables) > 0 and profiles.profile_prices(tables) == 0
    assert check()["source_is_fresh", shops[0]].observed == 16 - 2 * 2      # prices under the floor are no rows
    refresh.load_feed(tables, stored_feed(spark, 1, shops[2:6], [NOW, border + hour, NOW - datetime.timedelta(days=40)]))
    refresh.load_feed(tables, stored_feed(spark, 1, shops[2:6], [NOW]))
    assert check()["no_orphan_prices", "all"].observed == 0
    later = stored_feed(spark, 2, shops[6:8], [border, NOW])
    rows = fold_listing(later).select("part_id", F.lit(1).alias("price_pkr").cast("long"), F.lit(border + second).alias("scraped_at"),
                                      F.trunc(F.lit(border), "month").alias("scraped_month"))
    tables.append_prices(rows)
    found = check()
    assert found["no_orphan_prices", "all"].observed == 16 and not found["sane_prices", "all"].ok
    again = tables.price_profiles().collect()
    tables.append_profiles(spark.createDataFrame(again, schemas.PRICE_PROFILES))      # two runs at the same time
    check()
    refresh.load_feed(tables, later)
    found = check()
    # One part of each shop stays away, as all its prices are under the floor.
    assert found["no_orphan_prices", "all"].observed == 2 and found["source_is_fresh", shops[6]].observed == 7 * 3


def test_profiles_spare_the_log(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    refresh.load_feed(tables, stored_feed(spark, 0, fixed.PART_SOURCES[:2], [NOW, NOW - datetime.timedelta(days=70)]))
    profiles.profile_prices(tables)
    plan = profiles.quality_from_profiles(tables, F.lit(NOW))._jdf.queryExecution().executedPlan().toString()
    log = [line for line in plan.splitlines() if "FileScan" in line and "scraped_at" in line]
    assert len(log) == 1 and "PartitionFilters: [isnotnull(scraped_month" in log[0]
    assert "GreaterThanOrEqual(scraped_at" in log[0] and "LessThan(scraped_at" in log[0]
