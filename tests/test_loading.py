"""Cleaning and merging, with the orders of rows that change results."""

import datetime

import pytest
from pyspark.sql import functions as F

from rigbook import schemas
from rigbook.operators import cleaning, loading
from rigbook.plans import catalogue, refresh
from rigbook.session import scratch_path
from rigbook.sources.tables import CatalogueTables

T1, T2, T3 = (datetime.datetime(2024, 1, d, 12) for d in (1, 2, 3))
SHOP = "czone.com.pk"


def row(name="Card", price=5000, url="https://s.pk/p/a", category="gpu", at=T1, thumb=None, pos=0,
        source=SHOP):
    return (name, price, url, category, source, at, thumb, (0, 0, 1, pos))


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.FEED)


def stored(spark):
    return CatalogueTables(spark, scratch_path(spark, "tables"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_reject_reasons(spark):
    rows = feed(spark, row(), row(price=None), row(price=3999), row(price=4000, name="GPU Holder"),
                row(category="hdd", price=1), row(category="psu", price=9000, name="Case With 300W"),
                row(category="case", price=9000, name="Case with 300W"),
                row(category="ram", price=999, name="usb drive"), row(category="toaster", price=1),
                row(category="monitor", name="Blu-Ray thing"))
    assert {r["reason"]: r["n"] for r in cleaning.reject_counts(rows).collect()} == {
        "no_price": 1, "below_floor": 2, "blocked_name": 3}
    assert cleaning.clean_feed(rows).count() == 4


@pytest.mark.parametrize("category", [None, ""])
def test_row_without_category_stops_the_batch(spark, category):
    tables = stored(spark)
    bad = feed(spark, row(pos=0), row(pos=1, category=category, price=None, name="lost"), row(pos=2))
    with pytest.raises(Exception, match="feed row without a category: lost"):
        refresh.load_feed(tables, bad)
    assert tables.parts().count() == 0 and tables.price_log().count() == 0


def test_same_key_and_time_twice_in_a_batch(spark):
    tables = stored(spark)
    batch = feed(spark, row("First", 5000, pos=0), row("Last", 6000, pos=1))
    assert refresh.load_feed(tables, batch, F.lit(T1)) == 1
    assert one(tables.parts())["name"] == "Last"
    assert one(tables.price_log())["price_pkr"] == 5000


def test_second_batch(spark):
    tables = stored(spark)
    refresh.load_feed(tables, feed(spark, row("Old Radeon", thumb="t1")), F.lit(T1))
    again = feed(spark, row("New thing", 7000, url="https://other.pk/p/a/", at=T2, category="ssd"))
    assert refresh.load_feed(tables, again, F.lit(T3)) == 1
    part = one(tables.parts())
    assert (part["name"], part["category"], part["url"], part["thumbnail_url"], part["specs"],
            part["created_at"], part["updated_at"]) == (
        "New thing", "ssd", "https://s.pk/p/a", "t1", None, T1, T3)
    assert one(tables.latest_prices())["price_pkr"] == 7000


def test_loading_again_adds_no_price(spark):
    tables, batch = stored(spark), feed(spark, row(pos=0), row(at=T2, pos=1))
    assert refresh.load_feed(tables, batch) == 2
    assert refresh.load_feed(tables, batch) == 0
    assert tables.price_log().count() == 2


def test_unrelated_parts_stay_as_they_are(spark):
    tables = stored(spark)
    refresh.load_feed(tables, feed(spark, row(), row(url="https://s.pk/p/b", pos=1)), F.lit(T1))
    refresh.load_feed(tables, feed(spark, row("Changed", at=T2)), F.lit(T2))
    names = {r["source_id"]: (r["name"], r["updated_at"]) for r in tables.parts().collect()}
    assert names == {"p-a": ("Changed", T2), "p-b": ("Card", T1)}


def test_large_batch_meets_the_log_in_one_join(spark, monkeypatch):
    log = loading.fold_prices(feed(spark, row(at=T1, price=4100), row(at=T2, url="https://s.pk/p/b")))
    batch = feed(spark, row(at=T1), row(at=T2), row(at=None), row(at=T2, url="https://s.pk/p/b"), row(at=T2, price=9000, pos=1),
                 row(at=T1, url="https://s.pk/p/c"))
    plans, found = [], []
    for small in (loading.SMALL_BATCH, 0):
        monkeypatch.setattr(loading, "SMALL_BATCH", small)
        new = loading.new_prices(log, batch)
        found.append(sorted((r.part_id, r.scraped_at, r.price_pkr) for r in new.collect()))
        plans.append(new._jdf.queryExecution().optimizedPlan().toString())
    assert found[0] == found[1] and len(found[0]) == 2
    assert [plan.count("Join Left") for plan in plans] == [2, 1]


def test_names_are_tested_in_compiled_code(spark):
    """The name is made lower once, and no lambda, which Spark interprets, goes through the terms."""
    rows = feed(spark, row(name=None), row(name="Gpu HOLDER"), row()).withColumn("name", F.initcap("name"))
    plan = cleaning.clean_feed(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("lower(") == 1
    assert sorted(r["name"] or "" for r in cleaning.clean_feed(rows).collect()) == ["", "Card"]


def test_folds_of_wide_rows_read_small_pieces(spark, tmp_path):
    many = spark.range(3_000_000).select(F.expr("uuid()").alias("url"), F.lit(SHOP).alias("source"))
    many = many.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.PREBUILT_FEED if f.name not in many.columns})
    many.coalesce(1).write.option("parquet.block.size", str(4 << 20)).parquet(str(tmp_path / "feed"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    try:
        loading.fold_prebuilts(spark.read.parquet(str(tmp_path / "feed")))
        assert spark.read.parquet(str(tmp_path / "feed")).rdd.getNumPartitions() >= 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_last_known_thumbnail_wins(spark):
    parts = loading.fold_parts(feed(spark, row(thumb="a", pos=0), row(thumb="b", pos=1), row(pos=2)))
    assert one(parts)["thumbnail_url"] == "b"


def test_empty_urls_of_a_shop_are_one_part(spark):
    parts = loading.fold_parts(feed(spark, row(url="", pos=0), row(url="", pos=1),
                                    row(url="", source="redtech.pk", pos=2)))
    assert parts.count() == 2


def test_later_category_overwrites(spark):
    parts = loading.fold_parts(feed(spark, row(category="gpu", pos=0), row(category="cpu", pos=1)))
    assert one(parts)["category"] == "cpu"


def prebuilt(name="PC", price=100, at=T1, thumb=None, cpu="Ryzen", pos=0):
    parts = (cpu,) + (None,) * 9 if cpu else None
    return (name, price, "https://z/p/x", "zestrogaming.com", at, thumb, parts, (0, 0, 1, pos))


def prebuilts(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PREBUILT_FEED)


def test_prebuilt_without_price_replaces_one_with(spark):
    tables = stored(spark)
    refresh.load_prebuilts(tables, prebuilts(spark, prebuilt(thumb="t")), F.lit(T1))
    batch = prebuilts(spark, prebuilt("PC 2", None, T2, None, None), prebuilt("PC 3", None, T3, None, None, 1))
    assert refresh.load_prebuilts(tables, batch, F.lit(T2)) == 2
    r = one(tables.prebuilts())
    assert (r["name"], r["price_pkr"], r["thumbnail_url"], r["components"], r["scraped_at"],
            r["created_at"], r["updated_at"]) == ("PC 3", None, "t", None, T3, T1, T2)


def test_hot_key_is_folded_before_the_shuffle(spark):
    rows = spark.range(1).select(F.lit("x").alias("part_id"), F.lit(1).cast("bigint").alias("price_pkr"),
                                 F.current_timestamp().alias("scraped_at"))
    plan = catalogue.latest_prices(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "HashAggregate" in plan


def test_backfill_changes_nothing_the_second_time(spark):
    parts = spark.createDataFrame(
        [("1", SHOP, "a", "WD Blue 1TB NVMe", "ssd", "u", None, None, T1, T1)], schemas.PARTS)
    once = loading.backfill_specs(parts)
    assert one(once)["specs"]["capacity"] == "1TB"
    assert loading.backfill_specs(once).collect() == once.collect()
