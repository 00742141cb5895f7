"""How often rows are shuffled, computed and parsed, and over how many tasks they are dealt."""

import datetime
import hashlib
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rigbook import fixed, schemas
from rigbook.operators.loading import fold_listing, fold_parts, fold_prices, latest_prices
from rigbook.plans import builds
from rigbook.plans.builds import resolve_builds
from rigbook.session import cut_lineage, freeing_shuffles, scratch_path
from rigbook.sources.files import from_json_text, read_pages, write_json, write_pages
from rigbook.sources.tables import CatalogueTables
from samples import catalogue_queries, markup
from samples.feed import part_lists

DAY = datetime.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def sample(spark, tmp_path):
    """A few parts and line items of our own."""
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("red cold part").alias("p_name"),
                           F.lit(900.5).alias("p_retailprice"), F.lit(3).alias("p_size")).write.parquet(
        str(tmp_path / "part.parquet"))
    k = F.col("id")
    spark.range(400).select(
        (k / 4).cast("bigint").alias("l_orderkey"), (k % 4 + 1).cast("int").alias("l_linenumber"),
        (k % 40).alias("l_partkey"), (k % 9).alias("l_suppkey"), F.lit(5.0).alias("l_quantity"),
        (k * 100.0 + 50000).alias("l_extendedprice"), F.lit("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.timestamp_seconds(k * 86400).alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_the_arriving_feed_is_dealt_out_as_widely_as_any_shuffle(spark, sample, monkeypatch):
    written, write = [], catalogue_queries.write_json
    monkeypatch.setattr(catalogue_queries, "write_json", lambda rows, path: (written.append(rows), write(rows, path)))
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalogue_queries.incremental_load(spark, sample)
        assert written[0].rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("name", ["export_roundtrip", "incremental_load"])
def test_exported_feeds_are_compressed(spark, sample, monkeypatch, name):
    paths, write = [], catalogue_queries.write_json
    monkeypatch.setattr(catalogue_queries, "write_json", lambda rows, path: (paths.append(path), write(rows, path)))
    assert getattr(catalogue_queries, name)(spark, sample).count() >= 390
    assert all(f.endswith(".json.gz") for f in spark.read.schema(schemas.FEED).json(paths[0]).inputFiles())
    assert spark.read.schema(schemas.FEED).json(paths[0]).count() == 400


def test_parts_and_latest_prices_come_from_one_shuffle(spark):
    draw = random.Random(5)
    seqs = list(range(300))
    draw.shuffle(seqs)
    rows = [(f"Card {k}", draw.choice([None, 5000 + k]), draw.choice(["https://s.pk/p/a", "https://s.pk/p/b/", None]),
             "gpu", draw.choice(["x.pk", "y.pk"]), draw.choice([None, *(DAY + datetime.timedelta(d) for d in range(3))]),
             None, draw.choice([None, (0, draw.choice([None, 0]), 1, k)])) for k in seqs]
    feed = cut_lineage(spark.createDataFrame(rows, schemas.FEED))
    folded = fold_listing(feed)
    assert plan_of(folded).count("Exchange hashpartitioning") == 1
    latest = latest_prices(fold_prices(feed)).withColumnRenamed("scraped_at", "priced_at")
    columns = folded.columns
    assert (sorted(map(str, folded.collect()))
            == sorted(map(str, fold_parts(feed).join(latest, "part_id", "left").select(columns).collect())))


def test_prices_are_shuffled_by_short_keys(spark):
    rows = [(f"Card {k}", 5000 + k, f"https://s.pk/p/{k % 3}", "gpu", "x.pk", DAY, None, (0, 0, 1, k)) for k in range(9)]
    folded = fold_prices(cut_lineage(spark.createDataFrame(rows, schemas.FEED)))
    dealt = re.findall(r"Exchange hashpartitioning\((.*?)\)", plan_of(folded))
    assert [d.split("#")[0] for d in dealt] == ["key"] and "unhex(md5(" in optimized(folded)
    assert sorted((r.part_id, r.price_pkr) for r in folded.collect()) == sorted(
        (hashlib.md5(f"x.pk/p-{k}".encode()).hexdigest(), 5000 + k) for k in range(3))


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(k)) for k in range(blocks.size()) if str(blocks.apply(k)).startswith("shuffle_")}


def test_a_written_table_leaves_nothing_shuffled_behind(spark):
    def left(rows, write):
        before = shuffle_files(spark)
        write(rows.repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
        for _ in range(50):     # files are removed behind the query's back
            if not shuffle_files(spark) - before:
                return 0
            time.sleep(0.1)
        return len(shuffle_files(spark) - before)

    tables, rows = CatalogueTables(spark, scratch_path(spark, "tables")), spark.range(1000)
    assert left(rows, cut_lineage) == 0
    assert left(rows, lambda df: write_json(df, scratch_path(spark, "export"))) == 0
    price = F.col("count").cast("bigint")
    assert left(rows, lambda df: tables.append_prices(df.select(
        F.col("k").cast("string").alias("part_id"), price.alias("price_pkr"), F.lit(DAY).alias("scraped_at"),
        F.lit(DAY.date()).alias("scraped_month")))) == 0


def test_shuffles_are_freed_until_the_last_writer_leaves(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    first, second = freeing_shuffles(spark), freeing_shuffles(spark)
    first.__enter__(), second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(key, None) == before


def test_joins_with_tables_that_do_not_exist_yet_are_dropped(spark):
    tables, keys = CatalogueTables(spark, scratch_path(spark, "tables")), spark.range(9).select(
        F.col("id").cast("string").alias("part_id"))
    for empty in (tables.listing(), tables.price_log()):
        assert "Join" not in optimized(empty.join(keys, "part_id"))
        assert "Join" not in optimized(keys.join(empty, "part_id", "left_anti"))


def test_json_text_is_parsed_once_in_each_form(spark):
    texts = ['{"brand": "ASUS"}', "{}", '{"brand": "ASUS"}]x', None]
    rows = cut_lineage(spark.createDataFrame([(t,) for t in texts], "t string"))
    read = rows.select(from_json_text(F.col("t"), schemas.SPECS).alias("specs"))
    assert optimized(read).count("from_json(") == 2
    assert sorted(r.specs.brand for r in read.collect() if r.specs) == ["ASUS"] and read.count() == 4


def test_pages_are_rendered_by_many_tasks(spark, sample):
    pages = markup.detail_pages(spark, sample, "techmatched.pk")
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert pages.count() == 40


def test_part_lists_are_made_once(spark):
    lists = spark.createDataFrame([("c1", {"cpu": "p1", "gpu": "p2"}), ("c2", {"cpu": "p1"})],
                                  "code string, slots map<string,string>")
    parts = spark.createDataFrame(
        [(p, "s", p, p, "gpu", "u", None, None, DAY, DAY) for p in ("p1", "p2")], schemas.PARTS)
    latest = spark.createDataFrame([("p1", 5, DAY), ("p2", 6, DAY)], schemas.LATEST_PRICES)
    found = resolve_builds(lists, parts, latest)
    assert "Generate" not in plan_of(found)
    assert sorted((r.code, r.slot, r.price_pkr) for r in found.collect()) == [
        ("c1", "cpu", 5), ("c1", "gpu", 6), ("c2", "cpu", 5)]


def test_part_lists_are_shuffled_once_by_list(spark, sample):
    lists = part_lists(spark, sample)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(lists))
    assert [d.split("#")[0] for d in dealt] == ["build_id"]
    found = {r.build_id: r.slots for r in lists.collect()}

    def key(k):
        return hashlib.md5(f"{fixed.PART_SOURCES[k % 9 % len(fixed.PART_SOURCES)]}/product-red-cold-part-{k % 40}".encode()).hexdigest()
    assert len(found) == 100 and all(
        slots == {fixed.BUILD_SLOTS[k % 4 + 1]: key(k) for k in range(4 * b, 4 * b + 4)} for b, slots in found.items())


def test_a_line_without_a_slot_fails_the_part_lists(spark, sample, tmp_path):
    other = tmp_path / "other"
    items = spark.read.parquet(f"{sample}/lineitem.parquet")
    spark.read.parquet(f"{sample}/part.parquet").write.parquet(str(other / "part.parquet"))
    items.withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(3))).write.parquet(str(other / "lineitem.parquet"))
    with pytest.raises(Exception, match="no slot"):
        part_lists(spark, str(other)).collect()


def test_slots_of_different_lists_meet_only_if_codes_repeat(spark, monkeypatch):
    cuts, cut = [], builds.cut_lineage
    monkeypatch.setattr(builds, "cut_lineage", lambda df: cuts.append(optimized(df)) or cut(df))
    parts = spark.createDataFrame([("p1", "s", "p1", "p1", "gpu", "u", None, None, DAY, DAY)], schemas.PARTS)
    latest = spark.createDataFrame([("p1", 5, DAY)], schemas.LATEST_PRICES)
    for codes, expected in ((("c1", "c2"), [("c1", "gpu"), ("c2", "gpu")]), (("c1", "c1"), [("c1", "gpu")])):
        cuts.clear()
        lists = spark.createDataFrame([(c, {"cpu": "p1", "gpu": "p1"}) for c in codes], "code string, slots map<string,string>")
        found = resolve_builds(lists, parts, latest)
        assert sum("Aggregate [code" in plan for plan in cuts) == (len(set(codes)) == 1)
        assert sorted((r.code, r.slot) for r in found.collect()) == expected


def test_pages_are_dealt_out_before_their_cards_are_made(spark, sample):
    """What is shuffled are facts; the text of a card is neither shuffled nor made where its page is not."""
    plan = plan_of(markup.listing_pages(spark, sample, "amdhouse.pk"))
    before, dealt, narrow = plan.partition("Exchange hashpartitioning")
    assert dealt and "wp-content" in before and "wp-content" not in narrow and "Exchange hashpartitioning" not in narrow


def test_stored_pages_can_be_read_by_many_tasks(spark, tmp_path):
    html = F.concat(*[F.sha2((F.col("id") * 100 + k).cast("string"), 256) for k in range(60)])
    rows = spark.range(0, 2000, 1, 1).select(
        F.lit("a.pk").alias("source"), F.lit("s").alias("seed_url"), F.lit(1).alias("page"), F.lit("u").alias("url"),
        html.alias("html"), F.lit(None).cast("timestamp").alias("fetched_at"))
    path = str(tmp_path / "pages")
    write_pages(rows, path)
    groups = [pq.ParquetFile(f).num_row_groups for f in (tmp_path / "pages").rglob("*.parquet")]
    assert sum(groups) > 1 and read_pages(spark, path).count() == 2000
