"""Pages by counting, the index of names, and what listings read of the stored tables."""

import datetime
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rigbook import fixed, schemas, session
from rigbook.functions.text import name_matches
from rigbook.plans import builds, catalogue, name_index, paging, refresh
from rigbook.session import scratch_path
from rigbook.sources.tables import CatalogueTables

T1 = datetime.datetime(2024, 1, 1)


def listing(spark, rows):
    """From (source, source_id, name, category, price)."""
    full = [(f"{s}/{i}", s, i, n, c, "u", None, None, T1, T1, p, T1) for s, i, n, c, p in rows]
    return spark.createDataFrame(full, schemas.LISTING)


def plan_of(df, *, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scans of a plan put out."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif "QueryStage" in name:
            waiting.append(node.plan())
        elif name == "FileSourceScanExec":
            rows += node.metrics().apply("numOutputRows").value()
        waiting += [node.children().apply(k) for k in range(node.children().size())]
    return rows


# -- pages by counting -----------------------------------------------------------------------------------

def random_listing(draw, n, prices, sources=("a", "b", "c"), stem=""):
    ids = draw.sample(range(10 * n), n)
    return [(draw.choice(sources), f"{stem}{k}", f"n{k}", "cpu", draw.choice(prices)) for k in ids]


@pytest.mark.parametrize("prices, stem", [(range(1, 10**6), ""), ([7], "product-"), ([7] * 50 + [1, 9, 10**15, -10**15], "é")])
def test_deep_pages_are_those_of_sorting(spark, prices, stem):
    draw = random.Random(len(stem))
    rows = random_listing(draw, 900, list(prices), stem=stem)
    table = listing(spark, rows).cache()
    for sort, sign in (("price_asc", 1), ("price_desc", -1)):
        ordered = sorted(rows, key=lambda r: (sign * r[4], r[0], r[1]))
        for offset in (0, 1, 449, 700, 890, 899, 900, 5000):
            page = paging.deep_page(table, sort, 20, offset, few=25)
            assert [(r.source, r.source_id) for r in page.collect()] == [r[:2] for r in ordered[offset:offset + 20]]
    table.unpersist()
    assert paging.deep_page(table.limit(0), "price_asc", 5, 0).collect() == []


def test_deep_pages_sort_one_band(spark, monkeypatch):
    """The final sort gets the rows from the page's band on, and each task keeps few of them."""
    draw = random.Random(1)
    rows = random_listing(draw, 2000, range(1, 10**6))
    rest, skip = paging.narrowed(listing(spark, rows).withColumn("key", F.col("price_pkr")), 1900, 50)
    assert skip < 50 and rest.count() <= 150
    page = paging.deep_page(listing(spark, rows), "price_asc", 20, 1900, few=50)
    kept = int(re.search(r"TakeOrderedAndProject\(limit=(\d+)", plan_of(page)).group(1))
    assert kept <= 70
    # Listings take this way by themselves once the offset is large.
    monkeypatch.setattr(catalogue, "FEW", 100)
    near, far = (catalogue.list_parts(listing(spark, rows), limit=10, offset=k) for k in (100, 101))
    assert [r.source_id for r in near.collect()][1:] == [r.source_id for r in far.collect()][:-1]


# -- the index of names ----------------------------------------------------------------------------------

NAMES = ["MSI RTX 4060", "msi rtx 4070 Ti", "ASUS Röntgen-KARTE", "röntgen", "RÖNTGEN", "", None, "x", "ab", "100% RTX", "a_b rtx",
         "Straße 4060", "日本製 RTX", "rt x 4060", "İstanbul rtx", "K rtx"]


@pytest.mark.parametrize("query", ["rtx", "RTX 40", "rtx%ti", "r_x", "öntgen", "ÖNTGEN", "%", "4060", "msi%4060", "日本製", "nothing like",
                                   "a_b", "100%", "x", "k rtx", "i", "RTX_4060", "straße%60"])
def test_index_finds_what_reading_all_names_finds(spark, query, tmp_path_factory):
    rows = [("s", str(k), n, "gpu", k) for k, n in enumerate(NAMES)] + [("s", f"f{k}", f"filler {k}", "gpu", 1) for k in range(300)]
    table = listing(spark, rows)
    path = str(tmp_path_factory.getbasetemp() / "names")
    if query == "rtx":
        name_index.write_index(table, path)
    expected = {r.part_id for r in table.where(name_matches(F.col("name"), query)).collect()}
    assert {r.part_id for r in name_index.search(table, path, query).collect()} == expected


def test_index_reads_few_postings_and_verifies_candidates_alone(spark):
    rows = [("s", str(k), f"card {k} {'needle' if k == 1234 else 'plain'}", "gpu", 1) for k in range(20_000)]
    table, path = listing(spark, rows), scratch_path(spark, "names")
    name_index.write_index(table, path)
    postings, counts = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "counts"))
    found = name_index.candidates(postings, counts, "NEEDLE", total=20_000)
    assert [r.part_id for r in found.collect()] == ["s/1234"]
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram," in plan_of(found)
    assert scanned(found) < 0.05 * postings.count()
    # Trigrams of all names are of no use.
    assert name_index.candidates(postings, counts, "card", total=20_000) is None
    assert name_index.candidates(postings, counts, "no", total=20_000) is None
    assert name_index.candidates(postings, counts, "card % nee", total=20_000).count() == 1
    search = name_index.search(table, path, "needle")
    assert search.count() == 1 and "Join" in plan_of(search)


def test_index_grows_with_the_text_and_not_with_the_keys(spark):
    """Keys that cannot be compressed stand in the index once for each part, not once for each trigram."""
    rows = spark.range(0, 5000, 1, 3).select(
        F.sha2(F.col("id").cast("string"), 256).alias("part_id"),
        F.concat(F.lit("graphics card with a longer name "), F.col("id")).alias("name"))
    path, before = scratch_path(spark, "names"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    name_index.write_index(rows, path)
    postings = spark.read.parquet(f"{path}/postings").where("gram is not null").count()
    written = sum(f.stat().st_size for f in Path(f"{path}/postings".removeprefix("file:")).rglob("*.parquet"))
    assert postings > 150_000 and written < 64 * 5000 + 4 * postings
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    found = name_index.candidates(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "counts")), "e 4321")
    expected = rows.where("name like '%e 4321%'").select("part_id")
    assert found.collect() == expected.collect() != []


def test_trigrams_of_texts(spark):
    texts = ["abcabc", "ab", "", None, "日本製品", "x😀y😀z", "a\nb c", "ÄÖ\u0301Ü"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[0] for r in rows.orderBy("k").select(name_index.trigrams(F.col("t"))).collect()] == [
        None if t is None else list(dict.fromkeys(t[k:k + 3] for k in range(len(t) - 2))) for t in texts]


def test_trigrams(spark):
    assert name_index.grams_of("RTX%4060_Ti Ö") == sorted(["060", "406", "rtx", "ti ", "i Ö"])
    assert name_index.grams_of("a%b_cd") == []


# -- what is read ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def stored(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    draw = random.Random(5)
    rows = [(draw.choice(fixed.PART_SOURCES), str(k), f"part {k}", draw.choice(fixed.CATEGORIES), draw.randrange(10**5))
            for k in range(3000)]
    table = listing(spark, rows)
    tables.replace_parts(table)
    return tables, rows


def test_listings_are_one_pruned_scan(spark, stored):
    tables, rows = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")     # of a plan's text
    page = catalogue.list_parts(tables.listing(), category="gpu", source="redtech.pk", min_price=500, limit=10)
    text = plan_of(page)
    assert "Join" not in text and text.count("FileScan") == 1
    assert all(f in text for f in ("EqualTo(category,gpu)", "EqualTo(source,redtech.pk)", "GreaterThanOrEqual(price_pkr,500)"))
    expected = sorted((p, i) for s, i, _, c, p in rows if s == "redtech.pk" and c == "gpu" and p >= 500)[:10]
    assert [(r.price_pkr, r.source_id) for r in page.collect()] == expected
    total = catalogue.count_parts(tables.listing(), category="gpu")
    assert "Join" not in plan_of(total) and total.first()["total"] == sum(r[3] == "gpu" for r in rows)
    assert "name" not in re.search(r"ReadSchema: .*", plan_of(total)).group()


def test_history_reads_a_few_rows_of_the_log(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    rows = spark.range(500_000).select(
        F.md5((F.col("id") % 50_000).cast("string")).alias("part_id"), F.col("id").alias("price_pkr"),
        (F.lit(T1) + F.make_interval(days=(F.col("id") / 50_000).cast("int") * 20)).alias("scraped_at"))
    log = rows.withColumn("scraped_month", F.trunc("scraped_at", "month")).select(schemas.PRICE_LOG.names)
    assert tables.append_prices(log) == 500_000
    key = spark.range(1).select(F.md5(F.lit("77"))).first()[0]
    one = tables.price_log().where(F.col("part_id") == key).select("price_pkr", "scraped_at")
    assert sorted(r.price_pkr for r in one.collect()) == [77 + 50_000 * k for k in range(10)]
    assert scanned(one) < 0.05 * 500_000
    assert tables.price_log().where("part_id = 'not there'").isEmpty()


def test_a_part_with_most_of_a_months_rows_is_cut(spark, monkeypatch):
    monkeypatch.setitem(session.SETTINGS, "spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables = CatalogueTables(session.configure(spark), scratch_path(spark, "tables"))
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("part_id"),
        F.col("id").alias("price_pkr"), (F.lit(T1) + F.make_interval(secs=F.col("id"))).alias("scraped_at"),
        F.lit(datetime.date(2024, 1, 1)).alias("scraped_month"))
    tables.append_prices(rows.repartition(4).select(schemas.PRICE_LOG.names))
    monkeypatch.undo()
    session.configure(spark)
    per_file = (spark.read.parquet(f"{tables.root}/price_log").where("part_id = 'hot'")
                .groupBy(F.input_file_name()).count().collect())
    assert len(per_file) > 1


# -- counts kept with the buckets ------------------------------------------------------------------------

def test_counts_after_loads_that_move_parts(spark):
    """Names, and with them specifications, and categories change from load to load."""
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    draw = random.Random(8)
    names = ["MSI RTX 4060 8GB", "ASUS Radeon RX 6600 8GB", "Corsair 16GB DDR5 6000MHz", "Zotac GTX 1660"]

    def same():
        for counted, whole in ((tables.part_counts(), tables.parts()), (tables.prebuilt_counts(), tables.prebuilts())):
            stats = catalogue.catalogue_stats if "category" in whole.columns else lambda rows, _: catalogue.prebuilt_stats(rows)
            assert sorted(map(tuple, stats(counted, tables.price_log()).collect()), key=str) == sorted(
                map(tuple, stats(whole, tables.price_log()).collect()), key=str)
        assert catalogue.facet_values(tables.part_counts()).collect() == catalogue.facet_values(tables.parts()).collect()
    same()
    for load in range(3):
        rows = [(draw.choice(names), 50_000, f"https://s/{draw.randrange(40)}", draw.choice(["gpu", "ram", "ssd"]),
                 draw.choice(["techarc.pk", "redtech.pk"] if load < 2 else ["redtech.pk"]),
                 T1 + datetime.timedelta(days=load), None, (0, 0, 1, k)) for k in range(30)]
        refresh.load_feed(tables, spark.createDataFrame(rows, schemas.FEED))
        same()
    systems = spark.createDataFrame([(f"PC {k}", 1, f"https://s/{k}", draw.choice(["a", "b"]), T1, None, None, (0, 0, 1, k))
                                     for k in range(9)], schemas.PREBUILT_FEED)
    assert refresh.load_prebuilts(tables, systems) == 9
    tables.keep_last("parts")
    same()
    assert catalogue.catalogue_stats(tables.part_counts(), tables.price_log()).first().n > 0
    assert "part_id" not in plan_of(tables.part_counts())


def test_one_code(spark, stored):
    tables, rows = stored
    ids = [f"{s}/{i}" for s, i, *_ in rows[:3]]
    shared = spark.createDataFrame([("abc123", {"cpu": ids[0], "gpu": ids[1], "ram": ids[0], "psu": "gone", "case": None}, T1),
                                    ("empty1", {"cpu": "gone"}, T1), ("nothin", {"cpu": None}, T1)], schemas.SHARED_BUILDS)
    listing = tables.listing()
    found = builds.resolve_build(shared, "abc123", listing)
    assert sorted((r.slot, r.part_id) for r in found.collect()) == [("gpu", ids[1]), ("ram", ids[0])]
    whole = builds.resolve_builds(shared.where("code = 'abc123'"), tables.parts(), tables.latest_prices())
    assert found.columns == whole.columns and sorted(found.collect()) == sorted(whole.collect())
    assert "Join" not in plan_of(found) and "In(part_id" in plan_of(found)
    assert builds.resolve_build(shared, "empty1", listing).collect() == builds.resolve_build(shared, "nothin", listing).collect() == []
    assert builds.resolve_build(shared, "zzzzzz", listing) is None
