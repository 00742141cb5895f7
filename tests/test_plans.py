"""Listings, facets, history, counts, and saved part lists."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rigbook import fixed, schemas
from rigbook.plans import builds, catalogue, prebuilts

T1, T2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)


def specs(**values):
    return tuple(values.get(f) for f in fixed.SPEC_FIELDS)


@pytest.fixture(scope="module")
def parts(spark):
    rows = [
        ("1", "techarc.pk", "a", "Ryzen 5", "cpu", "u", None, specs(brand="AMD", socket="AM5"), T1, T1),
        ("2", "techarc.pk", "b", "Core i5", "cpu", "u", None, specs(brand="Intel", socket=""), T1, T1),
        ("3", "redtech.pk", "c", "Some Case", "case", "u", None, specs(brand="NZXT", form_factor="ATX"), T1, T1),
        ("4", "redtech.pk", "d", "No price", "cpu", "u", None, None, T1, T1),
        ("5", "redtech.pk", "e", "Never logged", "cpu", "u", None, None, T1, T1),
    ]
    return spark.createDataFrame(rows, schemas.PARTS)


@pytest.fixture(scope="module")
def log(spark):
    month = datetime.date(2024, 1, 1)
    rows = [("1", 900, T1, month), ("1", 1000, T2, month), ("2", 1000, T1, month), ("3", 500, T1, month),
            ("4", 700, T1, month), ("4", None, T2, month), ("9", 1, T1, month)]
    return spark.createDataFrame(rows, schemas.PRICE_LOG)


@pytest.fixture(scope="module")
def latest(log):
    return catalogue.latest_prices(log)


def ids(df):
    return [r["part_id"] for r in df.collect()]


def test_listing_takes_the_latest_price_only(parts, latest):
    assert ids(catalogue.list_parts(parts, latest)) == ["3", "1", "2"]
    assert ids(catalogue.list_parts(parts, latest, max_price=900)) == ["3"]
    assert ids(catalogue.list_parts(parts, latest, min_price=1000, max_price=1000)) == ["1", "2"]


def test_sort_and_page(parts, latest):
    assert ids(catalogue.list_parts(parts, latest, sort="price_desc", limit=2)) == ["1", "2"]
    assert ids(catalogue.list_parts(parts, latest, sort="price_desc", limit=2, offset=2)) == ["3"]
    assert catalogue.count_parts(parts, latest).first()["total"] == 3


def test_filters(parts, latest):
    assert ids(catalogue.list_parts(parts, latest, category="", source="nowhere", q="")) == ["3", "1", "2"]
    assert ids(catalogue.list_parts(parts, latest, category="cpu", source="techarc.pk", q="RYZ")) == ["1"]
    assert ids(catalogue.list_parts(parts, latest, specs={"brand": "AMD", "nonsense": "x", "vram": None})) == ["1"]


@pytest.mark.parametrize("arguments", [
    {"category": "toaster"}, {"limit": 0}, {"limit": 101}, {"offset": -1}, {"min_price": -1},
    {"max_price": -5}, {"sort": "name"}])
def test_bad_arguments(parts, latest, arguments):
    with pytest.raises(ValueError):
        catalogue.list_parts(parts, latest, **arguments)


def test_price_filter_stays_above_the_choice_of_the_latest_row(parts, log):
    plan = catalogue.list_parts(parts, catalogue.latest_prices(log), max_price=900)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("<= 900") < text.index("Aggregate")


def test_filters_reach_the_scan(spark, parts, latest, tmp_path):
    path = str(tmp_path / "parts")
    parts.write.parquet(path)
    stored = spark.read.schema(schemas.PARTS).parquet(path)
    listing = catalogue.list_parts(stored, latest, category="cpu", specs={"brand": "AMD"})
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(category,cpu)" in plan and "EqualTo(specs.brand,AMD)" in plan
    assert "TakeOrderedAndProject" in plan


def test_facets(parts):
    rows = [tuple(r) for r in catalogue.facet_values(parts).collect()]
    assert rows == [("case", "brand", "NZXT"), ("case", "form_factor", "ATX"), ("cpu", "brand", "AMD"),
                    ("cpu", "brand", "Intel"), ("cpu", "socket", "AM5")]
    assert catalogue.facet_values(parts, "case").count() == 2


def test_history(spark, log):
    key = spark.range(1).select(F.md5(F.lit("s/a"))).first()[0]
    part = spark.createDataFrame([(key, "s", "a", "n", "cpu", "u", None, None, T1, T1)], schemas.PARTS)
    prices = spark.createDataFrame([(key, 2, T2, None), (key, 1, T1, None)], schemas.PRICE_LOG)
    assert [r["price_pkr"] for r in catalogue.price_history(part, prices, "s", "a").collect()] == [1, 2]
    assert catalogue.price_history(part, prices, "s", "b").count() == 0
    assert catalogue.price_history(part.limit(0), prices, "s", "a").count() == 0


def test_stats(parts, log):
    rows = {(r["metric"], r["value"]): r["n"] for r in catalogue.catalogue_stats(parts, log).collect()}
    assert rows == {("total_parts", None): 5, ("total_price_rows", None): 7, ("by_source", "techarc.pk"): 2,
                    ("by_source", "redtech.pk"): 3, ("by_category", "cpu"): 4, ("by_category", "case"): 1}
    empty = {(r["metric"], r["n"]) for r in catalogue.catalogue_stats(parts.limit(0), log.limit(0)).collect()}
    assert empty == {("total_parts", 0), ("total_price_rows", 0)}


def test_prebuilt_brands(spark):
    def system(i, price, cpu, gpu):
        return (str(i), "redtech.pk", str(i), f"PC {i}", "u", None, price,
                (cpu, gpu) + (None,) * 8 if cpu or gpu else None, T1, T1, T1)
    rows = spark.createDataFrame([
        system(1, 10, "RYZEN 5", "GTX 1"), system(2, 20, "Core I5", "Radeon"), system(3, 30, None, None),
        system(4, None, "AMD", "RTX"), system(5, 40, "Xeon", "Intel Arc")], schemas.PREBUILTS)
    def found(**arguments):
        return [r["prebuilt_id"] for r in prebuilts.list_prebuilts(rows, **arguments).collect()]
    assert found() == ["1", "2", "3", "5"] and found(cpu_brand="AMD") == ["1"]
    assert found(cpu_brand="intel") == ["2"] and found(gpu_brand="nvidia") == ["1"]
    assert found(gpu_brand="amd") == ["2"] and found(gpu_brand="intel") == ["5"]
    assert found(gpu_brand="voodoo", limit=200) == ["1", "2", "3", "5"]
    assert found(source="nowhere") == []
    assert prebuilts.get_prebuilt(rows, "4").count() == 1
    with pytest.raises(ValueError):
        found(limit=201)


# -- saved part lists ------------------------------------------------------------------------------------

def lists(spark, *slots):
    return spark.createDataFrame(list(enumerate(slots)), "build_id bigint, slots map<string,string>")


def shared(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SHARED_BUILDS)


def test_codes_are_unique_and_well_formed(spark):
    many = spark.range(2000).select(F.col("id").alias("build_id"), F.create_map(
        F.lit("cpu"), F.lit("1"), F.lit("gpu"), F.lit(None).cast("string")).alias("slots"))
    saved = builds.save_builds(many, shared(spark), F.lit(T1))
    rows = saved.where(builds.is_valid_code(F.col("code"))).collect()
    assert len({r["code"] for r in rows}) == 2000 and rows[0]["slots"] == {"cpu": "1"}
    assert len(Counter("".join(r["code"] for r in rows))) == 62
    other = builds.save_builds(many, shared(spark), F.lit(T1))
    assert other.join(saved, "code").count() < 5  # another salt, other codes


def test_taken_codes_are_tried_again(spark, monkeypatch):
    def code(salt, build_id, attempt):
        """Lists meet in their first code, the odd ones also in their second."""
        return F.when(F.lit(attempt) == 0, "aaaaaa").when(
            (F.lit(attempt) == 1) & (build_id % 2 == 1), "bbbbbb").otherwise(
            F.concat(F.lit(f"cccc{attempt}"), build_id.cast("string")))
    monkeypatch.setattr(builds, "_code", code)
    taken = shared(spark, ("bbbbbb", {"cpu": "1"}, T1))
    saved = builds.save_builds(lists(spark, *[{"cpu": "1"}] * 4), taken, F.lit(T1)).collect()
    assert {r["build_id"]: r["code"] for r in saved} == {0: "aaaaaa", 1: "cccc21", 2: "cccc12", 3: "cccc23"}


def test_no_free_code(spark, monkeypatch):
    monkeypatch.setattr(builds, "_code", lambda salt, build_id, attempt: F.lit("aaaaaa"))
    with pytest.raises(RuntimeError, match="10 attempts"):
        builds.save_builds(lists(spark, {"cpu": "1"}, {"cpu": "2"}), shared(spark), F.lit(T1))


def test_codes_of_a_range_are_a_permutation(spark):
    edges = [0, 1, builds.HALF - 1, builds.HALF, builds.HALF + 1, builds.CODES - 2, builds.CODES - 1]
    numbers = spark.range(300_000).unionByName(spark.createDataFrame([(n,) for n in edges[3:]], "id long"))
    coded = numbers.select("id", builds.code_of(F.col("id"), "key").alias("code"))
    found = coded.select("id", "code", builds.number_of(F.col("code"), "key").alias("back"),
                         builds.number_of(F.col("code"), "other").alias("other"),
                         builds.is_valid_code(F.col("code")).alias("valid"))
    seen = found.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("code").alias("codes"),
                     F.count_if("valid").alias("valid"), F.count_if(F.col("id") == F.col("back")).alias("back"),
                     F.count_if(F.col("id") == F.col("other")).alias("other")).first()
    assert seen.ids == seen.codes and seen.n == seen.valid == seen.back and seen.other < 5
    # Neighbouring numbers show nothing of each other: each place of a code takes all letters.
    letters = coded.where("id < 5000").select("code").collect()
    assert all(len({r.code[k] for r in letters}) == 62 for k in range(6))


def test_number_of_what_is_no_code(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "abc", "abcde-", "abcdeä", "abcdefg", "abcdef\n")], "code string")
    assert [r[0] for r in rows.select(builds.number_of(F.col("code"), "key")).collect()] == [None] * 7


def test_ranges_follow_each_other(spark):
    now = F.lit(T1)
    first, end = builds.save_builds_in_range(lists(spark, *[{"cpu": "1", "gpu": None}] * 57), 10, now, "key")
    second, last = builds.save_builds_in_range(lists(spark, *[{"cpu": "2"}] * 3), end, now, "key")
    none, same = builds.save_builds_in_range(lists(spark, {"cpu": "2"}).limit(0), last, now, "key")
    assert (end, last, same, none.count()) == (67, 70, 70, 0)
    both = first.unionByName(second).select("slots", builds.number_of(F.col("code"), "key").alias("n")).collect()
    assert sorted(r.n for r in both) == list(range(10, 70)) and all(None not in r.slots.values() for r in both)
    with pytest.raises(ValueError, match="no codes"):
        builds.save_builds_in_range(lists(spark, {"cpu": "1"}), builds.CODES, now, "key")


def test_repeated_build_id_is_refused(spark):
    twice = lists(spark, {"cpu": "1"}).unionAll(lists(spark, {"cpu": "2"}))
    with pytest.raises(ValueError, match="not unique"):
        builds.save_builds(twice, shared(spark), F.lit(T1))


def test_part_in_most_lists(spark, parts, latest):
    many = spark.range(3000).select(
        F.col("id").cast("string").alias("code"),
        F.create_map(F.lit("cpu"), F.when(F.col("id") % 3 == 0, "2").otherwise("1")).alias("slots"),
        F.lit(T1).alias("created_at"))
    found = builds.resolve_builds(many, parts, latest)
    assert {r["part_id"]: r["count"] for r in found.groupBy("part_id").count().collect()} == {
        "1": 2000, "2": 1000}


def test_empty_list_is_refused(spark):
    with pytest.raises(Exception, match="no parts selected: 1"):
        builds.save_builds(lists(spark, {"cpu": "1"}, {"cpu": None}), shared(spark), F.lit(T1))


def test_resolve_repeated_codes_and_parts(spark, parts, latest):
    saved = shared(spark, ("abc123", {"gpu": "1", "cpu": "2"}, T1), ("abc123", {"cpu": "1", "ssd": "2", "toy": "5"}, T1),
                   (None, {"case": "1", "cooling": "1", "cpu": "1", "toy": "3"}, T1), ("none00", None, T1),
                   (None, {"ram": "3"}, T1), ("xyz789", {"toy": "3", "cpu": "3"}, T1))
    for rows, expected in (
            (saved, {("abc123", "gpu", "1"), ("abc123", "ssd", "2"), (None, "cooling", "1"), (None, "ram", "3"),
                     ("xyz789", "cpu", "3")}),
            (saved.where("code = 'xyz789'"), {("xyz789", "cpu", "3")}),
            (saved.where("code is null and slots['cpu'] = '1'"), {(None, "cooling", "1"), (None, "toy", "3")})):
        found = builds.resolve_builds(rows, parts, latest).where("part_id != '5'").collect()
        assert sorted(map(str, ((r.code, r.slot, r.part_id) for r in found))) == sorted(map(str, expected))


def test_resolve(spark, parts, latest):
    saved = shared(spark, ("abc123", {"cpu": "1", "gpu": "gone", "case": "3", "ssd": "4", "ram": "5"}, T1),
                   ("xyz789", {"cpu": "2", "cooling": "2"}, T1), ("empty0", {"cpu": None}, T1))
    rows = builds.resolve_builds(saved, parts, latest).collect()
    assert {(r["code"], r["slot"], r["part_id"], r["price_pkr"]) for r in rows} == {
        ("abc123", "cpu", "1", 1000), ("abc123", "case", "3", 500), ("abc123", "ssd", "4", None),
        ("xyz789", "cooling", "2", 1000)}
    assert builds.resolve_builds(saved.where("code = 'nobody'"), parts, latest).count() == 0


@pytest.mark.parametrize("code, valid", [("abc123", True), ("ABCdef", True), ("äöü١٢٣", True), ("abc12", False),
                                         ("abc1234", False), ("abc-12", False), ("abc123\n", False), ("", False)])
def test_code_format(spark, code, valid):
    assert spark.createDataFrame([(code,)], "c string").select(
        builds.is_valid_code(F.col("c"))).first()[0] is valid
