"""Files, stored tables, and the incremental load."""

import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rigbook import schemas, session
from rigbook.plans import refresh
from rigbook.session import scratch_path
from rigbook.sources import files
from rigbook.sources.tables import CatalogueTables
from rigbook.streaming.incremental import read_feed_stream, start_loading

T1, T2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)


def feed(spark, *rows):
    full = [("Größe " + name, price, f"https://s/{name}", "gpu", "techarc.pk", at, None, (0, 0, 1, i))
            for i, (name, price, at) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.FEED)


def test_json_export_keeps_text_and_nulls(spark):
    path = scratch_path(spark, "json")
    files.write_json(feed(spark, ("a", None, T1)).coalesce(1), path)
    line = next(Path(path.removeprefix("file:")).glob("*.json")).read_text(encoding="utf-8")
    assert "Größe a" in line and json.loads(line)["price_pkr"] is None
    assert files.read_feed(spark, path).collect() == feed(spark, ("a", None, T1)).collect()


def test_compressed_export_is_small_and_cut_into_files(spark, monkeypatch):
    monkeypatch.setattr(files, "GZIP_ROWS", 300)
    rows = feed(spark, *[(f"part {k}", None if k % 7 == 0 else k, T1) for k in range(1000)]).coalesce(1)
    plain, path = scratch_path(spark, "export"), scratch_path(spark, "export") + ".gz"
    files.write_json(rows, plain)
    files.write_json(rows, path)
    folder = Path(path.removeprefix("file:"))
    assert len(list(folder.glob("*.json.gz"))) == 4 and not list(folder.glob("*.json"))
    assert sum(f.stat().st_size for f in folder.glob("*.gz")) < 0.2 * sum(
        f.stat().st_size for f in Path(plain.removeprefix("file:")).glob("*.json"))
    assert sorted(map(str, files.read_feed(spark, path).collect())) == sorted(map(str, rows.collect()))


def test_json_text_and_structs(spark):
    texts = ['{"brand": "AMD"}', "{}", "", None, "{oops", '{"colour": "red"}', '{"brand": null}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = files.from_json_text(F.col("t"), schemas.SPECS)
    got = rows.select("i", files.as_json(parsed)).orderBy("i").collect()
    assert [r[1] for r in got] == ['{"brand":"AMD"}'] + [None] * 6


def test_missing_columns(spark):
    old = spark.createDataFrame([("1", "n")], "part_id string, name string")
    new = files.add_missing_columns(old, schemas.PARTS)
    assert set(new.columns) == set(schemas.PARTS.names) and new.first()["name"] == "n"
    assert files.add_missing_columns(new, schemas.PARTS) is new


def test_pages_are_read_by_shop(spark):
    path = scratch_path(spark, "pages")
    rows = spark.createDataFrame([(s, "u", 1, "u", "h", T1) for s in ("a", "b")], schemas.PAGES)
    files.write_pages(rows, path)
    own = files.read_pages(spark, path).where("source = 'a'")
    assert own.count() == 1 and "PartitionFilters: [isnotnull(source" in (
        own._jdf.queryExecution().executedPlan().toString())


def test_snapshots(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    assert tables.parts().count() == 0 and tables.price_log().count() == 0
    refresh.load_feed(tables, feed(spark, ("a", 5000, T1)))
    before = tables.parts()
    refresh.load_feed(tables, feed(spark, ("b", 6000, T1), ("c", 6000, T2)))
    assert before.count() == 1 and tables.parts().count() == 3  # readers keep the snapshot they opened
    assert tables.parts().schema.names == schemas.PARTS.names
    # A state without its marker does not count.
    Path(f"{tables.root}/parts/_states/v00000009".removeprefix("file:")).mkdir()
    assert tables.parts().count() == 3
    refresh.enrich_stored_parts(tables)
    assert tables.parts().count() == 3 and tables.latest_prices().count() == 3 and len(tables._states("parts")) == 3


def shop_feed(spark, source, *names):
    rows = [(name, 5000, f"https://s/{name}", "gpu", source, T1, None, (0, 0, 1, i)) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, schemas.FEED)


def bytes_below(folder):
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*.parquet"))


def test_a_load_rewrites_its_own_buckets_only(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"), buckets_per_shop=4)
    names = [f"card {k} " + "x" * 200 for k in range(600)]
    for shop in ("techarc.pk", "redtech.pk", "pakbyte.pk"):
        refresh.load_feed(tables, shop_feed(spark, shop, *names))
    whole = bytes_below(f"{tables.root}/parts/data")
    before, places = tables.parts(), tables._places("parts")
    refresh.load_feed(tables, shop_feed(spark, "redtech.pk", "card 7 new", "a new card"))
    changed = {b for b, v in tables._places("parts").items() if places.get(b) != v}
    assert 1 <= len(changed) <= 2 and len(places) == 12
    written = bytes_below(f"{tables.root}/parts/data/version=4")
    assert 0 < written < whole * len(changed) / len(places) * 1.5
    assert tables.parts().count() == 1802 and before.count() == 1800
    # The plan of a merge lists the touched buckets alone.
    touched = sorted(changed)
    files = tables._bucketed("parts", touched).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == set(map(str, touched))
    # Old directories go when asked for, and nothing that the last state needs.
    assert tables.keep_last("parts") == len(changed) and tables.parts().count() == 1802
    assert len(tables._states("parts")) == 1 and tables.keep_last("parts") == 0 and tables.keep_last("prebuilts") == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        before.agg(F.max("name")).collect()


def test_scratch_tables_are_removed(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    refresh.load_feed(tables, feed(spark, ("a", 5000, T1)))
    assert set(folder.iterdir()) - before == {Path(tables.root.removeprefix("file:"))}
    with pytest.raises(RuntimeError, match="stop"), session.scratch_run(spark):
        with session.scratch_run(spark):
            inner = session.cut_lineage(spark.range(3))
        assert inner.count() == 3
        raise RuntimeError("stop")
    assert set(folder.iterdir()) - before == {Path(tables.root.removeprefix("file:"))}


def test_latest_price_is_kept_with_the_part(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    refresh.load_feed(tables, feed(spark, ("a", 5000, T2), ("b", 6000, T1)))
    refresh.load_feed(tables, feed(spark, ("a", 4500, T1), ("b", 6500, T1), ("c", 7000, None)))
    # An older row, another price for a known time, and a row without a time change no latest price.
    assert {(r["name"], r["price_pkr"], r["priced_at"]) for r in tables.listing().collect()} == {
        ("Größe a", 5000, T2), ("Größe b", 6000, T1), ("Größe c", None, None)}
    assert {r["price_pkr"] for r in tables.latest_prices().collect()} == {5000, 6000}


def test_failed_write_leaves_the_old_state(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    refresh.load_feed(tables, feed(spark, ("a", 5000, T1)))
    broken = tables.listing().withColumn("name", F.raise_error(F.lit("disk on fire")).cast("string"))
    with pytest.raises(Exception, match="disk on fire"):
        tables.replace_parts(broken)
    assert tables.parts().count() == 1


def test_log_is_pruned_by_month(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    refresh.load_feed(tables, feed(spark, ("a", 5000, T1), ("a", 6000, T2)))
    months = {p.name for p in Path(f"{tables.root}/price_log".removeprefix("file:")).glob("scraped_month=*")}
    assert months == {"scraped_month=2024-01-01", "scraped_month=2024-02-01"}
    log = tables.price_log().where(F.col("scraped_month").isin(datetime.date(2024, 1, 1)))
    assert log.count() == 1 and len(log.inputFiles()) == 2  # listed; pruned when read
    assert "PartitionFilters: [isnotnull(scraped_month" in log._jdf.queryExecution().executedPlan().toString()


def test_incremental_load(spark):
    arriving, tables = scratch_path(spark, "arriving"), CatalogueTables(spark, scratch_path(spark, "tables"))
    progress = scratch_path(spark, "progress")

    def arrive(*rows):
        feed(spark, *rows).coalesce(1).write.mode("append").json(arriving)

    def run():
        query = start_loading(read_feed_stream(spark, arriving, files_per_batch=1), tables, progress)
        query.awaitTermination()
        return tables.price_log().count()

    arrive(("a", 5000, T1), ("b", 100, T1))
    assert run() == 1
    arrive(("a", 7000, T1), ("a", 7000, T2))  # the first is known already
    arrive(("c", 8000, T1))
    assert run() == 3 and run() == 3
    assert {(r["source_id"]) for r in tables.parts().collect()} == {"a", "c"}
    assert {(r["price_pkr"]) for r in tables.latest_prices().collect()} == {7000, 8000}


def test_stream_that_is_run_again_from_the_start(spark):
    """As after a crash between a load and the note of it."""
    arriving, tables = scratch_path(spark, "arriving"), CatalogueTables(spark, scratch_path(spark, "tables"))
    feed(spark, ("a", 5000, T1)).write.json(arriving)
    for _ in range(2):
        start_loading(read_feed_stream(spark, arriving), tables, scratch_path(spark, "progress")).awaitTermination()
    assert tables.price_log().count() == 1 and tables.parts().count() == 1


def test_shared_folder_is_the_clusters(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
