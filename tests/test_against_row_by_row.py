"""Whole loads against the same rows applied one at a time, as the row-by-row rules put it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rigbook import fixed, schemas
from rigbook.plans import catalogue, refresh
from rigbook.session import scratch_path
from rigbook.sources.tables import CatalogueTables

START = datetime.datetime(2024, 1, 30)
NAMES = ["ASUS RTX 4060 8GB", "GPU holder", "Card with thermal paste", "WD Blue 1TB NVMe", "Plain", "AIO 240mm"]


def random_batch(rng, size):
    """A third of all rows belong to one part."""
    rows = []
    for i in range(size):
        n = 0 if rng.random() < 0.33 else rng.randrange(12)
        rows.append({
            "name": f"{rng.choice(NAMES)} {rng.randrange(3)}", "price_pkr": rng.choice([None, 100, 5000, 9000 + i]),
            "url": f"https://{rng.choice('ab')}.pk/p/{n}{rng.choice(['', '/'])}",
            "category": rng.choice(["gpu", "ssd", "cooling", "hdd"]),
            "source": fixed.PART_SOURCES[n % 3],
            "scraped_at": START + datetime.timedelta(days=rng.randrange(5)),
            "thumbnail_url": rng.choice([None, f"t{i}"]), "seq": (0, 0, 1, i)})
    return rows


def load_one_by_one(parts, log, batch, now):
    """One row after the other into two dictionaries; returns the number of new prices."""
    added = 0
    for r in batch:
        terms = fixed.BLOCKED_TERMS + fixed.BLOCKED_TERMS_BY_CATEGORY.get(r["category"], ())
        floor = fixed.PRICE_FLOORS.get(r["category"], 0)
        if r["price_pkr"] is None or r["price_pkr"] < floor or any(t in r["name"].lower() for t in terms):
            continue
        key = r["source"], r["url"].split("/", 3)[3].rstrip("/").replace("/", "-")
        part = parts.setdefault(key, {"url": r["url"], "thumb": None, "created": now, "updated": now})
        part.update(name=r["name"], category=r["category"], updated=now)
        part["thumb"] = r["thumbnail_url"] or part["thumb"]
        if (key, r["scraped_at"]) not in log:
            log[key, r["scraped_at"]] = r["price_pkr"]
            added += 1
    return added


@pytest.mark.parametrize("seed", [1, 2])
def test_three_batches(spark, seed):
    rng, parts, log = random.Random(seed), {}, {}
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    for run in range(3):
        batch, now = random_batch(rng, 120), datetime.datetime(2024, 5, 1 + run)
        rows = [tuple(r[c] for c in schemas.FEED.names) for r in batch]
        rng.shuffle(rows)  # only seq tells the order
        written = refresh.load_feed(tables, spark.createDataFrame(rows, schemas.FEED), F.lit(now))
        assert written == load_one_by_one(parts, log, batch, now)

    stored = tables.parts().collect()
    assert {(r["source"], r["source_id"]): (r["name"], r["category"], r["url"], r["thumbnail_url"],
                                            r["created_at"], r["updated_at"]) for r in stored} == {
        k: (p["name"], p["category"], p["url"], p["thumb"], p["created"], p["updated"]) for k, p in parts.items()}
    key_of = {r["part_id"]: (r["source"], r["source_id"]) for r in stored}
    assert {(key_of[r["part_id"]], r["scraped_at"]): r["price_pkr"]
            for r in tables.price_log().collect()} == log
    newest = {k: max((at, price) for (key, at), price in log.items() if key == k) for k in parts}
    kept = {key_of[r["part_id"]]: (r["scraped_at"], r["price_pkr"]) for r in tables.latest_prices().collect()}
    assert kept == newest
    computed = catalogue.latest_prices(tables.price_log())
    assert sorted(computed.collect()) == sorted(tables.latest_prices().collect())


def test_run_that_dies_before_the_log_is_written(spark, monkeypatch):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    batch = spark.createDataFrame([tuple(r[c] for c in schemas.FEED.names)
                                   for r in random_batch(random.Random(3), 60)], schemas.FEED)
    with monkeypatch.context() as broken:
        broken.setattr(tables, "append_prices", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh.load_feed(tables, batch)
    assert tables.price_log().count() == 0
    written = refresh.load_feed(tables, batch)
    assert written == tables.price_log().count() > 0
    computed = catalogue.latest_prices(tables.price_log())
    assert sorted(computed.collect()) == sorted(tables.latest_prices().collect())


def test_long_pages(spark):
    """A page of several megabytes is one text like any other, blanks and all."""
    from tests.test_pages import listed
    money = '<bdi><span class="woocommerce-Price-currencySymbol">Rs</span>{}7,500</bdi>'
    card = ('<div class="wd-product-wrapper"><a class="wd-product-img-link" aria-label="A"></a>'
            + money.format(" " * 1_000_000 + "&nbsp;" * 500) + "x" * 2_000_000 + "</div>")
    assert [r[1] for r in listed(spark, "redtech.pk", card * 2)] == [7500, 7500]
