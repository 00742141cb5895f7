"""Merging a feed into the catalogue, as set operations.

Rows of one key are told apart by ``seq``, the feed order. Every merge first folds the batch to one row
per key, with partial aggregation before the shuffle, so a key that makes up much of a batch costs one
row per task. Only then does it meet the stored table.
"""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rigbook.functions.specs import with_specs
from rigbook.functions.text import part_key, slug
from rigbook.schemas import LATEST_PRICES, LISTING, PARTS, PREBUILTS, PRICE_LOG, SEQ
from rigbook.session import cut_lineage, small_scans

KEY = ["source", "source_id"]


def with_keys(feed: DataFrame, key: str = "part_id") -> DataFrame:
    """Add the natural key's ``source_id`` and the surrogate ``key`` to feed rows."""
    return (feed.withColumn("source_id", slug(F.col("url")))
            .withColumn(key, part_key(F.col("source"), F.col("source_id"))))


def _last(*columns: str) -> Column:
    return F.max_by(F.struct(*columns), "seq").alias("last")


def _last_known(column: str) -> Column:
    """The last value that is not NULL: rows ordered by NULL are left out by max_by."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def _not_stored(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch's rows whose key is new. Goes by way of the stored keys that the batch hits, which are
    never more than the batch, so that the stored table needs no shuffle if the batch is small."""
    hit = existing.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(hit, key, "left_anti")


def _merge(existing: DataFrame, batch: DataFrame, key: str, replaced: list, now: Column, newer: tuple = ()) -> DataFrame:
    """Stored rows updated from the batch, plus the batch's new rows.

    url and created_at stay as first stored; a missing thumbnail never replaces one. Columns of ``newer`` are
    replaced together if the last of them, a time, is later. The stored table is the big side: it is only streamed
    past the batch when that is small enough for Spark to broadcast. The folded batch should be a written table,
    as each of the joins would fold it anew.
    """
    columns = existing.columns
    fresh = batch.select(key, *[F.col(c).alias(f"new_{c}") for c in [*replaced, "thumbnail_url", *newer]],
                         F.lit(True).alias("hit"))
    is_newer = F.lit(False)
    if newer:
        time = newer[-1]
        is_newer = F.col(f"new_{time}").isNotNull() & F.coalesce(F.col(f"new_{time}") > F.col(time), F.lit(True))

    def merged(column):
        if column in replaced:
            return F.when(F.col("hit"), F.col(f"new_{column}")).otherwise(F.col(column))
        if column in newer:
            return F.when(is_newer, F.col(f"new_{column}")).otherwise(F.col(column))
        if column == "thumbnail_url":
            return F.coalesce("new_thumbnail_url", "thumbnail_url")
        if column == "updated_at":
            return F.when(F.col("hit"), now).otherwise(F.col(column))
        return F.col(column)

    updated = (existing.join(fresh, key, "left")
               .select(*[merged(c).alias(c) for c in columns]))
    added = (_not_stored(existing, batch, key)
             .withColumns({"created_at": now, "updated_at": now})
             .select(columns))
    return updated.unionByName(added)


def latest_prices(price_log: DataFrame) -> DataFrame:
    """The newest log row of each part, also when its price is NULL.

    One hash aggregation with partial sums of fixed width: a part with very many log rows is reduced in
    every task before anything is shuffled.
    """
    return price_log.groupBy("part_id").agg(
        F.max_by("price_pkr", "scraped_at").alias("price_pkr"),
        F.max("scraped_at").alias("scraped_at"))


def fold_parts(feed: DataFrame) -> DataFrame:
    """A cleaned feed as one row per part: last name and category, first url, last known thumbnail.

    Specifications are read from the surviving name only, once per part instead of once per row.
    """
    return _fold_parts(feed)


def _fold_parts(feed: DataFrame, **more: Column) -> DataFrame:
    folded = (with_keys(feed).groupBy(*KEY)
              .agg(_last("name", "category"), F.min_by("url", "seq").alias("url"),
                   _last_known("thumbnail_url"), *[value.alias(c) for c, value in more.items()]))
    keyed = folded.select(part_key(F.col("source"), F.col("source_id")).alias("part_id"), *KEY, "url",
                          "thumbnail_url", "last.name", "last.category", *more)
    return with_specs(keyed)


def upsert_parts(existing: DataFrame, feed: DataFrame, now: Column) -> DataFrame:
    """The parts table after loading a cleaned feed."""
    batch = cut_lineage(fold_parts(feed))
    return _merge(existing, batch, "part_id", ["name", "category", "specs"], now).to(PARTS)


def fold_listing(feed: DataFrame) -> DataFrame:
    """A cleaned feed as one row per part with the feed's latest price of it."""
    # The first row of the newest time, as the log has it. It is found in the fold of the part itself, which saves the
    # shuffles of a fold of its own and of the join. Turned bits order numbers from large to small and never overflow.
    seq = F.col("seq")
    first = F.struct(*[x for f in SEQ.names for x in (seq[f].isNull(), F.bitwise_not(seq[f]))])
    newest = F.when(F.col("scraped_at").isNotNull(), F.struct("scraped_at", seq.isNotNull(), first))
    return _fold_parts(feed, price_pkr=F.max_by(F.when(seq.isNotNull(), F.col("price_pkr")), newest),
                       priced_at=F.max("scraped_at"))


def merge_listing(existing: DataFrame, folded: DataFrame, now: Column) -> DataFrame:
    """Stored parts with their latest prices, after a folded batch. A price counts if it was scraped later than the
    stored one: what the log holds already, or ignores, never is."""
    merged = _merge(existing, folded, "part_id", ["name", "category", "specs"], now, ("price_pkr", "priced_at"))
    return merged.to(LISTING)


def fold_prices(feed: DataFrame) -> DataFrame:
    """A cleaned feed as log rows; of several with one part and time the first counts. A row without a time is
    no log row, though its part is loaded like any other. The key goes through the shuffle as its 16 bytes, not as the
    32 letters that stand for them, since it is most of a row and cannot be compressed."""
    keyed = with_keys(feed).where("scraped_at is not null").withColumn("key", F.unhex("part_id"))
    return (keyed.groupBy("key", "scraped_at").agg(F.min_by("price_pkr", "seq").alias("price_pkr"))
            .withColumns({"part_id": F.lower(F.hex("key")), "scraped_month": F.trunc("scraped_at", "month")})
            .to(PRICE_LOG))


#: Rows of a folded batch up to which it is small enough to be broadcast.
SMALL_BATCH = 100_000


def new_prices(price_log: DataFrame, feed: DataFrame) -> DataFrame:
    """The log rows a cleaned feed adds: those whose part and time the log does not hold yet.

    The log is the big side, and an anti join would shuffle it. So the folded batch is written and counted, the log is
    streamed past a small one (a broadcast), and only its few hits meet the batch again. A batch that is too large for
    that would be shuffled twice, and the log all the same: there one anti join shuffles each once.
    """
    keys = ["scraped_month", "part_id", "scraped_at"]
    counted = Observation()
    batch = cut_lineage(fold_prices(feed).observe(counted, F.count(F.lit(1)).alias("rows")))
    known = price_log.select(keys)
    if counted.get["rows"] <= SMALL_BATCH:
        known = known.join(batch.select(keys), keys, "left_semi")
    return batch.join(known, keys, "left_anti").to(PRICE_LOG)


def merge_latest(latest: DataFrame, added: DataFrame) -> DataFrame:
    """The latest-price table after some log rows were added; saves queries from reading the log.

    As in the other merges, only the folded new rows are shuffled if they are few.
    """
    folded = cut_lineage(latest_prices(added))
    newer = folded.select("part_id", F.struct("price_pkr", "scraped_at").alias("new"))
    is_newer = F.col("new.scraped_at") > F.col("scraped_at")
    updated = latest.join(newer, "part_id", "left").select(
        "part_id", *[F.when(is_newer, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
                     for c in ("price_pkr", "scraped_at")])
    return updated.unionByName(_not_stored(latest, folded, "part_id")).to(LATEST_PRICES)


def fold_prebuilts(feed: DataFrame) -> DataFrame:
    """A prebuilt feed as one row per system. Nothing is rejected, and a missing price counts."""
    small_scans(feed.sparkSession)
    folded = (with_keys(feed, "prebuilt_id").groupBy(*KEY)
              .agg(_last("name", "price_pkr", "components", "scraped_at"),
                   F.min_by("url", "seq").alias("url"), _last_known("thumbnail_url")))
    return folded.select(part_key(F.col("source"), F.col("source_id")).alias("prebuilt_id"), *KEY, "url",
                         "thumbnail_url", "last.*")


def merge_prebuilts(existing: DataFrame, folded: DataFrame, now: Column) -> DataFrame:
    """Stored systems after a folded batch."""
    replaced = ["name", "price_pkr", "components", "scraped_at"]
    return _merge(existing, folded, "prebuilt_id", replaced, now).to(PREBUILTS)


def upsert_prebuilts(existing: DataFrame, feed: DataFrame, now: Column) -> DataFrame:
    """The prebuilts table after loading a feed."""
    return merge_prebuilts(existing, cut_lineage(fold_prebuilts(feed)), now)


def backfill_specs(parts: DataFrame) -> DataFrame:
    """All parts with their specifications read anew from their names. Changes nothing when repeated."""
    return with_specs(parts).to(LISTING if "priced_at" in parts.columns else PARTS)
