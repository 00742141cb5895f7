"""Pages from the middle of a long listing, without sorting what stands before them.

A page by offset asks for order statistics. Instead of sorting all rows, rows are counted in bands of their sort
key, the band in which the offset falls is found from at most BANDS counts, and so on inside that band, until few
enough rows are left to sort. Each round is one aggregation whose filter reaches the scan. Bands of prices are
ranges of equal width; rows of one price are told apart by shop, and then by the next letters of their key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands of one round, and the rows that are sorted in the end.
BANDS, FEW = 1024, 10_000


def _counts(rows: DataFrame, band: Column) -> list[tuple]:
    """(band, rows in it) in order."""
    return sorted((r.band, r.n) for r in rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect())


def _band_of(counts: list[tuple], offset: int) -> tuple | None:
    """The band that holds the offset, the rows before it, and the rows in it; None past the end."""
    before = 0
    for band, n in counts:
        if offset < before + n:
            return band, before, n
        before += n
    return None


def narrowed(rows: DataFrame, offset: int, few: int = FEW) -> tuple[DataFrame, int]:
    """Rows in ascending order of (key, source, source_id) from the band of the offset on, and how many rows of
    that band stand before the offset. ``rows`` has a bigint column ``key``; the pair (source, source_id) is
    unique. Past the end, no rows."""
    seen = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if offset >= seen.n:
        return rows.limit(0), 0
    low, high, n, skipped = seen.low, seen.high, seen.n, 0
    while n > few and low < high:
        width = -(-(high - low + 1) // BANDS)
        inside = rows.where(F.col("key").between(low, high))
        band, before, n = _band_of(_counts(inside, F.floor((F.col("key") - low) / width)), offset - skipped)
        low, high, skipped = low + band * width, min(high, low + (band + 1) * width - 1), skipped + before
    rest = rows.where(F.col("key") >= low)
    if n <= few:
        return rest, offset - skipped
    # More rows than that have one price.
    same = rows.where(F.col("key") == low)
    source, before, n = _band_of(_counts(same, F.col("source")), offset - skipped)
    skipped += before
    later = (F.col("key") > low) | (F.col("source") > source)
    begins, same = "", same.where(F.col("source") == source)
    while n > few:
        # The letters that all have in common tell nothing apart; the next one does.
        ends = same.agg(F.min("source_id").alias("a"), F.max("source_id").alias("z")).first()
        alike = len(begins)
        while ends.a[:alike + 1] == ends.z[:alike + 1] and alike < len(ends.a):
            alike += 1
        found = _counts(same, F.substring("source_id", 1, alike + 1))
        # Spark compares UTF-8 bytes, Python code points, which is the same order.
        begins, before, n = _band_of(found, offset - skipped)
        skipped += before
        same = same.where(F.col("source_id").startswith(begins))
    inside = (F.col("source") == source) & (F.col("source_id") >= begins)
    return rest.where(later | inside), offset - skipped


def deep_page(rows: DataFrame, sort: str, limit: int, offset: int, few: int = FEW) -> DataFrame:
    """One page by price, equal prices by (source, source_id): the page that sorting all rows would give.

    The filters' rows are scanned once for each round of counting, a handful, and only the rows from the page's
    band on reach the final sort, of which each task keeps at most ``few`` and a page's.
    """
    price = F.col("price_pkr")
    keyed = rows.withColumn("key", price if sort == "price_asc" else -price)
    rest, skip = narrowed(keyed, offset, few)
    return rest.orderBy("key", "source", "source_id").offset(skip).limit(limit).drop("key")
