"""Questions to the parts catalogue.

Listings take parts and ``latest``, one row per part, as :func:`latest_prices` of the log gives it; or, in place of
both, the stored listing, which holds each part with its latest price: one scan, no join.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import name_matches, part_key
from rigbook.operators.loading import latest_prices  # noqa: F401  (part of this module's interface)
from rigbook.plans.paging import FEW, deep_page

SORTS = ("price_asc", "price_desc")


def check_page(sort: str, limit: int, offset: int, most: int, *prices) -> None:
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if offset < 0 or any(p is not None and p < 0 for p in prices):
        raise ValueError("offset and prices must not be negative")


def price_filters(min_price, max_price) -> list[Column]:
    """Rows with a price, within bounds that belong to the range."""
    filters = [F.col("price_pkr").isNotNull()]
    if min_price is not None:
        filters.append(F.col("price_pkr") >= min_price)
    if max_price is not None:
        filters.append(F.col("price_pkr") <= max_price)
    return filters


def sorted_page(rows: DataFrame, sort: str, limit: int, offset: int) -> DataFrame:
    """One page by price. Equal prices are ordered by key, so that pages neither overlap nor gap."""
    price = F.col("price_pkr").asc() if sort == "price_asc" else F.col("price_pkr").desc()
    return rows.orderBy(price, "source", "source_id").offset(offset).limit(limit)


LISTED = ["part_id", "source", "source_id", "name", "category", "url", "thumbnail_url", "specs"]


def part_filters(category=None, source=None, specs=None, q=None) -> Column:
    """Conditions on parts. An unknown category is an error, an unknown shop no filter, and unknown specification
    names are ignored."""
    if category and category not in fixed.CATEGORIES:
        raise ValueError(f"unknown category {category!r}; known: {sorted(fixed.CATEGORIES)}")
    filters = [F.lit(True)]
    if category:
        filters.append(F.col("category") == category)
    if source in fixed.PART_SOURCES:
        filters.append(F.col("source") == source)
    if q:
        filters.append(name_matches(F.col("name"), q))
    for field, value in (specs or {}).items():
        if field in fixed.SPEC_FIELDS and value is not None:
            filters.append(F.col(f"specs.{field}") == value)
    return reduce(and_, filters)


def matching_parts(parts: DataFrame, latest: DataFrame | None = None, *, min_price=None, max_price=None,
                   **filters) -> DataFrame:
    """Parts that pass all filters, with their latest price; see :func:`part_filters`.

    A part whose latest price is NULL is left out, even if it had one before. Without ``latest``, ``parts`` is the
    stored listing.
    """
    chosen = parts.where(part_filters(**filters))
    priced = reduce(and_, price_filters(min_price, max_price))
    if latest is None:
        return chosen.where(priced).select(*LISTED, "price_pkr")
    # Price filters look at the latest row only, so they have to follow the choice of it.
    return chosen.select(*LISTED).join(latest.where(priced).select("part_id", "price_pkr"), "part_id")


def list_parts(parts: DataFrame, latest: DataFrame | None = None, *, sort="price_asc", limit=50, offset=0,
               **filters) -> DataFrame:
    """One page of the parts listing; see :func:`matching_parts` for the filters.

    A page far behind is found by counting (:func:`deep_page`), so that rows before it are not sorted.
    """
    check_page(sort, limit, offset, 100, filters.get("min_price"), filters.get("max_price"))
    rows = matching_parts(parts, latest, **filters)
    return deep_page(rows, sort, limit, offset) if offset > FEW else sorted_page(rows, sort, limit, offset)


def count_parts(parts: DataFrame, latest: DataFrame | None = None, **filters) -> DataFrame:
    """The number of rows all pages of a listing have together."""
    return matching_parts(parts, latest, **filters).agg(F.count(F.lit(1)).alias("total"))


def facet_values(parts: DataFrame, category: str | None = None) -> DataFrame:
    """(category, field, value): the values found in each field a category can be filtered by.

    One pass for all fields and categories. Parts are first reduced to their distinct specifications, of
    which there are few; only those are taken apart by field. A category without fields of its own offers
    brands.
    """
    if category is not None:
        parts = parts.where(F.col("category") == category)

    def offered(field):
        value = F.col(f"specs.{field}")
        if field == "brand":
            return value
        having = [c for c, fields in fixed.FACET_FIELDS.items() if field in fields]
        return F.when(F.col("category").isin(*having), value)

    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), offered(f).alias("value"))
                               for f in fixed.SPEC_FIELDS]))
    return (parts.select("category", "specs").distinct()
            .select("category", pairs).where("value <> ''").distinct()
            .orderBy("category", "field", "value"))


def price_history(parts: DataFrame, price_log: DataFrame, source: str, source_id: str) -> DataFrame:
    """All prices of one part, oldest first. The key is a literal, so it reaches both scans."""
    key = part_key(F.lit(source), F.lit(source_id))
    known = parts.where(F.col("part_id") == key).select("part_id")
    return (price_log.where(F.col("part_id") == key).join(known, "part_id", "left_semi")
            .select("price_pkr", "scraped_at").orderBy("scraped_at"))


def _counts(rows: DataFrame, sets: list, total: str) -> DataFrame:
    """(metric, value, n) for the whole table and by each of ``sets``, from one pass over the table. A table with a
    column n counts each row so many times."""
    weight = F.col("n") if "n" in rows.columns else F.lit(1)
    folded = rows.groupBy(*sets).agg(F.sum(weight).alias("n"))
    grouped = [folded.groupBy(F.lit(f"by_{s}").alias("metric"), F.col(s).alias("value"))
               .agg(F.sum("n").alias("n")) for s in sets]
    everything = folded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(total).alias("metric"), F.lit(None).cast("string").alias("value"), "n")
    return reduce(DataFrame.unionByName, grouped, everything)


def catalogue_stats(parts: DataFrame, price_log: DataFrame) -> DataFrame:
    """(metric, value, n): parts in all, by shop and by category, and price rows in all.

    In place of parts, the stored counts of them may be given (a table with a column n), which are far fewer.
    """
    prices = price_log.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total_price_rows").alias("metric"), F.lit(None).cast("string").alias("value"), "n")
    return (_counts(parts, ["source", "category"], "total_parts").unionByName(prices)
            .orderBy("metric", "value"))


def prebuilt_stats(prebuilts: DataFrame) -> DataFrame:
    """(metric, value, n): systems in all and by shop, from systems or from the stored counts of them."""
    return _counts(prebuilts, ["source"], "total").orderBy("metric", "value")
