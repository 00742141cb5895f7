"""Which feed rows are loaded, and why the others are not."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import contains_any

NO_PRICE, BELOW_FLOOR, BLOCKED_NAME = "no_price", "below_floor", "blocked_name"


def below_floor(price: Column, category: Column) -> Column:
    """True if a price is under its category's floor, NULL for categories without one."""
    floors = F.create_map(*[F.lit(x) for pair in fixed.PRICE_FLOORS.items() for x in pair])
    return price < F.try_element_at(floors, category)


def blocked_name(lower: Column, category: Column) -> Column:
    """True if a name, in lower case, contains a term blocked everywhere or in its category."""
    by_category = [(category == c) & contains_any(lower, terms) for c, terms in fixed.BLOCKED_TERMS_BY_CATEGORY.items()]
    return reduce(or_, by_category, contains_any(lower, fixed.BLOCKED_TERMS))


def with_lower_name(feed: DataFrame) -> DataFrame:
    """The feed with ``_lower``, the name in lower case, made once for each row.

    It is put out by a generator, as Spark moves filters below a projection, where the name would be made anew for each
    of the 42 terms. As a column, unlike a variable of a lambda, it leaves their tests to compiled code.
    """
    return feed.select("*", F.explode(F.array(F.lower("name"))).alias("_lower"))


def reject_reason() -> Column:
    """The first reason that applies to a row of :func:`with_lower_name`, NULL for a good row.

    A row without a category is no bad row but a broken feed: it fails the job that reads it, so that
    nothing of the batch is written.
    """
    name, category, price = F.col("name"), F.col("category"), F.col("price_pkr")
    broken = F.raise_error(F.concat(F.lit("feed row without a category: "),
                                    F.coalesce(name, F.lit("<unknown>"))))
    return (F.when(F.coalesce(category, F.lit("")) == "", broken.cast("string"))
            .when(price.isNull(), NO_PRICE)
            .when(below_floor(price, category), BELOW_FLOOR)
            .when(blocked_name(F.col("_lower"), category), BLOCKED_NAME))


def clean_feed(feed: DataFrame) -> DataFrame:
    """The rows to load. A row-wise filter of literals: no join, no shuffle."""
    return with_lower_name(feed).where(reject_reason().isNull()).drop("_lower")


def reject_counts(feed: DataFrame) -> DataFrame:
    """(reason, n) over the rejected rows; reasons that never applied are left out."""
    reason = F.col("reason")
    counts = with_lower_name(feed).select(reject_reason().alias("reason")).agg(
        *[F.count_if(reason == r).alias(r) for r in (NO_PRICE, BELOW_FLOOR, BLOCKED_NAME)])
    rows = F.inline(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n"))
                              for r in (NO_PRICE, BELOW_FLOOR, BLOCKED_NAME)]))
    return counts.select(rows).where("n > 0")
