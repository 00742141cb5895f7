"""Questions to the table of complete systems."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import contains_any, name_matches
from rigbook.plans.catalogue import check_page, price_filters, sorted_page


def matching_prebuilts(prebuilts: DataFrame, *, source=None, min_price=None, max_price=None, q=None,
                       cpu_brand=None, gpu_brand=None) -> DataFrame:
    """Systems that pass all filters. Brands are told by words in the component text; a brand nobody
    knows is no filter, and a system without that component never matches a known one."""
    filters = price_filters(min_price, max_price)
    if source:
        filters.append(F.col("source") == source)
    if q:
        filters.append(name_matches(F.col("name"), q))
    for field, brand, words in (("cpu", cpu_brand, fixed.CPU_BRAND_WORDS),
                                ("gpu", gpu_brand, fixed.GPU_BRAND_WORDS)):
        if brand and brand.lower() in words:
            filters.append(contains_any(F.lower(f"components.{field}"), words[brand.lower()]))
    return prebuilts.where(reduce(and_, filters)).select(
        "prebuilt_id", "source", "source_id", "name", "url", "thumbnail_url", "price_pkr", "components",
        "scraped_at")


def list_prebuilts(prebuilts: DataFrame, *, sort="price_asc", limit=50, offset=0,
                   **filters) -> DataFrame:
    """One page of the systems listing; see :func:`matching_prebuilts` for the filters."""
    check_page(sort, limit, offset, 200, filters.get("min_price"), filters.get("max_price"))
    return sorted_page(matching_prebuilts(prebuilts, **filters), sort, limit, offset)


def count_prebuilts(prebuilts: DataFrame, **filters) -> DataFrame:
    return matching_prebuilts(prebuilts, **filters).agg(F.count(F.lit(1)).alias("total"))


def get_prebuilt(prebuilts: DataFrame, prebuilt_id: str) -> DataFrame:
    """One system by its id; no row if there is none."""
    return prebuilts.where(F.col("prebuilt_id") == prebuilt_id)
