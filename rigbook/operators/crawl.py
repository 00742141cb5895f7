"""Work on whole crawls: seed categories, first sightings, reported totals, completeness."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import find, to_int

# How each shop's first listing page states the number of its products.
OF_RESULTS = r"(?iU)of\s+([\d,]+)\s+results"
TOTALS = {
    "czone.com.pk": (r"(?iU)(\d+)\s+Products?",),
    "zahcomputers.pk": (OF_RESULTS,),
    "techarc.pk": (OF_RESULTS,),
    "redtech.pk": (OF_RESULTS,),
    "techmatched.pk": (OF_RESULTS,),
    "pakbyte.pk": (r"(?U)collection__products-count-total[^>]*>\s*([\d,]+)\s+products",
                   r"(?U)of\s+([\d,]+)\s+products"),
}
JSON_TOTAL = {"junaidtech.pk": "$.data.totalRecords"}


def seed_dimension(spark: SparkSession) -> DataFrame:
    """All seed pages with their category; 87 fixed rows."""
    rows = [f"('{source}', '{pattern.format(path)}', '{category}', {source_no}, {category_no})"
            for source_no, source in enumerate(fixed.PART_SOURCES)
            for pattern, seeds in [fixed.SEED_PAGES[source]]
            for category_no, (path, category) in enumerate(seeds)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} "
                     "AS seeds(source, seed_url, category, source_no, category_no)")


def _address(url: str | Column) -> Column:
    """An address without what spellings of one page differ in: scheme, www, letter case, last slashes."""
    return F.rtrim(F.regexp_replace(F.lower(url), r"^https?://(www\.)?", ""), F.lit("/"))


def _with_seed(pages: DataFrame, how: str) -> DataFrame:
    seeds = F.broadcast(seed_dimension(pages.sparkSession).withColumn("_seed", _address("seed_url")).drop("seed_url"))
    return pages.withColumn("_seed", _address("seed_url")).join(seeds, ["source", "_seed"], how).drop("_seed")


def stamp_category(pages: DataFrame) -> DataFrame:
    """Give each page the category and the crawl position of its seed. Pages of no known seed have none and
    go; ``unmatched_pages`` counts them."""
    return _with_seed(pages, "inner")


def unmatched_pages(pages: DataFrame) -> DataFrame:
    """Pages of each source, and how many of them belong to no known seed and so give no rows."""
    return (_with_seed(pages, "left").groupBy("source")
            .agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("category").isNull()).alias("unmatched")))


def first_seen(rows: DataFrame, keys, page: Column) -> DataFrame:
    """Keep what a crawl keeps: rows of the first page on which their key shows up.

    Repeats on later pages go, repeats within that first page stay. As the rank is limited to 1, Spark
    ranks before the shuffle too, so a key found on very many pages (the empty address, say) arrives
    as one page's rows per task instead of all of them.
    """
    order = Window.partitionBy(*keys).orderBy(page)
    return rows.withColumn("_rank", F.rank().over(order)).where("_rank = 1").drop("_rank")


def reported_totals(pages: DataFrame) -> DataFrame:
    """(source, category, reported) as stated on page 1; NULL where a shop states nothing."""
    html, source = F.col("html"), F.col("source")
    cases = [(source == s, to_int(find(html, *patterns))) for s, patterns in TOTALS.items()]
    cases += [(source == s, F.coalesce(to_int(F.get_json_object(html, path)), F.lit(0)))
              for s, path in JSON_TOTAL.items()]
    total = reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))
    first_pages = pages.where("page = 1").select("source", "category", total.alias("reported"))
    return first_pages.groupBy("source", "category").agg(F.max("reported").alias("reported"))


def crawl_completeness(feed: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows collected against the total the shop reported, by source and category."""
    collected = feed.groupBy("source", "category").agg(F.count(F.lit(1)).alias("collected"))
    got = F.coalesce("collected", F.lit(0))
    return (totals.join(collected, ["source", "category"], "full_outer")
            .select("source", "category", got.alias("collected"), "reported",
                    (got >= F.col("reported")).alias("complete")))
