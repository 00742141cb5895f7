"""Queries on pages: rendered shop pages, and the driver's own pages."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import (absolute_url, find_all, price_digits, strip, strip_tags,
                                    unescape)
from rigbook.operators import crawl
from rigbook.operators.details import extract_details, product_links, title_text
from rigbook.operators.listing import CZONE_BASE, extract_gpu_listing, extract_listing
from rigbook.plans.refresh import listing_feed, refresh_parts
from rigbook.session import scratch_path
from rigbook.sources.files import read_pages, write_pages
from rigbook.sources.tables import CatalogueTables
from samples.feed import table
from samples.markup import detail_pages, detail_sql, late_components_sql, listing_pages, listing_sql
from samples.registry import query

_ROW = "name, price_pkr, url, category, source, thumbnail_url, page"


def _row(feed: DataFrame) -> DataFrame:
    return feed.select("name", "price_pkr", "url", "category", "source", "thumbnail_url", "seq.page")


# -- listing pages ---------------------------------------------------------------------------------------

LISTING_QUERIES = {
    "listing_jsonld": "czone.com.pk",
    "listing_woodmart_a": "zahcomputers.pk",
    "listing_woodmart_b": "techarc.pk",
    "listing_woodmart_c": "redtech.pk",
    "listing_flatsome_a": "amdhouse.pk",
    "listing_flatsome_b": "rbtechngames.com",
    "listing_shopify": "pakbyte.pk",
    "listing_woostify": "techmatched.pk",
    "listing_json_api": "junaidtech.pk",
}


def _register_listing(name: str, source: str) -> None:
    def run(spark, sf_dir):
        pages = listing_pages(spark, sf_dir, source)
        if source == "junaidtech.pk":   # payloads with something behind them are no JSON and give no rows
            for behind in ("]x", "}x"):
                pages = pages.unionAll(pages.where("html like '{%}'").withColumn("html", F.concat("html", F.lit(behind))))
        return _row(extract_listing(pages, source))
    query(f"WITH {listing_sql(source)} SELECT {_ROW} FROM listed", name=name)(run)


for _name, _source in LISTING_QUERIES.items():
    _register_listing(_name, _source)


@query(f"WITH {listing_sql('czone.com.pk')} SELECT name, price_pkr, url, category, source, "
       "CAST(NULL AS VARCHAR) AS thumbnail_url, page FROM listed WHERE category = 'gpu'")
def listing_jsonld_gpu(spark, sf_dir):
    return _row(extract_gpu_listing(listing_pages(spark, sf_dir, "czone.com.pk")))


_ALL_FIRST_SEEN_SQL = " UNION ALL ".join(
    f"SELECT * FROM (WITH {listing_sql(s)} SELECT {_ROW} FROM listed "
    "QUALIFY page = min(page) OVER (PARTITION BY source, category, url))" for s in fixed.PART_SOURCES)


@query(_ALL_FIRST_SEEN_SQL)
def listing_first_seen(spark, sf_dir):
    """The united feed of all shops, without what later pages repeat."""
    feeds = [listing_feed(listing_pages(spark, sf_dir, s), s) for s in fixed.PART_SOURCES]
    return _row(reduce(DataFrame.unionByName, feeds))


_TOTAL_SQL = ("CASE WHEN source NOT IN ('amdhouse.pk', 'rbtechngames.com') "
              "THEN CASE source WHEN 'czone.com.pk' THEN 234::BIGINT ELSE 1234 END END")


@query(f"""SELECT source, category, count(*) AS collected, {_TOTAL_SQL} AS reported,
       count(*) >= {_TOTAL_SQL} AS complete
FROM ({_ALL_FIRST_SEEN_SQL}) GROUP BY source, category""")
def crawl_completeness(spark, sf_dir):
    """The shop with JSON-LD states its total without commas, so of '1,234' only '234' is read."""
    pages = [listing_pages(spark, sf_dir, s) for s in fixed.PART_SOURCES]
    feed = reduce(DataFrame.unionByName, [listing_feed(p, s)
                                          for p, s in zip(pages, fixed.PART_SOURCES)])
    totals = crawl.reported_totals(crawl.stamp_category(reduce(DataFrame.unionByName, pages)))
    return crawl.crawl_completeness(feed, totals)


@query(f"""SELECT source, name, category, url, thumbnail_url, price_pkr
FROM ({_ALL_FIRST_SEEN_SQL}) WHERE price_pkr IS NOT NULL""")
def refresh_from_pages(spark, sf_dir):
    """A whole run: all shops' pages stored, extracted shop by shop, and loaded into stored tables. All
    prices are above their floors and no name is blocked, so only rows without a price are missing."""
    path = scratch_path(spark, "pages")
    for source in fixed.PART_SOURCES:
        write_pages(listing_pages(spark, sf_dir, source), path)
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    refresh_parts(tables, read_pages(spark, path))
    return (tables.parts().join(tables.price_log().select("part_id", "price_pkr"), "part_id")
            .select("source", "name", "category", "url", "thumbnail_url", "price_pkr"))


# -- detail pages ----------------------------------------------------------------------------------------

DETAIL_QUERIES = {"detail_a": "zestrogaming.com", "detail_b": "redtech.pk", "detail_c": "techmatched.pk"}


def _register_detail(name: str, source: str) -> None:
    def run(spark, sf_dir):
        systems = extract_details(detail_pages(spark, sf_dir, source), source)
        return systems.select("name", "price_pkr", "url", "source", "thumbnail_url", "components.cpu",
                              "components.gpu", "components.ram", "components.storage")
    query(f"WITH {detail_sql(source)} SELECT * FROM systems", name=name)(run)


for _name, _source in DETAIL_QUERIES.items():
    _register_detail(_name, _source)


@query("""
SELECT 'techmatched.pk' AS source, k // 24 + 1 AS page,
       'https://techmatched.pk/product/' || replace(p_name, ' ', '-') || '-' || p_partkey || '/' AS url
FROM (SELECT *, p_partkey // 10 AS k FROM part)""")
def category_links(spark, sf_dir):
    """Product links of one shop's category pages, each with the page it first stands on."""
    pages = listing_pages(spark, sf_dir, "techmatched.pk")
    links = product_links(pages, "techmatched.pk")
    return links.select("source", F.col("page").cast("bigint").alias("page"), "url")


_LINKS_SQL = """SELECT '{0}' AS source, k // 24 + 1 AS page,
       'https://{0}/product/' || replace(p_name, ' ', '-') || '-' || p_partkey || '/' AS url
FROM (SELECT *, p_partkey // 10 AS k FROM part)"""
_OTHER_SHOPS = ("zestrogaming.com", "redtech.pk")


@query(" UNION ALL ".join(_LINKS_SQL.format(source) for source in _OTHER_SHOPS))
def category_links_elsewhere(spark, sf_dir):
    """The same pages as two other shops print them, each with its own address and links of other shops between."""
    pages = listing_pages(spark, sf_dir, "techmatched.pk")
    found = [product_links(pages.withColumns({"source": F.lit(source), "html": F.concat(
        F.replace("html", F.lit("https://techmatched.pk/"), F.lit(f"https://{source}/")),
        F.lit('<a href="https://techmatched.pk/product/other/">'))}), source) for source in _OTHER_SHOPS]
    return found[0].unionAll(found[1]).select("source", F.col("page").cast("bigint").alias("page"), "url")


@query(" UNION ALL ".join(late_components_sql(source) for source in DETAIL_QUERIES.values()))
def late_components(spark, sf_dir):
    """The six components behind the warranty, one of them 400 characters long, on the pages of all three shops."""
    rows = [extract_details(detail_pages(spark, sf_dir, source), source).select(
        "source", "url", "components.motherboard", "components.psu", F.col("components.case").alias("tower"),
        "components.cpu_cooler", "components.case_fans", "components.os") for source in DETAIL_QUERIES.values()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


# -- the driver's pages ----------------------------------------------------------------------------------

_ENTITIES_SQL = ("replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
                 "'&#x27;', ''''), '&amp;', '&')")


@query("SELECT page_id, " + _ENTITIES_SQL.format(
    "trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'))")
    + " AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", unescape(title_text(F.col("html"))).alias("title"))


@query("""SELECT page_id, href, CASE WHEN starts_with(href, 'http') THEN href
       WHEN starts_with(href, '/') THEN 'https://www.czone.com.pk' || href
       ELSE 'https://www.czone.com.pk/' || href END AS address
FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"?#]+)"', 1))) AS href
      FROM pages)""")
def page_links(spark, sf_dir):
    """All different links of each page, as printed and in full."""
    links = F.array_distinct(find_all(F.col("html"), r'href="([^"?#]+)"'))
    return (table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("href"))
            .withColumn("address", absolute_url(CZONE_BASE, F.col("href"))))


@query("""SELECT page_id, trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), E' \\n\\t\\r') AS text FROM pages""")
def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", strip(strip_tags(F.col("html"), " ")).alias("text"))


@query("""SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS price_pkr FROM part""")
def price_texts(spark, sf_dir):
    """Prices as shops print them, read as numbers. The point is dropped like all that is no digit."""
    part = table(spark, sf_dir, "part")
    text = F.concat(F.lit("Rs. "), F.format_number("p_retailprice", 2))
    return part.select("p_partkey", price_digits(text).alias("price_pkr"))
