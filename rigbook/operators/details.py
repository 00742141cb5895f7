"""Complete systems out of shop pages: product links of a category, and one row per detail page."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import (MAX_LENGTH, bind, contains_any, decimal_to_int, find, find_all,
                                    find_or_empty, strip, strip_tags, to_int, unescape)
from rigbook.operators.crawl import first_seen
from rigbook.schemas import COMPONENTS, PREBUILT_FEED

# Patterns of the detail pages.
TITLE = (r'(?isU)class="[^"]*product_title[^"]*"[^>]*>(.*?)</h1>', r'(?s)<h1[^>]*>(.*?)</h1>')
OFFER_PRICE = r'(?U)"price"\s*:\s*"?([\d.]+)"?'
MARKUP_PRICE = r'(?U)woocommerce-Price-amount amount">\s*<bdi>\s*<span[^>]+>[^<]+</span>([\d,]+)'
SHARED_IMAGE = r'<meta property="og:image" content="([^"]+)"'
PLACEHOLDER = "woocommerce-placeholder"

# Product links on the category pages.
ZESTRO_LINK = r'href="(https://zestrogaming\.com/product/[^"?#]+)"'
REDTECH_LINK = r'href="(https://redtech\.pk/product/[^"?#]+)"'
TECHMATCHED_LINK = r'href="(https://techmatched\.pk/product/[^"?#]+)"'

# Patterns of the component lists; group 1 is the label, group 2 the value.
SECTION_TITLE = "Full Spec"
SECTION_END = r'(?i)<h[1-3][\s>]|</section>'
SECTION_PAIR = r'(?s)<strong>(.*?)</strong>(.*?)(?=<strong>|</p>|<br|</div>)'
ICON_VALUE = r'(?is)^[^>]*>.*?<img[^>]+src="[^"]*icon-([a-z]+)[^"]*"[^>]*/?>(.{3,}?)</li>'
LIST_ITEM = r'(?i)<li(?=[\s>])'
TABLE_PAIR = (r'(?iU)<tr[^>]*>\s*<td[^>]*>\s*([^<]{2,}?)\s*</td>\s*'
              r'<td[^>]*>\s*([^<]{2,}?)\s*</td>')
STRONG_PAIR = (r'(?iU)<strong>\s*([^<]{2,}?)\s*:?\s*</strong>\s*(?:<br\s*/?>|:)?\s*'
               r'([^<\n]{3,})')
BOLD_PAIR = (r'(?iU)<(?:strong|b)>\s*([^<]{2,}?)\s*:?\s*</(?:strong|b)>\s*(?:<br\s*/?>|:)?\s*'
             r'([^<\n]{3,})')
TABLE_ROW = r'(?is)<tr[^>]*>(.*?)</tr>'
ENTITY = r'(?U)&#\d+;|&[a-z]+;'
ARROW = r'(?iU)^(.+?)\s*->\s*(.+?)(?:\s*[–\-]+\s*(?:New|Used|Refurbished))?$'
DASHED_CONDITION = r'(?iU)\s*[\-–]+\s*(New|Used|Refurbished)\s*$'
CONDITION = r'(?iU)\s+(New|Used|Refurbished)\s*$'
NO_VALUE = "—"

_PAIRS = "array<struct<label: string, value: string>>"

Pairs = Callable[[Column], Column]


@dataclass(frozen=True)
class DetailProfile:
    """A shop's detail pages: where labelled components stand, by preference, and what to keep."""

    links: str                       # pattern of product links on a category page
    components: tuple[Pairs, Pairs]  # page -> array<struct<label, value>>; the second is the fallback
    keep_without_components: bool = False


def _pairs(labels: Column, values: Column) -> Column:
    return F.zip_with(labels, values, lambda l, v: F.struct(
        F.rtrim(F.lower(strip(strip_tags(l))), F.lit(":")).alias("label"),
        strip(strip_tags(v)).alias("value")))


def _section_pairs(html: Column) -> Column:
    """Pairs of the specification section, from its title to its end or the next heading, so that lists of other
    products further down the page fill no gap; unknown labels are dropped later."""
    start = F.locate(SECTION_TITLE, html)
    section = F.when(start > 0, F.get(F.split(F.substring(html, start, F.length(html)), SECTION_END, 2), F.lit(0)))
    return bind(section, lambda text: _pairs(find_all(text, SECTION_PAIR, 1), find_all(text, SECTION_PAIR, 2)))


def _icon_pairs(html: Column) -> Column:
    """The icon's file name is the label, and has to be in small letters.

    The page is cut into its list items first, so that an item without an icon is looked through once.
    """
    items = F.slice(F.split(html, LIST_ITEM), 2, MAX_LENGTH)
    return F.transform(F.filter(items, lambda item: item.rlike(ICON_VALUE)), lambda item: F.struct(
        F.regexp_extract(item, ICON_VALUE, 1).alias("label"),
        strip(strip_tags(F.regexp_extract(item, ICON_VALUE, 2))).alias("value")))


def _table_pairs(html: Column) -> Column:
    return F.filter(_pairs(find_all(html, TABLE_PAIR, 1), find_all(html, TABLE_PAIR, 2)),
                    lambda p: p["value"] != NO_VALUE)


def _emphasis_pairs(pattern: str) -> Pairs:
    def pairs(html):
        found = _pairs(find_all(html, pattern, 1), find_all(html, pattern, 2))
        return F.transform(found, lambda p: F.struct(
            p["label"].alias("label"), strip(F.ltrim(p["value"], F.lit(":"))).alias("value")))
    return pairs


def _arrow_pairs(html: Column) -> Column:
    """Table rows read as 'Label -> Value – New'; the condition behind the value is cut off."""
    def row_text(row):
        text = F.regexp_replace(strip_tags(row, " "), "&gt;", ">")
        return strip(F.regexp_replace(F.regexp_replace(text, ENTITY, " "), r"(?U)\s+", " "))

    def pair(text):
        value = strip(F.regexp_extract(text, ARROW, 2))
        value = strip(F.regexp_replace(value, DASHED_CONDITION, ""))
        value = strip(F.regexp_replace(value, CONDITION, ""))
        label = F.rtrim(F.lower(strip(F.regexp_extract(text, ARROW, 1))), F.lit(":"))
        return F.struct(label.alias("label"), value.alias("value"))

    rows = F.transform(find_all(html, TABLE_ROW), row_text)
    return F.filter(F.transform(rows, pair), lambda p: p["value"] != NO_VALUE)


DETAIL_PROFILES = {
    "zestrogaming.com": DetailProfile(
        links=ZESTRO_LINK,
        components=(_section_pairs, _icon_pairs), keep_without_components=True),
    "redtech.pk": DetailProfile(
        links=REDTECH_LINK,
        components=(_table_pairs, _emphasis_pairs(STRONG_PAIR))),
    "techmatched.pk": DetailProfile(
        links=TECHMATCHED_LINK,
        components=(_arrow_pairs, _emphasis_pairs(BOLD_PAIR))),
}


def _labels(source: str) -> dict[str, str]:
    return {**fixed.COMPONENT_LABELS, **fixed.COMPONENT_LABELS_BY_SOURCE.get(source, {})}


def known_components(html: Column, source: str) -> Column:
    """The labelled values of a page that name a component, as array<struct<label, value>>.

    The shop's lists are tried in turn, and a later one is read only if those before gave nothing.
    """
    labels = _labels(source)

    def known(pairs):
        return F.filter(pairs, lambda p: p["label"].isin(*labels) & (p["value"] != ""))

    first, second = DETAIL_PROFILES[source].components
    return bind(F.coalesce(known(first(html)), F.array().cast(_PAIRS)),
                lambda hits: F.when(F.size(hits) > 0, hits).otherwise(known(second(html))))


def component_struct(hits: Column, source: str) -> Column:
    """Known components as a struct: the first value of a field wins; NULL if there is none.

    (A map would not do: building one fails on repeated labels.)
    """
    labels = _labels(source)

    def first_value(field):
        names = [label for label, f in labels.items() if f == field]
        if not names:
            return F.lit(None).cast("string")
        return F.get(F.filter(hits, lambda p: p["label"].isin(*names)), F.lit(0))["value"]

    struct = F.struct(*[first_value(f).alias(f) for f in fixed.COMPONENT_FIELDS])
    return F.when(F.size(hits) > 0, struct).cast(COMPONENTS)


def product_links(pages: DataFrame, source: str) -> DataFrame:
    """(source, page, pos, url): product links of a shop's category pages, each where it first shows up."""
    links = find_all(F.col("html"), DETAIL_PROFILES[source].links)
    rows = (pages.where(F.col("source") == source)
            .select("source", "page", F.posexplode(F.array_distinct(links)).alias("pos", "url")))
    return first_seen(rows, ["source", "url"], F.col("page"))


def title_text(html: Column) -> Column:
    """The product title, or else the first main heading, without tags; NULL if there is neither."""
    return strip(strip_tags(find_or_empty(html, *TITLE)))


def offer_price(html: Column) -> Column:
    """The structured offer's price, cut to whole rupees, or else the printed one."""
    return F.coalesce(decimal_to_int(find(html, OFFER_PRICE)), to_int(find(html, MARKUP_PRICE)))


def extract_details(pages: DataFrame, source: str) -> DataFrame:
    """One row per detail page of a shop that is a complete system, as a prebuilt feed.

    ``page`` is the page's position in the crawl. A narrow job, as the listing one is. The page is read
    inside a generator, because Spark moves no filter below one: without it, each filter on a value
    would work that value out a second time.
    """
    html = F.col("html")
    image = find(html, SHARED_IMAGE)
    read = F.struct(title_text(html).alias("title"), offer_price(html).alias("price_pkr"),
                    F.when(~image.contains(PLACEHOLDER), image).alias("thumbnail_url"),
                    known_components(html, source).alias("hits"))
    rows = (pages.where(F.col("source") == source)
            .select("source", "url", "page", "fetched_at", F.inline(F.array(read)))
            .where("title is not null"))
    if not DETAIL_PROFILES[source].keep_without_components:
        rows = rows.where("size(hits) > 0")
    rows = rows.select("*", unescape(F.col("title")).alias("name"))
    if fixed.NOT_A_SYSTEM[source]:
        rows = rows.where(bind(F.lower("name"), lambda name: ~contains_any(name, fixed.NOT_A_SYSTEM[source])))
    return rows.select(
        "name", "price_pkr", "url", "source", F.col("fetched_at").alias("scraped_at"), "thumbnail_url",
        component_struct(F.col("hits"), source).alias("components"),
        F.struct(F.lit(fixed.PREBUILT_SOURCES.index(source)).alias("source_no"),
                 F.lit(0).alias("category_no"), "page", F.lit(0).alias("pos")).alias("seq")
    ).to(PREBUILT_FEED)
