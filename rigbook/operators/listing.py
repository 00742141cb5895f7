"""Product rows out of listing pages.

A shop is described by a small profile: how its page falls apart into cards, which cards are sold out,
and where name, address, price and picture stand in a card. :func:`extract_listing` is the one job that
runs any of them over a whole page table. It is narrow: pages are read, split, exploded and matched on
the JVM without a shuffle, and only texts with HTML entities visit Python.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import (MAX_LENGTH, absolute_url, bind, decimal_to_int, find, find_all,
                                    find_or_empty, strip, strip_tags, to_int, unescape,
                                    whole_json)
from rigbook.operators.crawl import stamp_category
from rigbook.schemas import FEED

ColumnStep = Callable[[Column], Column]

# Patterns of the Woodmart shop theme.
WOODMART_CARD = r'class="wd-product-wrapper'
WOODMART_CARD_TAG = r'(?=<div[^>]+class="wd-product-wrapper)'
WOODMART_NAME = r'class="wd-product-img-link[^"]*"[^>]*aria-label="([^"]+)"'
WOODMART_TITLE = r'(?U)class="wd-entities-title"[^>]*>\s*<[^>]+>([^<]+)<'
WOODMART_SALE = (r'(?sU)<ins[^>]*>.*?woocommerce-Price-amount[^>]*><bdi>[^<]*<span[^>]+>[^<]*</span>'
                 r'([\d,]+)')
WOODMART_PRICE = r'(?U)woocommerce-Price-amount amount"><bdi><span[^>]+>[^<]+</span>([\d,]+)'
# Blanks and &nbsp; in any mix, with the blanks outside the group: Java recurses with each of its rounds.
WOODMART_SYMBOL_PRICE = (r'<bdi>\s*<span[^>]*woocommerce-Price-currencySymbol[^>]*>[^<]*</span>'
                         r'\s*(?:&nbsp;\s*)*([\d,]+)')
WOODMART_SLIDE = r'class="wd-product-grid-slide[^"]*"[^>]*data-image-url="([^"]+)"'
WOODMART_IMAGE = r'(?U)class="wd-product-img-link[^"]*"[^>]*>\s*<img[^>]+src="([^"]+)"'
WOODMART_LAZY_IMAGE = r'(?s)class="wd-product-img-link[^"]*"[^>]*>.*?<img[^>]+data-src="([^"]+)"'
WOODMART_ANY_IMAGE = r'(?s)class="wd-product-img-link[^"]*"[^>]*>.*?<img[^>]+src="([^"]+)"'
WOODMART_LEADING_CLASS = r'^<div[^>]+class="([^"]*)"'
WOODMART_STOCK = r'<p[^>]+class="[^"]*wd-product-stock[^"]*out-of-stock'
PLACEHOLDER = "woocommerce-placeholder"

# Patterns of the Flatsome shop theme.
FLATSOME_CARD = r'(?U)(?=<div[^>]+class="[^"]*product-small\s)'
FLATSOME_TITLE = "woocommerce-loop-product__title"
FLATSOME_NAME = r'woocommerce-loop-product__title[^>]*><a[^>]+>([^<]+)'
FLATSOME_PRICE = r'(?sU)woocommerce-Price-amount[^>]*><bdi>.*?</span>([\d,]+)</bdi>'
FLATSOME_URL = r'(?U)woocommerce-LoopProduct-link[^"]*"\s+href="([^"]+)"'
FLATSOME_POST_IMAGE = r'<img[^>]+class="[^"]*wp-post-image[^"]*"[^>]+src="([^"]+)"'

# Patterns of the Shopify shop theme.
SHOPIFY_CARD = r'class="product-item product-item--vertical'
SHOPIFY_URL = r'href="(/products/[^"?#]+)"'
SHOPIFY_NAME = r'class="product-item__title[^"]*"[^>]*>([^<]+)</a>'
SHOPIFY_PRICE_SPAN = r'(?sU)<span[^>]*class="price[^"]*"[^>]*>(.*?)</span>(?:\s*</div>|\s*<)'
SHOPIFY_INNER_SPAN = r'(?s)<span[^>]*>.*?</span>'
SHOPIFY_AMOUNT = r'(?U)(\d[\d,]*?)(?:\.\d+)?(?:\s|$)'
SHOPIFY_DIGITS = r'(?U)([\d,]+)'
SHOPIFY_IMAGE = (r'<img[^>]+src="([^"]+)"[^>]+class="product-item__primary-image"',
                 r'<img[^>]*class="product-item__primary-image"[^>]+src="([^"]+)"')
SHOPIFY_WIDTH = r'(?U)([?&])width=\d+(&|$)'

# Patterns of the Woostify shop theme.
WOOSTIFY_CARD = r'(?=<li class="product type-product[^"]*"[^>]*>)'
WOOSTIFY_LEADING_CLASS = r'^<li[^>]+class="([^"]*)"'
WOOSTIFY_STOCK = r'(?U)<p[^>]+class="[^"]*\bstock\b[^"]*\bout-of-stock\b'
WOOSTIFY_NAME = r'(?U)class="woocommerce-loop-product__title"[^>]*>\s*<a[^>]*>([^<]+)</a>'
WOOSTIFY_URL = (r'<a[^>]+class="[^"]*woocommerce-LoopProduct-link[^"]*"[^>]+'
                r'href="(https://techmatched\.pk/product/[^"?#]+)"',
                r'href="(https://techmatched\.pk/product/[^"?#]+)"')
WOOSTIFY_DATA_PRICE = (r'(?U)wpmDataLayer\)\.products\[\d+\]\s*=\s*\{[^}]*"price"\s*:\s*(\d+)',
                       r'(?U)"price"\s*:\s*(\d+)')
WOOSTIFY_PRICE = (r'(?U)<span class="woocommerce-Price-amount amount"><span '
                  r'class="woocommerce-Price-currencySymbol">[^<]*</span>([\d,]+)')
WOOSTIFY_IMAGE = r'<img[^>]+src="(https://techmatched\.pk/wp-content/uploads/[^"]+)"'
WOOSTIFY_IMAGE_SIZE = r'(?U)-\d+x\d+(?=\.\w+$)'

# Patterns and addresses of the pages that carry structured data.
LD_JSON_BLOCK = r'(?s)<script type="application/ld\+json">(.*?)</script>'
LD_JSON_PRICE = r'(?U)class="product-price">Rs\.\s*([\d,]+)'
CZONE_BASE = "https://www.czone.com.pk"
PAKBYTE_BASE = "https://www.pakbyte.pk"
JUNAIDTECH_BASE = "https://www.junaidtech.pk"
JUNAIDTECH_FILES = "https://static.webx.pk/files"

# Addresses of products, prices and pictures by shop, by preference where there are several.
ZAH_URL = r'href="(https://zahcomputers\.pk/product/[^"]+)"'
TECHARC_URL = (r'(?U)class="wd-product-img-link[^"]*"\s+href="(https://techarc\.pk/[^"?#]+)"',
               r'href="(https://techarc\.pk/[^"?#]+/)"')
REDTECH_URL = (r'(?U)class="wd-product-img-link[^"]*"\s+href="(https://redtech\.pk/[^"?#]+)"',
               r'href="(https://redtech\.pk/product/[^"?#]+)"')
REDTECH_PRICE = (r"(?sU)<ins[^>]*>.*?" + WOODMART_SYMBOL_PRICE, "(?sU)" + WOODMART_SYMBOL_PRICE)
AMDHOUSE_URL = (FLATSOME_URL, r'href="(https://amdhouse\.pk/product/[^"]+)"')
AMDHOUSE_IMAGE = r'<img[^>]+src="(https://amdhouse\.pk/wp-content/uploads/[^"]+)"'
RBTECH_URL = (r'href="(https://rbtechngames\.com/[^"]+)"[^>]*class="woocommerce-LoopProduct',
              r'href="(https://rbtechngames\.com/shop[^"]+)"',
              r'href="(https://rbtechngames\.com/[^"]+)"')
RBTECH_IMAGE = (FLATSOME_POST_IMAGE, r'<img[^>]+src="(https://rbtechngames\.com/wp-content/uploads/[^"]+)"')

# Marks of sold-out cards and of stand-in pictures, and one shop's slogan round its names, in small letters.
SOLD_OUT = "outofstock"
SHOPIFY_SOLD_OUT = ("inventory--out", "sold-out")
SHOPIFY_STAND_INS = ("placeholder", "no-image")
LAZY = "lazy"
SLOGAN_HEAD, SLOGAN_TAIL = "buy ", "| techmatched"

# The only entities one shop's names are decoded from.
THREE_ENTITIES = (("&#8211;", "–"), ("&amp;", "&"), ("&#039;", "'"))


@dataclass(frozen=True)
class CardProfile:
    """A shop whose pages are a sequence of cards. Each field but the flag maps a text to a value."""

    cards: ColumnStep          # page -> array of cards
    sold_out: ColumnStep       # card -> boolean
    name: ColumnStep           # card -> text as printed; NULL drops the card
    clean_name: ColumnStep     # that text -> name
    url: ColumnStep            # card -> address or NULL
    price: ColumnStep          # card -> price as printed, or NULL
    thumbnail: ColumnStep      # card -> address or NULL
    clean_price: ColumnStep = to_int  # that text -> bigint or NULL
    needs_url: bool = False    # drop cards without an address


# -- cutting pages into cards --------------------------------------------------------------------------

def _split_after(pattern: str) -> ColumnStep:
    """Cards start behind each match; what stands before the first is page header."""
    return lambda page: F.slice(F.split(page, pattern), 2, MAX_LENGTH)


def _split_before(pattern: str) -> ColumnStep:
    """As above for a zero-width pattern. The blank in front keeps Java from dropping the (empty)
    header when the page begins with a card."""
    return lambda page: _split_after(pattern)(F.concat(F.lit(" "), page))


def _pieces_with(pattern: str, marker: str) -> ColumnStep:
    return lambda page: F.filter(F.split(page, pattern), lambda piece: piece.contains(marker))


def _list_items(pattern: str) -> ColumnStep:
    """Cards as list items; the last one ends with its list, not with the page."""
    def end_last(items):
        return F.transform(items, lambda item, i: F.when(
            i == F.size(items) - 1, F.substring_index(item, "</ul>", 1)).otherwise(item))
    return lambda page: bind(_split_before(pattern)(page), end_last)


# -- values in a card ----------------------------------------------------------------------------------

def _first(*patterns: str) -> ColumnStep:
    return lambda card: find(card, *patterns)


def _contains(*words: str) -> ColumnStep:
    def test(card):
        condition = card.contains(words[0])
        for word in words[1:]:
            condition = condition | card.contains(word)
        return condition
    return test


def _marked_out_of_stock(leading_class: str, stock: str) -> ColumnStep:
    """Sold out by the class of the card's own tag or by a stock paragraph; nested hints do not count."""
    return lambda card: (F.regexp_extract(card, leading_class, 1).contains(SOLD_OUT)
                         | card.rlike(stock))


def _never(card: Column) -> Column:
    return F.lit(False)


def _decoded(text: Column) -> Column:
    return strip(unescape(text))


def _three_entities(text: Column) -> Column:
    text = strip(text)
    for entity, character in THREE_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def _without_slogan(text: Column) -> Column:
    """Drop the shop's 'Buy …' in front and '… | TechMatched' behind."""
    def without_head(name):
        return F.when(F.lower(name).startswith(SLOGAN_HEAD),
                      strip(F.substring(name, len(SLOGAN_HEAD) + 1, MAX_LENGTH))).otherwise(name)

    def without_tail(name):
        head = strip(F.rtrim(F.substring(name, F.lit(1), F.length(name) - len(SLOGAN_TAIL)), F.lit(" |")))
        return F.when(F.lower(name).endswith(SLOGAN_TAIL), head).otherwise(name)
    return bind(bind(_decoded(text), without_head), without_tail)


def _real(address: Column, *unwanted: str) -> Column:
    """An image address, unless it is a stand-in."""
    return F.when(~_contains(PLACEHOLDER, *unwanted)(address), address)


def _lazy_thumbnail(card: Column) -> Column:
    return F.coalesce(_real(find(card, WOODMART_SLIDE)), _real(find(card, WOODMART_LAZY_IMAGE)),
                      _real(find(card, WOODMART_ANY_IMAGE), LAZY))


def _shopify_price(card: Column) -> Column:
    text = F.regexp_replace(find_or_empty(card, SHOPIFY_PRICE_SPAN), SHOPIFY_INNER_SPAN, "")
    return strip_tags(text)


def _shopify_amount(text: Column) -> Column:
    return bind(unescape(text), lambda amount: to_int(find(amount, SHOPIFY_AMOUNT, SHOPIFY_DIGITS)))


def _shopify_thumbnail(card: Column) -> Column:
    src = find(card, *SHOPIFY_IMAGE)
    src = F.when(~_contains(*SHOPIFY_STAND_INS)(F.lower(src)), src)
    src = F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).otherwise(src)
    return F.rtrim(F.regexp_replace(src, SHOPIFY_WIDTH, "$1"), F.lit("?&"))


PROFILES = {
    "zahcomputers.pk": CardProfile(
        cards=_split_after(WOODMART_CARD),
        sold_out=_contains(SOLD_OUT),
        name=_first(WOODMART_NAME), clean_name=strip,
        url=_first(ZAH_URL),
        price=_first(WOODMART_SALE, WOODMART_PRICE),
        thumbnail=lambda card: _real(find(card, WOODMART_SLIDE)),
    ),
    "techarc.pk": CardProfile(
        cards=_split_after(WOODMART_CARD),
        sold_out=_contains(SOLD_OUT),
        name=_first(WOODMART_NAME), clean_name=_decoded,
        url=_first(*TECHARC_URL),
        price=_first(WOODMART_SALE, WOODMART_PRICE),
        thumbnail=lambda card: F.coalesce(_real(find(card, WOODMART_SLIDE)),
                                          _real(find(card, WOODMART_IMAGE))),
    ),
    "redtech.pk": CardProfile(
        cards=_split_before(WOODMART_CARD_TAG),
        sold_out=_marked_out_of_stock(WOODMART_LEADING_CLASS, WOODMART_STOCK),
        name=_first(WOODMART_NAME, WOODMART_TITLE), clean_name=_decoded,
        url=_first(*REDTECH_URL),
        price=_first(*REDTECH_PRICE),
        thumbnail=_lazy_thumbnail,
    ),
    "amdhouse.pk": CardProfile(
        cards=_pieces_with(FLATSOME_CARD, FLATSOME_TITLE),
        sold_out=_never,
        name=_first(FLATSOME_NAME), clean_name=strip,
        url=_first(*AMDHOUSE_URL),
        price=_first(FLATSOME_PRICE),
        thumbnail=_first(AMDHOUSE_IMAGE),
    ),
    "rbtechngames.com": CardProfile(
        cards=_pieces_with(FLATSOME_CARD, FLATSOME_TITLE),
        sold_out=_never,
        name=_first(FLATSOME_NAME), clean_name=_three_entities,
        url=_first(*RBTECH_URL),
        price=_first(FLATSOME_PRICE),
        thumbnail=_first(*RBTECH_IMAGE),
    ),
    "pakbyte.pk": CardProfile(
        cards=_split_after(SHOPIFY_CARD),
        sold_out=_contains(*SHOPIFY_SOLD_OUT),
        name=_first(SHOPIFY_NAME), clean_name=_decoded,
        url=lambda card: F.concat(F.lit(PAKBYTE_BASE), find(card, SHOPIFY_URL)),
        price=_shopify_price, clean_price=_shopify_amount,
        thumbnail=_shopify_thumbnail,
        needs_url=True,
    ),
    "techmatched.pk": CardProfile(
        cards=_list_items(WOOSTIFY_CARD),
        sold_out=_marked_out_of_stock(WOOSTIFY_LEADING_CLASS, WOOSTIFY_STOCK),
        name=_first(WOOSTIFY_NAME), clean_name=_without_slogan,
        url=_first(*WOOSTIFY_URL),
        # Where the data layer has a figure, the printed price is not looked at.
        price=_first(*WOOSTIFY_DATA_PRICE, WOOSTIFY_PRICE),
        thumbnail=lambda card: F.regexp_replace(_real(find(card, WOOSTIFY_IMAGE)),
                                                WOOSTIFY_IMAGE_SIZE, ""),
    ),
}


def _card_rows(profile: CardProfile, pages: DataFrame, about: list) -> DataFrame:
    """A card is read inside a generator: Spark moves no filter below one, so that each value is worked
    out once, and of a sold-out card none is."""
    card = F.col("card")
    read = F.struct(profile.name(card).alias("printed"), profile.url(card).alias("url"),
                    profile.price(card).alias("price"), profile.thumbnail(card).alias("thumbnail_url"))
    rows = (pages.select(*about, F.posexplode(profile.cards(F.col("html"))).alias("pos", "card"))
            .select(*about, "pos", F.inline(F.when(~profile.sold_out(card), F.array(read))))
            .where("printed is not null"))
    if profile.needs_url:
        rows = rows.where("url is not null")
    return rows.select(*about, "pos", profile.clean_name(F.col("printed")).alias("name"),
                       F.coalesce("url", F.lit("")).alias("url"),
                       profile.clean_price(F.col("price")).alias("price_pkr"), "thumbnail_url")


# -- pages with structured data ------------------------------------------------------------------------

_COLLECTION = (
    "`@type` string, mainEntity struct<itemListElement: array<struct<name: string, url: string, "
    "image: string>>>")

_PAYLOAD = (
    "data struct<results: array<struct<productName: string, productURL: string, "
    "productPrice: variant, thumbnailFile: string, imageFile: string>>>")


def _jsonld_rows(pages: DataFrame, about: list) -> DataFrame:
    """Names and addresses from the page's first product collection; prices stand elsewhere on the
    page and belong to the items by position, so an item without a price shifts the later ones."""
    html = F.col("html")
    blocks = F.transform(find_all(html, LD_JSON_BLOCK), lambda b: whole_json(b, f"struct<{_COLLECTION}>"))
    collection = F.get(F.filter(blocks, lambda b: b["@type"] == "CollectionPage"), F.lit(0))
    items = collection["mainEntity"]["itemListElement"]
    return (pages.select(*about, find_all(html, LD_JSON_PRICE).alias("prices"), items.alias("items"))
            .select(*about, "prices", F.posexplode("items").alias("pos", "item"))
            .select(*about, "pos",
                    strip(F.coalesce("item.name", F.lit(""))).alias("name"),
                    absolute_url(CZONE_BASE, F.col("item.url")).alias("url"),
                    to_int(F.get("prices", F.col("pos"))).alias("price_pkr"),
                    F.nullif("item.image", F.lit("")).alias("thumbnail_url")))


def _listed_price(value: Column) -> Column:
    """A price given as a number, or as an object whose first usable price counts.

    Zero, false, null and the empty text are not usable; the text "0" is. A bare text is no price.
    """
    kind = F.schema_of_variant(value)

    def usable(path):
        inner = F.try_variant_get(value, path, "variant")
        text = F.try_variant_get(value, path, "string")
        is_text = F.schema_of_variant(inner) == "STRING"
        empty = F.when(is_text, text == "").otherwise(
            F.coalesce(text.try_cast("double") == 0, F.lit(False)) | (text == "false"))
        return F.when(~empty, text)

    fields = F.coalesce(*[usable(f"$.{f}") for f in ("price", "salePrice", "regularPrice")])
    return (F.when(kind.startswith("OBJECT"), decimal_to_int(fields))
            .when(kind != "STRING", decimal_to_int(F.try_variant_get(value, "$", "string"))))


def _payload_rows(pages: DataFrame, about: list) -> DataFrame:
    payload = whole_json(F.col("html"), f"struct<{_PAYLOAD}>")
    item = F.col("item")
    slug = F.coalesce(item["productURL"], F.lit(""))
    picture = F.coalesce(F.nullif(item["thumbnailFile"], F.lit("")),
                         F.nullif(item["imageFile"], F.lit("")))
    return (pages.select(*about, payload["data"]["results"].alias("results"))
            .select(*about, F.posexplode("results").alias("pos", "item"))
            .select(*about, "pos", "item", strip(item["productName"]).alias("name"))
            .where("name <> ''")
            .select(*about, "pos", "name",
                    F.when((slug != "") & ~slug.startswith("http"),
                           F.concat(F.lit(JUNAIDTECH_BASE + "/"), slug)).otherwise(slug).alias("url"),
                    _listed_price(item["productPrice"]).alias("price_pkr"),
                    F.when(picture.startswith("http"), picture)
                    .otherwise(F.concat(F.lit(JUNAIDTECH_FILES + "/"), picture))
                    .alias("thumbnail_url")))


# -- the job -------------------------------------------------------------------------------------------

_ABOUT = ["source", "category", "source_no", "category_no", "page", "fetched_at"]


def extract_listing(pages: DataFrame, source: str) -> DataFrame:
    """All product rows of one shop's listing pages, as a feed. Rows of a page keep its fetch time."""
    own = stamp_category(pages.where(F.col("source") == source))
    if source == "czone.com.pk":
        rows = _jsonld_rows(own, _ABOUT)
    elif source == "junaidtech.pk":
        rows = _payload_rows(own, _ABOUT)
    elif source in PROFILES:
        rows = _card_rows(PROFILES[source], own, _ABOUT)
    else:
        raise ValueError(f"no listing profile for {source!r}; known: {fixed.PART_SOURCES}")
    seq = F.struct("source_no", "category_no", "page", "pos").alias("seq")
    return rows.select("name", "price_pkr", "url", "category", "source",
                       F.col("fetched_at").alias("scraped_at"), "thumbnail_url", seq).to(FEED)


def extract_gpu_listing(pages: DataFrame) -> DataFrame:
    """The graphics-card listing of the JSON-LD shop alone; it carries no pictures."""
    gpu = extract_listing(pages, "czone.com.pk").where("category = 'gpu'")
    return gpu.withColumn("thumbnail_url", F.lit(None).cast("string"))
