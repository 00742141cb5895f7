"""Shop pages rendered from the driver's part table, for the page queries to read back.

One card per part, two dozen to a page. What a card shows is told by the part's turn ``k``, its number
within its category: some are sold out, some show no price, some a sale price, some names carry an
entity, and the last card of a page is shown again on the next. The SQL beside says which rows a reader
of these pages must find.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.operators.crawl import seed_dimension
from samples.feed import category, sql_pick, table

PER_PAGE = 24


def _text(*pieces):
    """Text and columns, one after the other; columns may not be NULL."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _amount(number):
    """A number with thousands commas."""
    return F.format_number(number, 0)


def _dealt(spark: SparkSession, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out before pages are made of them: a part is few bytes and its pages are many, so that by the size of
    the table alone a few tasks would make them all."""
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, *keys)


def _card_facts(part: DataFrame) -> DataFrame:
    """What all shops' cards have in common."""
    k = F.floor(F.col("p_partkey") / 10)
    return part.select(
        F.col("p_partkey").alias("id"), k.alias("k"), category(F.col("p_partkey")).alias("category"),
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("path"),
        F.floor(F.col("p_retailprice") * 10).alias("price"),
        F.col("p_name").alias("plain"),
        (k % 11 == 3).alias("sold_out"), (k % 13 == 5).alias("priceless"), (k % 7 == 2).alias("on_sale"))


def _printed(c):
    """A name as it stands in the page: every fifth has an entity."""
    return _text(c("plain"), F.when(c("k") % 5 == 0, " &amp; more #").otherwise(" #"),
                 c("id").cast("string"))


def _currency(amount):
    return _text('<span class="woocommerce-Price-amount amount"><bdi><span class="'
                 'woocommerce-Price-currencySymbol">&#8360;</span>', amount, "</bdi></span>")


def _woo_price(c):
    now, before = _currency(_amount(c("price"))), _currency(_amount(c("price") + 500))
    return (F.when(c("priceless"), F.lit("")).when(c("on_sale"), _text("<del>", before, "</del> <ins>", now,
                                                                     "</ins>")).otherwise(now))


def _woodmart(source, link_tail="", lazy=False):
    def card(c):
        link = _text(f"https://{source}/product/", c("path"), "-", c("id").cast("string"), "/")
        stock = F.when(c("sold_out"), " outofstock").otherwise("")
        image = (_text('<img src="/lazy.svg" data-src="', link, 'i.jpg">') if lazy
                 else _text('<img src="', link, 'i.jpg">'))
        slide = (F.lit("") if lazy else F.when(
            c("k") % 4 == 1, _text('<div class="wd-product-grid-slide" data-image-url="https://',
                                   source, '/woocommerce-placeholder.png"></div>'))
            .otherwise(_text('<div class="wd-product-grid-slide" data-image-url="', link, 's.jpg"></div>')))
        return _text('<div data-id="1" class="wd-product-wrapper product-grid', stock, '">',
                     '<a class="wd-product-img-link" href="', link, link_tail, '" aria-label="',
                     _printed(c), '">', image, "</a>", slide, _woo_price(c), "</div>")
    return card


def _flatsome(source, named_class_first=True):
    def card(c):
        link = _text(f"https://{source}/product/", c("path"), "-", c("id").cast("string"))
        image = _text('<img class="wp-post-image" src="https://', source, "/wp-content/uploads/",
                      c("id").cast("string"), '.jpg">')
        anchor = (_text('<a class="woocommerce-LoopProduct-link" href="', link, '">') if named_class_first
                  else _text('<a href="', link, '" class="woocommerce-LoopProduct-link">'))
        return _text('<div class="col product-small box">', image,
                     '<p class="woocommerce-loop-product__title">', anchor, _printed(c), "</a></p>",
                     _woo_price(c), "</div>")
    return card


def _shopify(c):
    slug = _text("/products/", c("path"), "-", c("id").cast("string"))
    price = F.when(c("priceless"), F.lit("")).otherwise(_text(
        '<span class="price"><span class="visually-hidden">Sale price 9</span>Rs.',
        _amount(c("price")), ".00</span></div>"))
    return _text('<div class="product-item product-item--vertical"><img alt="" src="//cdn.shop/',
                 c("id").cast("string"), '.jpg?v=1&width=100" class="product-item__primary-image">',
                 '<a class="product-item__title" href="', slug, '">', _printed(c), "</a><div>", price,
                 F.when(c("sold_out"), '<span class="sold-out">Sold</span>').otherwise(""), "</div>")


def _woostify(c):
    link = _text("https://techmatched.pk/product/", c("path"), "-", c("id").cast("string"), "/")
    price = (F.when(c("priceless"), F.lit("")).when(c("on_sale"), _text(
        '<span class="woocommerce-Price-amount amount"><span class="woocommerce-Price-currencySymbol">'
        "Rs</span>", _amount(c("price")), "</span>"))
        .otherwise(_text('<script>{"price": ', c("price").cast("string"), "}</script>")))
    return _text('<li class="product type-product',
                 F.when(c("sold_out"), " outofstock").otherwise(""), '">',
                 '<a class="woocommerce-LoopProduct-link" href="', link, '">',
                 '<img src="https://techmatched.pk/wp-content/uploads/', c("id").cast("string"),
                 '-300x300.jpg"></a><h2 class="woocommerce-loop-product__title"><a href="#">Buy ',
                 _printed(c), " | TechMatched</a></h2>", price, "</li>")


def _join(cards):
    return F.array_join(cards, "\n")


def _plain_page(cards, total):
    return _text("<html><p>Showing 1 of ", total, " results</p>", _join(cards), "</html>")


def _list_page(cards, total):
    """A stray price follows the list, which belongs to no card."""
    return _text("<html><p>Showing 1 of ", total, ' results</p><ul class="products">', _join(cards),
                 '</ul><script>{"price": 1}</script></html>')


def _shopify_page(cards, total):
    return _text('<html><p class="collection__products-count-total">', total, " products</p>",
                 _join(cards), "</html>")


def _ld_card(c):
    """One JSON item; the price belongs to the page, and is put behind a tab for it."""
    return _text('{"name": " ', _printed(c), ' ", "url": "/', c("path"), "-", c("id").cast("string"),
                 '", "image": "', F.when(c("k") % 4 == 1, "").otherwise(_text(
                     "https://img.czone/", c("id").cast("string"), ".jpg")), '"}\t',
                 _text('<div class="product-price">Rs. ', _amount(c("price")), "</div>"))


def _ld_page(cards, total):
    items = F.transform(cards, lambda c: F.substring_index(c, "\t", 1))
    prices = F.transform(cards, lambda c: F.substring_index(c, "\t", -1))
    return _text("<html><p>", total, ' Products</p><script type="application/ld+json">{broken</script>',
                 '<script type="application/ld+json">{"@type": "Organization"}</script>',
                 # Whole objects with something behind them are no JSON.
                 *(f'<script type="application/ld+json">{{"@type": "CollectionPage", "mainEntity": '
                   f'{{"itemListElement": []}}}}{behind}</script>' for behind in ("]x", "}x")),
                 '<script type="application/ld+json">{"@type": "CollectionPage", "mainEntity": '
                 '{"itemListElement": [', F.array_join(items, ", "), "]}}</script>",
                 F.array_join(prices, "\n"), "</html>")


def _json_card(c):
    number = c("price").cast("string")
    price = (F.when(c("priceless"), F.lit('"ask us"'))
             .when(c("on_sale"), _text('{"price": 0, "salePrice": "', number, '.75"}'))
             .when(c("k") % 7 == 3, number)
             .otherwise(_text('{"price": ', number, ', "salePrice": 1}')))
    return _text('{"productName": "', F.when(c("sold_out"), " ").otherwise(_printed(c)),
                 '", "productURL": "', c("path"), "-", c("id").cast("string"), '", "productPrice": ', price,
                 ', "thumbnailFile": "', F.when(c("k") % 4 == 1, "").otherwise(_text(
                     c("id").cast("string"), ".jpg")), '", "imageFile": "big.jpg"}')


def _json_page(cards, total):
    number = F.replace(total, F.lit(","), F.lit(""))
    return _text('{"data": {"totalRecords": ', number, ', "results": [', F.array_join(cards, ", "), "]}}")


#: source -> (card of a part, page of its cards)
MARKUP = {
    "czone.com.pk": (_ld_card, _ld_page),
    "zahcomputers.pk": (_woodmart("zahcomputers.pk"), _plain_page),
    "amdhouse.pk": (_flatsome("amdhouse.pk"), _plain_page),
    "rbtechngames.com": (_flatsome("rbtechngames.com", named_class_first=False), _plain_page),
    "junaidtech.pk": (_json_card, _json_page),
    "techarc.pk": (_woodmart("techarc.pk"), _plain_page),
    "pakbyte.pk": (_shopify, _shopify_page),
    "redtech.pk": (_woodmart("redtech.pk", lazy=True), _plain_page),
    "techmatched.pk": (_woostify, _list_page),
}


def listing_pages(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """All listing pages of one shop, under the seed pages of the categories it carries."""
    card, page = MARKUP[source]
    facts = _card_facts(table(spark, sf_dir, "part"))
    seeds = F.broadcast(seed_dimension(spark).where(F.col("source") == source))
    number = (F.floor(F.col("k") / PER_PAGE) + 1).cast("int")
    is_last = F.col("k") % PER_PAGE == PER_PAGE - 1
    shown = facts.join(seeds, "category").withColumn(
        "page", F.explode(F.when(is_last, F.array(number, number + 1)).otherwise(F.array(number))))
    # Dealt out by page while a card is but its facts: its text is made where its page is, and never shuffled.
    shown = (_dealt(spark, shown, "source", "seed_url", "page")
             .select("seed_url", "source", "k", card(F.col).alias("card"), "page"))
    # At most 25 cards to a page.
    cards = F.array_sort(F.collect_list(F.struct("k", "card")))["card"]
    return (shown.groupBy("source", "seed_url", "page").agg(cards.alias("cards"))
            .select("source", "seed_url", "page",
                    F.concat("seed_url", F.lit("?page="), "page").alias("url"),
                    page(F.col("cards"), F.lit("1,234")).alias("html"),
                    F.lit("2002-01-01").cast("timestamp").alias("fetched_at")))


# -- the same in SQL -------------------------------------------------------------------------------------

def listing_sql(source: str) -> str:
    """The rows of one shop's listing pages, as (name, price_pkr, url, category, thumbnail_url, page)."""
    carried = ", ".join(f"'{c}'" for _, c in fixed.SEED_PAGES[source][1])
    read = "plain || CASE WHEN k % 5 = 0 THEN ' & more #' ELSE ' #' END || id"
    printed = "plain || CASE WHEN k % 5 = 0 THEN ' &amp; more #' ELSE ' #' END || id"
    price = "CASE WHEN k % 13 <> 5 THEN price END"
    page_url = f"'https://{source}/product/' || path || '-' || id"
    keep, name, url = "k % 11 <> 3", read, page_url + " || '/'"
    if source == "czone.com.pk":
        keep, name, price = "true", printed, "price"
        url = "'https://www.czone.com.pk/' || path || '-' || id"
        thumbnail = "CASE WHEN k % 4 <> 1 THEN 'https://img.czone/' || id || '.jpg' END"
    elif source == "zahcomputers.pk":
        name, thumbnail = printed, f"CASE WHEN k % 4 <> 1 THEN {url} || 's.jpg' END"
    elif source == "techarc.pk":
        thumbnail = f"{url} || CASE WHEN k % 4 <> 1 THEN 's.jpg' ELSE 'i.jpg' END"
    elif source == "redtech.pk":
        thumbnail = f"{url} || 'i.jpg'"
    elif source in ("amdhouse.pk", "rbtechngames.com"):
        # The first price of a card counts, which in a sale is the old one.
        keep, url, price = "true", page_url, "CASE WHEN k % 13 <> 5 THEN price + 500 * (k % 7 = 2)::INT END"
        name = printed if source == "amdhouse.pk" else read
        thumbnail = f"'https://{source}/wp-content/uploads/' || id || '.jpg'"
    elif source == "pakbyte.pk":
        url = "'https://www.pakbyte.pk/products/' || path || '-' || id"
        thumbnail = "'https://cdn.shop/' || id || '.jpg?v=1'"
    elif source == "techmatched.pk":
        thumbnail = "'https://techmatched.pk/wp-content/uploads/' || id || '.jpg'"
    else:
        name, url = printed, "'https://www.junaidtech.pk/' || path || '-' || id"
        thumbnail = ("'https://static.webx.pk/files/' || CASE WHEN k % 4 <> 1 THEN id || '.jpg' "
                     "ELSE 'big.jpg' END")
    return f"""facts AS (
  SELECT p_partkey AS id, p_partkey // 10 AS k, replace(p_name, ' ', '-') AS path, p_name AS plain,
         {sql_pick(fixed.CATEGORIES, "p_partkey")} AS category,
         CAST(floor(p_retailprice * 10) AS BIGINT) AS price
  FROM part),
numbered AS (
  SELECT *, k // {PER_PAGE} + 1 AS page FROM facts
  UNION ALL SELECT *, k // {PER_PAGE} + 2 FROM facts WHERE k % {PER_PAGE} = {PER_PAGE - 1}),
listed AS (
  SELECT {name} AS name, {price} AS price_pkr, {url} AS url, category, '{source}' AS source,
         {thumbnail} AS thumbnail_url, page
  FROM numbered WHERE {keep} AND category IN ({carried}))"""


# -- detail pages of complete systems --------------------------------------------------------------------


def _values(c):
    """The component values of a system: (label, value) in page order; NULL values are not shown."""
    number = c("id").cast("string")
    return (
        ("Processor", _text("Ryzen ", number)),
        ("Graphics Card", F.when(c("k") % 3 != 1, _text("RTX ", number))),
        ("RAM", _text((c("k") % 4 * 8 + 8).cast("string"), "GB")),
        ("SSD", _text(number, "GB NVMe")),
        ("HDD", F.lit("2TB")),
        ("Warranty", F.lit("1 year")),
        ("Motherboard", _text("B650-", number)),
        ("Power Supply", F.when(c("k") % 3 != 2, _text(number, " W"))),
        ("Case", _text("Mesh Tower " * 40, number)),
        ("CPU Cooler", _text("Air ", number)),
        ("Fans", _text("Three ", number)),
        ("Operating System", F.when(c("k") % 2 == 0, _text("Windows ", number))),
    )


def _lines(c, before, between, after):
    return F.concat(*[F.coalesce(_text(before, label, between, value, after), F.lit(""))
                      for label, value in _values(c)])


def _section_or_icons(c):
    """Every fourth page has icons instead of a section, every ninth neither."""
    section = _text('<h2>Full Specifications</h2><div><p>',
                    _lines(c, "<strong>", ":</strong> ", "<br>"), "</p></div>")
    icons = _text("<ul>", *[_text('<li class="i"><img src="/icon-', icon, '-80x80.png"/> ', value, "</li>")
                            for icon, value in (("cpu", _values(c)[0][1]), ("ram", _values(c)[2][1]),
                                                ("plug", F.lit("Schuko")))], "</ul>")
    return F.when(c("k") % 9 == 4, "").when(c("k") % 4 == 0, icons).otherwise(section)


def _table_or_emphasis(c):
    rows = _text("<table>", _lines(c, "<tr><td> ", "</td><td>", "</td><td>New</td></tr>"),
                 "<tr><td>Case</td><td>—</td></tr></table>")
    bold = _text("<p>", _lines(c, "<strong>", ":</strong> ", "<br>"), "</p>")
    return F.when(c("k") % 9 == 4, "").when(c("k") % 4 == 0, bold).otherwise(rows)


def _arrows_or_emphasis(c):
    rows = _text("<table>", _lines(c, "<tr><td>", " -&gt; ", " – New</td></tr>"), "</table>")
    bold = _text("<p>", _lines(c, "<b>", "</b>: ", "<br>"), "</p>")
    return F.when(c("k") % 9 == 4, "").when(c("k") % 4 == 0, bold).otherwise(rows)


_COMPONENT_MARKUP = {"zestrogaming.com": _section_or_icons, "redtech.pk": _table_or_emphasis,
                     "techmatched.pk": _arrows_or_emphasis}


def detail_pages(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """One detail page per part: every 17th sells a keyboard, every 13th shows no price."""
    facts, c = _card_facts(_dealt(spark, table(spark, sf_dir, "part"), "p_partkey")), F.col
    title = _text("Gaming ", F.when(c("k") % 17 == 6, "Keyboard ").otherwise(""), _printed(c))
    heading = F.when(c("k") % 6 == 0, _text("<h1>", title, "</h1>")).otherwise(
        _text('<h1 class="entry product_title"><b>', title, "</b> </h1>"))
    price = (F.when(c("priceless"), F.lit(""))
             .when(c("on_sale"), _text('<p class="price"><span class="woocommerce-Price-amount amount">'
                                       '<bdi><span class="s">Rs</span>', _amount(c("price")), "</bdi></span></p>"))
             .otherwise(_text('<script>{"offers": {"price": "', c("price").cast("string"),
                              '.50"}}</script>')))
    image = F.when(c("k") % 4 == 1, "woocommerce-placeholder.png").otherwise(_text(
        c("id").cast("string"), ".jpg"))
    html = _text('<html><head><meta property="og:image" content="https://img/', image, '"></head><body>',
                 heading, price, _COMPONENT_MARKUP[source](c), "</body></html>")
    return facts.select(
        F.lit(source).alias("source"), F.lit(None).cast("string").alias("seed_url"),
        c("id").cast("int").alias("page"),
        _text(f"https://{source}/product/pc-", c("id").cast("string")).alias("url"), html.alias("html"),
        F.lit("2002-01-01").cast("timestamp").alias("fetched_at"))


def detail_sql(source: str) -> str:
    """The systems on one shop's detail pages."""
    has_none, has_few = "k % 9 = 4", f"k % 4 = 0 AND {str(source == 'zestrogaming.com').lower()}"
    keep = "true" if source == "zestrogaming.com" else f"NOT ({has_none}) AND k % 17 <> 6"
    return f"""systems AS (
  SELECT 'Gaming ' || CASE WHEN k % 17 = 6 THEN 'Keyboard ' ELSE '' END
           || plain || CASE WHEN k % 5 = 0 THEN ' & more #' ELSE ' #' END || id AS name,
         CASE WHEN k % 13 <> 5 THEN price END AS price_pkr,
         'https://{source}/product/pc-' || id AS url, '{source}' AS source,
         CASE WHEN k % 4 <> 1 THEN 'https://img/' || id || '.jpg' END AS thumbnail_url,
         CASE WHEN NOT ({has_none}) THEN 'Ryzen ' || id END AS cpu,
         CASE WHEN NOT ({has_none}) AND NOT ({has_few}) AND k % 3 <> 1 THEN 'RTX ' || id END AS gpu,
         CASE WHEN NOT ({has_none}) THEN (k % 4 * 8 + 8) || 'GB' END AS ram,
         CASE WHEN NOT ({has_none}) AND NOT ({has_few}) THEN id || 'GB NVMe' END AS storage
  FROM (SELECT p_partkey AS id, p_partkey // 10 AS k, p_name AS plain,
               CAST(floor(p_retailprice * 10) AS BIGINT) AS price FROM part)
  WHERE {keep})"""


def late_components_sql(source: str) -> str:
    """The components that stand behind the warranty, on the systems of one shop's detail pages. The label of the fans
    is known to one shop only."""
    zestro = source == "zestrogaming.com"
    listed = f"NOT (k % 9 = 4) AND NOT (k % 4 = 0 AND {str(zestro).lower()})"
    keep = "true" if zestro else "NOT (k % 9 = 4) AND k % 17 <> 6"
    fields = {"motherboard": "'B650-' || id", "psu": "CASE WHEN k % 3 <> 2 THEN id || ' W' END",
              "tower": "repeat('Mesh Tower ', 40) || id", "cpu_cooler": "'Air ' || id",
              "case_fans": "'Three ' || id" if zestro else "CAST(NULL AS VARCHAR)",
              "os": "CASE WHEN k % 2 = 0 THEN 'Windows ' || id END"}
    columns = ", ".join(f"CASE WHEN {listed} THEN {value} END AS {name}" for name, value in fields.items())
    return (f"SELECT '{source}' AS source, 'https://{source}/product/pc-' || id AS url, {columns} "
            f"FROM (SELECT p_partkey AS id, p_partkey // 10 AS k FROM part) WHERE {keep}")
