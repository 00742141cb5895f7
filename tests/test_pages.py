"""Page profiles on small pages of their own markup: what is skipped, what falls back, what wins."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from rigbook import fixed, schemas, session
from rigbook.operators import crawl
from rigbook.operators.details import extract_details, product_links
from rigbook.operators.listing import extract_gpu_listing, extract_listing
from rigbook.plans import refresh
from rigbook.session import scratch_path
from rigbook.sources.tables import CatalogueTables

AT = datetime.datetime(2024, 1, 1)


def seed(source, category="gpu"):
    pattern, seeds = fixed.SEED_PAGES[source]
    return next(pattern.format(path) for path, c in seeds if c == category)


def pages(spark, source, *htmls, category="gpu"):
    rows = [(source, seed(source, category), n, f"u{n}", h, AT) for n, h in enumerate(htmls, 1)]
    return spark.createDataFrame(rows, schemas.PAGES)


def listed(spark, source, *htmls):
    rows = extract_listing(pages(spark, source, *htmls), source)
    rows = rows.orderBy("seq").collect()
    assert all(r["category"] == "gpu" and r["scraped_at"] == AT for r in rows)
    return [(r["name"], r["price_pkr"], r["url"], r["thumbnail_url"]) for r in rows]


# -- listings --------------------------------------------------------------------------------------------

def jsonld(items, prices):
    block = {"@type": "CollectionPage", "mainEntity": {"itemListElement": items}}
    divs = "".join(f'<div class="product-price">Rs. {p}</div>' for p in prices)
    return ('<script type="application/ld+json">{oops</script><script type="application/ld+json">'
            f'{json.dumps(block)}</script>{divs}')


def test_jsonld_pairs_prices_by_position(spark):
    html = jsonld([{"name": " A ", "url": "/a", "image": "i"}, {"name": "B", "url": "b"},
                   {"url": "http://x/c", "image": ""}], ["1,000", "2,000"])
    assert listed(spark, "czone.com.pk", html) == [
        ("A", 1000, "https://www.czone.com.pk/a", "i"), ("B", 2000, "https://www.czone.com.pk/b", None),
        ("", None, "http://x/c", None)]
    gpu = extract_gpu_listing(pages(spark, "czone.com.pk", html)).collect()
    assert [r["thumbnail_url"] for r in gpu] == [None] * 3


def test_first_collection_wins_even_if_empty(spark):
    assert listed(spark, "czone.com.pk", jsonld([], []) + jsonld([{"name": "A"}], [])) == []


def woodmart(source, name="N", tail="", cls="", price="<bdi><span class='x'>Rs</span>1,500</bdi>"):
    return (f'<div class="wd-product-wrapper {cls}"><a class="wd-product-img-link" '
            f'href="https://{source}/product/{name}/" aria-label="{name}"></a>'
            f'<span class="woocommerce-Price-amount amount">{price}</span>{tail}</div>')


def test_woodmart_a(spark):
    s = "zahcomputers.pk"
    sale = "<bdi><span class='x'>Rs</span>900</bdi></span><ins><span class=\"woocommerce-Price-amount\">" \
           "<bdi><span class='x'>Rs</span>800</bdi>"
    html = "".join(["<p>head</p>", woodmart(s, "A"), woodmart(s, "B", "<i class='outofstock'></i>"),
                    woodmart(s, "C &amp; D", price=sale), woodmart(s, "E", price=""),
                    '<div class="wd-product-wrapper">no name</div>'])
    assert listed(spark, s, html) == [
        ("A", 1500, f"https://{s}/product/A/", None), ("C &amp; D", 800, f"https://{s}/product/C &amp; D/", None),
        ("E", None, f"https://{s}/product/E/", None)]


def test_woodmart_b(spark):
    s = "techarc.pk"
    html = ('<div class="wd-product-wrapper"><a class="wd-product-img-link" aria-label="A &amp; B" '
            'href="https://techarc.pk/a/?x=1"><img alt="" src="i.jpg"></a>'
            '<a href="https://techarc.pk/cat/"></a></div>'
            '<div class="wd-product-wrapper"><a class="wd-product-img-link" href="https://techarc.pk/c" '
            'aria-label="C"> <img alt="" src="woocommerce-placeholder.png"></a></div>')
    assert listed(spark, s, html) == [("A & B", None, "https://techarc.pk/cat/", "i.jpg"),
                                      ("C", None, "https://techarc.pk/c", None)]


def test_woodmart_c(spark):
    s = "redtech.pk"
    money = '<bdi><span class="woocommerce-Price-currencySymbol">Rs</span>&nbsp; 7,500</bdi>'
    html = (f'<div class="wd-product-wrapper"><h3 class="wd-entities-title"><a href="https://redtech.pk/'
            f'product/a?x">A</a></h3><i class="outofstock"></i>{money}</div>'
            f'<div class="wd-product-wrapper outofstock"><a class="wd-product-img-link" aria-label="B"></a></div>'
            f'<div class="wd-product-wrapper"><a class="wd-product-img-link" aria-label="C"></a>'
            f'<p class="wd-product-stock out-of-stock"></p></div>'
            f'<div class="wd-product-wrapper"><a class="wd-product-img-link" href="https://redtech.pk/d" '
            f'aria-label="D"><img src="lazy.svg" data-src="d.jpg"></a></div>'
            f'<div class="wd-product-wrapper"><a class="wd-product-img-link" aria-label="E">'
            f'<img alt="" src="lazy.svg"></a></div>')
    assert listed(spark, s, html) == [("A", 7500, "", None), ("D", None, "https://redtech.pk/d", "d.jpg"),
                                      ("E", None, "", None)]


def flatsome(name, link, image):
    return (f'<div class="product-small box">{image}<p class="woocommerce-loop-product__title"><a {link}>'
            f'{name}</a></p><span class="woocommerce-Price-amount amount"><bdi><span>Rs</span>100</bdi>'
            f'</span><span class="woocommerce-Price-amount"><bdi><span>Rs</span>90</bdi></span></div>')


def test_flatsome_a(spark):
    s = "amdhouse.pk"
    html = ('<p>head</p><div class="product-small x">no title</div>'
            + flatsome("A &amp; B outofstock", 'class="woocommerce-LoopProduct-link" href="https://q/a"',
                       '<img alt="" src="https://amdhouse.pk/wp-content/uploads/a.jpg">')
            + flatsome("C", 'href="https://amdhouse.pk/product/c"', ""))
    assert listed(spark, s, html) == [
        ("A &amp; B outofstock", 100, "https://q/a", "https://amdhouse.pk/wp-content/uploads/a.jpg"),
        ("C", 100, "https://amdhouse.pk/product/c", None)]


def test_flatsome_b(spark):
    s = "rbtechngames.com"
    html = (flatsome("A &#8211; B&#039;s &eacute;",
                     'href="https://rbtechngames.com/x" class="woocommerce-LoopProduct-link"',
                     '<img class="wp-post-image" alt="" src="https://other/a.jpg">')
            + flatsome("C", 'href="https://rbtechngames.com/shop/c"',
                       '<img alt="" src="https://rbtechngames.com/wp-content/uploads/c.jpg">')
            + flatsome("D", 'href="https://rbtechngames.com/d"', ""))
    assert listed(spark, s, html) == [
        ("A – B's &eacute;", 100, "https://rbtechngames.com/x", "https://other/a.jpg"),
        ("C", 100, "https://rbtechngames.com/shop/c", "https://rbtechngames.com/wp-content/uploads/c.jpg"),
        ("D", 100, "https://rbtechngames.com/d", None)]


def shopify(name, price, image="", extra="", link='href="/products/{n}?v=1" href="/products/{n}"'):
    return (f'<div class="product-item product-item--vertical">{image}<a {link.format(n=name)} '
            f'class="product-item__title">{name}</a><div><span class="price">{price}</span></div>{extra}</div>')


def test_shopify(spark):
    primary = 'class="product-item__primary-image"'
    html = "".join([
        shopify("A", '<span class="visually-hidden">Sale 3</span>Rs.234,990.00',
                f'<img alt="" src="//cdn/a.jpg?width=100" {primary}>'),
        shopify("B", "&#8360;1,20,000 ", f'<img {primary} alt="" src="https://cdn/b.jpg?v=2&width=5&x=1">'),
        shopify("C", "call", f'<img alt="" src="//cdn/No-Image.png" {primary}>'),
        shopify("D", "Rs.5", extra='<i class="sold-out">'), shopify("E", "Rs.5", link='href="/pages/e"')])
    base = "https://www.pakbyte.pk/products/"
    assert listed(spark, "pakbyte.pk", html) == [
        ("A", 234990, base + "A", "https://cdn/a.jpg"),
        ("B", 120000, base + "B", "https://cdn/b.jpg?v=2&x=1"), ("C", None, base + "C", None)]


def woostify(name, body="", cls=""):
    return (f'<li class="product type-product {cls}"><h2 class="woocommerce-loop-product__title"><a>{name}'
            f'</a></h2>{body}</li>')


def test_woostify(spark):
    layer = '<script>wpmDataLayer).products[1] = {"id": 2, "price": 4500}</script>'
    markup = ('<span class="woocommerce-Price-amount amount"><span class="woocommerce-Price-currencySymbol">'
              'Rs</span>9,000</span>')
    image = '<img alt="" src="https://techmatched.pk/wp-content/uploads/a-300x300.jpg">'
    html = (woostify("BUY A | TECHMATCHED", layer + markup + image) + woostify("B", cls="outofstock")
            + woostify("C", '<p class="stock out-of-stock">') + woostify("Buyer D | x", markup)
            + woostify("E") + '</ul><script>{"price": 1}</script>')
    assert listed(spark, "techmatched.pk", html) == [
        ("A", 4500, "", "https://techmatched.pk/wp-content/uploads/a.jpg"),
        ("Buyer D | x", 9000, "", None), ("E", None, "", None)]


def test_json_prices(spark):
    prices = [{"price": 100.9}, {"price": "0"}, {"price": 0, "salePrice": None, "regularPrice": " 7.5 "},
              {"price": "x", "salePrice": 5}, 42, 42.9, "42", None, {}]
    items = [{"productName": f" P{i} ", "productURL": f"p{i}", "productPrice": p}
             for i, p in enumerate(prices)]
    items += [{"productName": " "}, {"productName": "Q", "productURL": "http://q",
                                     "imageFile": "q.jpg", "thumbnailFile": ""}]
    html = json.dumps({"data": {"totalRecords": 11, "results": items}})
    rows = listed(spark, "junaidtech.pk", html)
    assert [r[1] for r in rows] == [100, 0, 7, None, 42, 42, None, None, None, None]
    assert rows[0] == ("P0", 100, "https://www.junaidtech.pk/p0", None)
    assert rows[-1] == ("Q", None, "http://q", "https://static.webx.pk/files/q.jpg")


def test_unknown_shop_and_foreign_seed(spark):
    with pytest.raises(ValueError, match="no listing profile"):
        extract_listing(pages(spark, "techarc.pk", ""), "nowhere.pk")
    stray = pages(spark, "techarc.pk", woodmart("techarc.pk")).withColumn("seed_url", F.lit("https://x"))
    assert extract_listing(stray, "techarc.pk").count() == 0
    known = pages(spark, "techarc.pk", woodmart("techarc.pk"))
    report = crawl.unmatched_pages(stray.unionByName(known)).collect()
    assert [(r["pages"], r["unmatched"]) for r in report] == [(2, 1)]
    respelt = known.withColumn("seed_url", F.concat(F.rtrim(F.upper("seed_url"), F.lit("/")), F.lit("//")))
    assert extract_listing(respelt, "techarc.pk").count() == extract_listing(known, "techarc.pk").count() > 0


# -- crawls ----------------------------------------------------------------------------------------------

def test_first_seen_keeps_repeats_within_the_first_page(spark):
    s = "zahcomputers.pk"
    def bare(name, url):
        return (f'<div class="wd-product-wrapper"><a class="wd-product-img-link" href="{url}" '
                f'aria-label="{name}"></a></div>')
    a, b = f"https://{s}/product/a", f"https://{s}/product/b"
    rows = extract_listing(pages(spark, s, bare("A", a) + bare("A2", a) + bare("N1", "x"),
                                 bare("A3", a) + bare("B", b) + bare("N2", "y")), s)
    kept = crawl.first_seen(rows, ["source", "category", "url"], F.col("seq.page"))
    assert sorted(r["name"] for r in kept.collect()) == ["A", "A2", "B", "N1"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert ", Partial" in plan and ", Final" in plan  # limited before and after the shuffle


def test_totals_and_completeness(spark):
    s = "zahcomputers.pk"
    crawled = pages(spark, s, "1 of 1,002 Results", "of 9 results")
    totals = crawl.reported_totals(crawl.stamp_category(crawled))
    assert [tuple(r) for r in totals.collect()] == [(s, "gpu", 1002)]
    rows = extract_listing(pages(spark, s, woodmart(s)), s)
    assert [tuple(r) for r in crawl.crawl_completeness(rows, totals).collect()] == [
        (s, "gpu", 1, 1002, False)]


@pytest.mark.parametrize("source, html, total", [
    ("czone.com.pk", "<p>32 Products</p>", 32), ("techarc.pk", "of 64 results", 64),
    ("redtech.pk", "of 1,064 results", 1064), ("techmatched.pk", "none", None),
    ("pakbyte.pk", '<p class="collection__products-count-total"> 277 products', 277),
    ("pakbyte.pk", "1 of 30 products", 30), ("junaidtech.pk", '{"data": {"totalRecords": 5}}', 5),
    ("junaidtech.pk", "{}", 0), ("amdhouse.pk", "of 64 results", None)])
def test_total_of(spark, source, html, total):
    totals = crawl.reported_totals(crawl.stamp_category(pages(spark, source, html)))
    assert totals.first()["reported"] == total


# -- detail pages ----------------------------------------------------------------------------------------

def details(spark, source, *htmls):
    rows = [(source, None, n, f"u{n}", h, AT) for n, h in enumerate(htmls)]
    found = extract_details(spark.createDataFrame(rows, schemas.PAGES), source).orderBy("seq").collect()
    return [(r["name"], r["price_pkr"], r["thumbnail_url"],
             r["components"] and {k: v for k, v in r["components"].asDict().items() if v is not None})
            for r in found]


def test_detail_a(spark):
    spec = ("<h2>Full Spec</h2><p><strong><i>CPU:</i></strong> i5 <br><strong>Processor</strong>second<br>"
            "<strong>Fans</strong>3</p><strong>RAM</strong></div>")
    icons = '<li><img src="x/icon-cpu-8.png"/> i7 </li><li><img src="icon-GPU.png">RTX x</li>'
    assert details(
        spark, "zestrogaming.com",
        f'<h1>no</h1><h1 class="product_title">A &amp; <b>B</b></h1>"price": "1500.75"{spec}',
        f'<h1> C </h1>"price":"1.2.3" <span class="woocommerce-Price-amount amount"><bdi><span c>Rs</span>'
        f'2,500</bdi></span>{icons}<meta property="og:image" content="c.jpg">',
        '<h1></h1><meta property="og:image" content="woocommerce-placeholder.png">', "<p>no title</p>",
    ) == [("A & B", 1500, None, {"cpu": "i5", "case_fans": "3"}), ("C", 2500, "c.jpg", {"cpu": "i7"}),
          ("", None, None, None)]


def test_a_section_ends_where_other_products_begin(spark):
    spec = "<h2>Full Specifications</h2><p><strong>CPU</strong>i5<br><strong>RAM</strong>" + "8GB " * 3000 + "</p>"
    other = "<p><strong>GPU</strong>RTX 4090</p>"
    late = "<p>" + "x" * 20_000 + "</p><p><strong>PSU</strong>650W</p>"
    long = ("8GB " * 3000).strip()
    assert [d[3] for d in details(
        spark, "zestrogaming.com", f"<h1>A</h1>{spec}<h2 class='r'>Related</h2>{other}",
        f"<h1>B</h1><section>{spec}</section>{other}", f"<h1>C</h1>{spec}{late}<hr>{other}",
    )] == [{"cpu": "i5", "ram": long}, {"cpu": "i5", "ram": long},
           {"cpu": "i5", "ram": long, "psu": "650W", "gpu": "RTX 4090"}]


def test_icons_are_looked_for_item_by_item(spark):
    plain = "<li>no icon</li>" * 20_000
    icons = ('<li class="a"><b>x</b><img class="i" src="/icon-cpu-80.png" alt=""/> i7 <b>K</b></li>'
             '<LI><img src="/icon-ram.png">16GB</LI><li><img src="/logo.png">none</li>')
    assert details(spark, "zestrogaming.com", f'<link rel="x"><h1>A</h1><ul>{plain}{icons}{plain}</ul>') == [
        ("A", None, None, {"cpu": "i7 K", "ram": "16GB"})]


def test_detail_b(spark):
    table = ("<tr><td> CPU: </td><td> i5 </td><td>New</td></tr><tr><td>Processor</td><td>i7</td></tr>"
             "<tr><td>NVMe</td><td>—</td></tr><tr><td>SSD</td><td>1TB</td></tr>"
             "<tr><td>Fans</td><td>three</td></tr>")
    assert details(
        spark, "redtech.pk", f"<h1>A</h1>{table}<strong>RAM:</strong> 8GB",
        "<h1>B</h1><strong>RAM:</strong>: 16GB<br><strong>Monitor</strong> none",
        f"<h1>Gaming MOUSE</h1>{table}", "<h1>No components</h1>",
    ) == [("A", None, None, {"cpu": "i5", "storage": "1TB"}), ("B", None, None, {"ram": "16GB"})]


def test_detail_c(spark):
    table = ("<tr><td>Processor</td><td>-&gt;&nbsp;Ryzen 5 – New</td></tr><tr><td>CPU -> i7 - used</td></tr>"
             "<tr><td>VGA -> RTX 4060 Refurbished</td></tr><tr><td>Windows -> —</td></tr>"
             "<tr><td>M.2: -> 1TB</td></tr>")
    assert details(
        spark, "techmatched.pk", f"<h1>A</h1>{table}", "<h1>B</h1><b>Windows</b> 11 Pro",
        f"<h1>RGB Fan kit</h1>{table}",
    ) == [("A", None, None, {"cpu": "Ryzen 5", "gpu": "RTX 4060", "storage": "1TB"}),
          ("B", None, None, {"os": "11 Pro"})]


@pytest.mark.parametrize("source", ["zestrogaming.com", "redtech.pk", "techmatched.pk"])
def test_links_of_each_shop(spark, source):
    own, other = f"https://{source}/product/", "https://elsewhere.pk/product/"
    page = f'<a href="{own}b"><a href="{other}x"><a href="{own}a"><a href="{own}q?y"><a href="{own}h#z"><a href="{own}b">'
    rows = product_links(spark.createDataFrame([(source, None, 1, "u", page, AT)], schemas.PAGES), source)
    assert [(r["pos"], r["url"]) for r in rows.orderBy("pos").collect()] == [(0, own + "b"), (1, own + "a")]


def test_product_links(spark):
    def link(n):
        return f'<a href="https://zestrogaming.com/product/{n}">'
    crawled = [("zestrogaming.com", None, 1, "u", link("a") + link("b") + link("a"), AT),
               ("zestrogaming.com", None, 2, "u", link("b") + link("c") + link("d?x"), AT)]
    rows = product_links(spark.createDataFrame(crawled, schemas.PAGES), "zestrogaming.com")
    assert [(r["page"], r["pos"], r["url"][-1]) for r in rows.orderBy("page", "pos").collect()] == [
        (1, 0, "a"), (1, 1, "b"), (2, 1, "c")]


# -- whole runs ------------------------------------------------------------------------------------------

def test_a_failing_shop_does_not_stop_the_others(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    good = pages(spark, "techarc.pk", woodmart("techarc.pk", "RTX", price=(
        '<bdi><span class="x">Rs</span>50,000</bdi>')))
    jobs = {"techarc.pk": lambda: refresh.listing_feed(good, "techarc.pk"),
            "redtech.pk": lambda: refresh.listing_feed(good, "redtech.pk"),
            "pakbyte.pk": lambda: refresh.listing_feed(good.drop("html"), "pakbyte.pk")}
    feed, report = refresh.collect_sources(spark, jobs)
    assert [(r["source"], r["n"], r["warning"], r["error"] is None) for r in report.collect()] == [
        ("techarc.pk", 1, False, True), ("redtech.pk", 0, True, True), ("pakbyte.pk", 0, True, False)]
    assert refresh.load_feed(tables, feed) == 1


def test_an_error_of_the_cluster_ends_the_run(spark, tmp_path):
    """It is no shop's failure: a full disk would otherwise read as a shop without products."""
    good = spark.range(1)
    (tmp_path / "file").write_text("no folder")

    def full():
        raise OSError(28, "No space left on device")

    def unwritable():
        good.write.parquet(f"{tmp_path}/file/below")
    for broken in (full, unwritable):
        with pytest.raises(Exception, match="No space left|Mkdirs failed|not a directory|Parent path"):
            refresh.run_shops(spark, {"a": lambda: 1, "b": broken, "c": lambda: 1})

    def odd():
        session.cut_lineage(good.select(F.raise_error(F.lit("odd page")).cast("string").alias("x")))
    report = refresh.run_shops(spark, {"a": lambda: 1, "b": odd, "c": lambda: 0}, 3)
    assert [(r["source"], r["n"], r["warning"], r["error"] is None) for r in report.collect()] == [
        ("a", 1, False, True), ("b", 0, True, False), ("c", 0, True, True)]


def test_one_row_without_category_loads_nothing(spark):
    """All or nothing: the shops' feeds are one batch, checked before anything is written."""
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    html = jsonld([{"name": "MSI RTX 4060 8GB", "url": "/a"}], ["90,000"])
    feed, _ = refresh.collect_sources(spark, {
        "czone.com.pk": lambda: refresh.listing_feed(pages(spark, "czone.com.pk", html), "czone.com.pk"),
        "techarc.pk": lambda: refresh.listing_feed(pages(spark, "czone.com.pk", html), "czone.com.pk").withColumn(
            "category", F.lit(None).cast("string"))})
    with pytest.raises(Exception, match="without a category"):
        refresh.load_feed(tables, feed)
    assert tables.parts().count() == 0 and tables.price_log().count() == 0


def test_systems_are_committed_shop_by_shop(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    rows = [("zestrogaming.com", None, 1, "https://z/p", '<h1>PC</h1>"price": 5', AT)]
    n, report = refresh.refresh_prebuilts(tables, spark.createDataFrame(rows, schemas.PAGES))
    assert n == 1 and {r["source"]: r["warning"] for r in report.collect()} == {
        "zestrogaming.com": False, "redtech.pk": True, "techmatched.pk": True}
    jobs = {"zestrogaming.com": lambda: refresh.load_prebuilts(tables, refresh.extract_details(
                spark.createDataFrame([(*rows[0][:3], "https://z/q", *rows[0][4:])], schemas.PAGES), "zestrogaming.com")),
            "redtech.pk": lambda: refresh.load_prebuilts(tables, refresh.extract_details(spark.range(1), "redtech.pk"))}
    report = refresh.run_shops(spark, jobs)
    assert {r["source"]: r["error"] is None for r in report.collect()} == {"zestrogaming.com": True, "redtech.pk": False}
    assert tables.prebuilts().count() == 2


def test_refresh_from_pages(spark):
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    html = jsonld([{"name": "MSI RTX 4060 8GB", "url": "/a"}], ["90,000"])
    stray = [("techarc.pk", "https://techarc.pk/unknown", 1, "https://techarc.pk/unknown", html, AT)]
    crawled = (pages(spark, "czone.com.pk", html).unionByName(pages(spark, "techarc.pk", "nothing"))
               .unionByName(spark.createDataFrame(stray, schemas.PAGES)))
    written, report = refresh.refresh_parts(tables, crawled, sources=("czone.com.pk", "techarc.pk"))
    assert written == 1 and tables.parts().first()["specs"]["vram"] == "8GB"
    assert {r["source"]: (r["n"], r["unmatched"]) for r in report.collect()} == {
        "czone.com.pk": (1, 0), "techarc.pk": (0, 1)}
    systems = [("zestrogaming.com", None, 1, "https://z/p", '<h1>PC</h1>"price": 5', AT)]
    n, _ = refresh.refresh_prebuilts(tables, spark.createDataFrame(systems, schemas.PAGES))
    assert n == 1 and tables.prebuilts().first()["name"] == "PC"
