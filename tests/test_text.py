"""Text helpers, against Python's own notion of the same."""

import hashlib
import html
from html.entities import html5
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rigbook.functions import text as X

URLS = st.lists(st.text(alphabet="aZ9-_/.: ?=&ü字٣é%", max_size=30).map(
    lambda t: t if t.startswith(":") else "https://shop.pk/" + t), min_size=1, max_size=30)


def column(spark, values, *expressions):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = rows.select("i", *[e.alias(f"c{n}") for n, e in enumerate(expressions)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(expressions) > 1 else r[1] for r in got]


@settings(max_examples=15, deadline=None)
@given(urls=URLS)
def test_slug(spark, urls):
    def expected(url):
        path = re.sub(r"https?://[^/]+/", "", url).rstrip("/")
        return re.sub("-{2,}", "-", re.sub(r"[^\w-]", "-", path))
    assert column(spark, urls, X.slug(F.col("t"))) == [expected(u) for u in urls]


def test_slug_keeps_the_whole_address(spark):
    urls = ["https://a.b/" + "ü" * 300 + end for end in ("a", "b")]
    assert column(spark, urls, X.slug(F.col("t"))) == ["ü" * 300 + "a", "ü" * 300 + "b"]


def test_numbers_without_suffixes(spark):
    texts = ["5000d", "5000f", "12.9", " 7e2 ", "-3", ".5", "1e", "NaN", ""]
    assert column(spark, texts, X.decimal_to_int(F.col("t"))) == [None, None, 12, 700, -3, 0, None, None, None]


def test_json_must_be_the_whole_text(spark):
    texts = ['{"a": 1}', ' {"a": 2}\n', '{"a": 3} x', '{"a": 4}, {"a": 5}', "", None, '{"a": 6}]', '{"a": 7}]x',
             '{"a": 8}] , [{"a": 9}', '{"a": 1}}', '{"a": 1}}x', '{"a": 1}, "v": {"a": 2}', '{"a": 1', "[]", "null"]
    assert column(spark, texts, X.whole_json(F.col("t"), "struct<a: int>")["a"]) == [1, 2] + [None] * 13
    lists = ["[1, 2]", "[1], [2]", "[1]]", "[1]}", "[1"]
    assert column(spark, lists, X.whole_json(F.col("t"), "array<int>")) == [[1, 2]] + [None] * 4


def test_numbers(spark):
    values = ["1,20,000", "٣,٤", "x", ",", "12.5", "1.2.3", None]
    got = column(spark, values, X.to_int(F.col("t")), X.decimal_to_int(F.col("t")),
                 X.price_digits(F.col("t")))
    assert got == [(120000, None, 120000), (34, None, 34), (None, None, None), (None, None, None),
                   (None, 12, 125), (None, None, 123), (None, None, None)]


def test_strip_and_tags(spark):
    values = ["  a b\n　", "<b>x</b> <i/>y"]
    assert column(spark, values, X.strip(F.col("t")), X.strip_tags(F.col("t"))) == [
        ("a b", "  a b\n　"), ("<b>x</b> <i/>y", "x y")]


def test_find_tells_empty_from_missing(spark):
    values = ["<h1></h1>", "<h1>a</h1>", "none"]
    pattern = "<h1>(.*?)</h1>"
    assert column(spark, values, X.find(F.col("t"), pattern), X.find_or_empty(F.col("t"), pattern)) == [
        (None, ""), ("a", "a"), (None, None)]


def test_unescape(spark):
    values = ["a &amp; b", "&#8211;&eacute;&notanentity;", "plain", None, "&amp;amp;"]
    assert column(spark, values, X.unescape(F.col("t"))) == [v and html.unescape(v) for v in values]


def test_unescape_knows_every_name(spark):
    names = sorted(html5)
    values = [form for name in names for form in (f"&{name}", f"a&{name}b&{name}", f"&{name[:-1]}x;", f"&{name[:3]} ")]
    values += ["&", "&&amp", "&;", "&#;", "&#x;", "&ampamp;", "&notit;", "&" + "a" * 40 + ";", "x&lt\ny", "&Amp;", "\U0001f600&gt;é"]
    found = column(spark, values, X.unescape(F.col("t")))
    assert [(v, f) for v, f in zip(values, found) if f != html.unescape(v)] == []


def test_unescape_knows_every_number(spark):
    near = [n for plane in range(1, 18) for n in range(plane * 0x10000 - 3, plane * 0x10000 + 3)]
    numbers = [*range(0x500), *range(0xD7FE, 0xE002), *range(0xFDCE, 0xFDF2), 0xFEFF, 0xFFFD, *near, 10**7, 10**8, 10**30]
    values = [form for n in numbers for form in (f"&#{n};", f"&#x{n:x};", f"&#X{n:X}.", f"&#000000000{n}")]
    found = column(spark, values, X.unescape(F.col("t")))
    assert [(v, f) for v, f in zip(values, found) if f != html.unescape(v)] == []


def test_unescape_stays_on_the_jvm(spark):
    plan = spark.range(1).select(X.unescape(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "pythonUDF" not in plan


@pytest.mark.parametrize("query, hits", [
    ("RTX", {"Rtx 40_60 100%", "xRTX"}), ("x_40", {"Rtx 40_60 100%"}), ("0%0", {"Rtx 40_60 100%"}),
    ("\\", {"back\\slash"}), ("ÜB", {"ÜBER"}), ("üb", {"über"}), ("(", {"a(b"}), ("100%%", {"Rtx 40_60 100%"}),
])
def test_name_search(spark, query, hits):
    names = ["Rtx 40_60 100%", "xRTX", "back\\slash", "über", "ÜBER", "a(b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0] for r in rows.where(X.name_matches(F.col("n"), query)).collect()} == hits


def test_absolute_url(spark):
    values = [None, "", "http://x/y", "/a", "a"]
    assert column(spark, values, X.absolute_url("https://b", F.col("t"))) == [
        "", "", "http://x/y", "https://b/a", "https://b/a"]


def test_packed_keys(spark):
    known = [hashlib.md5(str(k).encode()).hexdigest() for k in range(20)]
    texts = [*known, None, "", "p1", "größe", known[0].upper(), known[0] + "\n", known[0][:31], "x" * 16, "\0" * 16, "a/b c"]
    packed = column(spark, texts, X.packed_key(F.col("t")))
    assert [len(p) for p in packed[:20]] == [16] * 20 and len({bytes(p) for p in packed if p is not None}) == len(texts) - 1
    assert sorted(range(20), key=lambda k: bytes(packed[k])) == sorted(range(20), key=lambda k: known[k])
    assert column(spark, texts, X.unpacked_key(X.packed_key(F.col("t")))) == texts
