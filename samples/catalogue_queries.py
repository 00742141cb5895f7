"""Queries on the parts catalogue built from the sample feed."""

import datetime

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rigbook import fixed, schemas
from rigbook.functions.specs import with_specs
from rigbook.functions.text import slug
from rigbook.operators.cleaning import clean_feed as clean
from rigbook.operators.cleaning import reject_counts as rejects
from rigbook.operators.loading import (backfill_specs as backfill, fold_parts, fold_prices, merge_latest,
                                       new_prices, upsert_parts as upsert)
from rigbook.operators.quality import quality_report as checks
from rigbook.operators.quality import quality_summary as summary
from rigbook.operators.reports import feed_counts as counts
from rigbook.operators.reports import source_report, spec_coverage as coverage
from rigbook.plans import builds, catalogue, name_index, paging, profiles
from rigbook.plans.refresh import load_feed
from rigbook.session import cut_lineage, scratch_path
from rigbook.sources.files import (add_missing_columns, as_json, from_json_text, read_feed, write_json)
from rigbook.sources.tables import CatalogueTables
from rigbook.streaming.incremental import read_feed_stream, start_loading
from samples.feed import (CATALOGUE_SQL, CLEAN_SQL, FEED_SQL, PART_LISTS_SQL, part_lists, product_feed,
                          sql_pick, table)
from samples.registry import query

FIRST_RUN = datetime.datetime(2002, 1, 1)
SECOND_RUN = datetime.datetime(2002, 2, 1)
BATCH_BORDER = datetime.datetime(1998, 7, 1)

PART_COLUMNS = ["part_id", "source", "source_id", "name", "category", "url", "thumbnail_url"]
SPEC_COLUMNS = [f"specs.{f}" for f in fixed.SPEC_FIELDS]
SPEC_SQL = ", ".join(f'"{f}"' for f in fixed.SPEC_FIELDS)
PART_SQL = ", ".join(PART_COLUMNS)


def clean_rows(spark, sf_dir):
    return clean(product_feed(spark, sf_dir))


def parts_and_latest(spark, sf_dir):
    rows = clean_rows(spark, sf_dir)
    return fold_parts(rows), catalogue.latest_prices(fold_prices(rows))


# -- feed and cleaning -----------------------------------------------------------------------------------

@query(f"WITH {CLEAN_SQL} SELECT name, price_pkr, url, category, source, scraped_at, thumbnail_url "
       "FROM clean")
def clean_feed(spark, sf_dir):
    return clean_rows(spark, sf_dir).drop("seq")


@query(f"WITH {CLEAN_SQL} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL "
       "GROUP BY reason")
def reject_counts(spark, sf_dir):
    return rejects(product_feed(spark, sf_dir))


@query(f"WITH {FEED_SQL} SELECT source, category, count(*) AS n FROM feed GROUP BY source, category")
def feed_counts(spark, sf_dir):
    return counts(product_feed(spark, sf_dir))


@query(f"""WITH {FEED_SQL}
SELECT s.source, count(f.source) AS n, count(f.source) = 0 AS warning
FROM (SELECT unnest({[*fixed.PART_SOURCES]}) AS source) s
LEFT JOIN feed f ON f.source = s.source
GROUP BY s.source""")
def source_run_report(spark, sf_dir):
    return source_report(product_feed(spark, sf_dir))


@query("""
SELECT page_id, regexp_replace(regexp_replace(rtrim(regexp_replace(
         url, 'https?://[^/]+/', '', 'g'), '/'), '[^\\p{L}\\p{N}_-]', '-', 'g'), '-{2,}', '-', 'g') AS source_id
FROM pages""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", slug(F.col("url")).alias("source_id"))


# -- specifications --------------------------------------------------------------------------------------

def _register_spec_query(category: str) -> None:
    fields = fixed.FACET_FIELDS[category]

    def run(spark, sf_dir):
        specs = fold_parts(clean_rows(spark, sf_dir).where(F.col("category") == category))
        return specs.select("source", "source_id", "name", *[f"specs.{f}" for f in fields])

    columns = ", ".join(f'"{f}"' for f in fields)
    query(f"WITH {CATALOGUE_SQL} SELECT source, source_id, name, {columns} FROM parts "
          f"WHERE category = '{category}'", name=f"spec_{category}")(run)


for _category in ("cpu", "gpu", "ram", "motherboard", "psu", "case", "cooling", "ssd"):
    _register_spec_query(_category)


@query(f"WITH {CATALOGUE_SQL} SELECT source, source_id, category, name, brand FROM parts")
def spec_brand(spark, sf_dir):
    parts = fold_parts(clean_rows(spark, sf_dir))
    return parts.select("source", "source_id", "category", "name", "specs.brand")


@query(f"WITH {CATALOGUE_SQL} SELECT {PART_SQL}, {SPEC_SQL} FROM parts")
def backfill_specs(spark, sf_dir):
    """An older table without specifications is brought up to date."""
    old = fold_parts(clean_rows(spark, sf_dir)).drop("specs")
    parts = backfill(add_missing_columns(old, schemas.PARTS))
    return parts.select(*PART_COLUMNS, *SPEC_COLUMNS)


_ANY_SPEC = " OR ".join(f'"{f}" IS NOT NULL' for f in fixed.SPEC_FIELDS)


@query(f"""WITH {CATALOGUE_SQL}
SELECT category, count(*) AS total, count(*) FILTER (WHERE {_ANY_SPEC}) AS with_specs,
       count(brand) AS with_brand, count(*) FILTER (WHERE {_ANY_SPEC}) * 100 / count(*) AS specs_percent,
       count(brand) * 100 / count(*) AS brand_percent
FROM parts GROUP BY category""")
def spec_coverage(spark, sf_dir):
    return coverage(fold_parts(clean_rows(spark, sf_dir)))


# -- loading ---------------------------------------------------------------------------------------------

_TWO_BATCHES_SQL = CLEAN_SQL + """,
batches AS (
  SELECT *, CASE WHEN scraped_at < TIMESTAMP '1998-07-01' THEN 1 ELSE 2 END AS batch FROM clean
),
two_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY batch DESC, l_orderkey DESC,
                               l_linenumber DESC, l_suppkey DESC) AS from_last,
         first_value(url) OVER w AS first_url,
         last_value(thumbnail_url IGNORE NULLS) OVER w AS last_thumbnail,
         min(batch) OVER (PARTITION BY source, source_id) AS first_batch,
         max(batch) OVER (PARTITION BY source, source_id) AS last_batch
  FROM batches
  WINDOW w AS (PARTITION BY source, source_id ORDER BY batch, l_orderkey, l_linenumber, l_suppkey
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)"""


@query(f"""WITH {_TWO_BATCHES_SQL}
SELECT md5(source || '/' || source_id) AS part_id, source, source_id, name, category,
       first_url AS url, last_thumbnail AS thumbnail_url, {SPEC_SQL},
       CASE first_batch WHEN 1 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2002-02-01' END AS created_at,
       CASE last_batch WHEN 1 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2002-02-01' END AS updated_at
FROM two_ranked WHERE from_last = 1""")
def upsert_parts(spark, sf_dir):
    """Two runs: what was scraped before the border, then the rest."""
    rows, empty = clean_rows(spark, sf_dir), spark.createDataFrame([], schemas.PARTS)
    first = upsert(empty, rows.where(F.col("scraped_at") < BATCH_BORDER), F.lit(FIRST_RUN))
    both = upsert(first, rows.where(F.col("scraped_at") >= BATCH_BORDER), F.lit(SECOND_RUN))
    return both.select(*PART_COLUMNS, *SPEC_COLUMNS, "created_at", "updated_at")


@query(f"""WITH {CATALOGUE_SQL}
SELECT part_id, price_pkr, scraped_at FROM price_log WHERE (part_id, scraped_at) NOT IN (
  SELECT (md5(source || '/' || source_id), scraped_at) FROM clean WHERE l_orderkey % 3 = 0)""")
def append_prices(spark, sf_dir):
    """A whole feed is loaded after the part of it that came in every third order."""
    rows = clean_rows(spark, sf_dir)
    log = fold_prices(rows.where(F.col("seq.page") % 3 == 0))
    return new_prices(log, rows).select("part_id", "price_pkr", "scraped_at")


@query(f"""WITH {CATALOGUE_SQL}
SELECT p.part_id, source, source_id, name, category, url, thumbnail_url, price_pkr, scraped_at
FROM parts p JOIN price_log l USING (part_id, source, source_id)""")
def stored_tables(spark, sf_dir):
    """The feed loaded into stored tables, and read back from there."""
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    load_feed(tables, product_feed(spark, sf_dir), F.lit(FIRST_RUN))
    return (tables.parts().select(*PART_COLUMNS)
            .join(tables.price_log().select("part_id", "price_pkr", "scraped_at"), "part_id"))


@query(f"""WITH {CATALOGUE_SQL.replace("FROM feed", "FROM (SELECT * FROM feed WHERE source <> 'redtech.pk')")}
SELECT p.part_id, source, source_id, name, category, url, thumbnail_url, price_pkr, scraped_at, true AS aborted
FROM parts p JOIN price_log l USING (part_id, source, source_id)""")
def aborted_load(spark, sf_dir):
    """The feed of all shops but one is loaded; then all of it, where one of that shop's rows has no category, which
    stops the load. What is stored is that of the first load."""
    tables, feed = CatalogueTables(spark, scratch_path(spark, "tables")), product_feed(spark, sf_dir)
    load_feed(tables, feed.where("source <> 'redtech.pk'"), F.lit(FIRST_RUN))
    last = feed.where("source = 'redtech.pk'").agg(F.max("seq").alias("seq")).first().seq
    is_last = (F.col("source") == "redtech.pk") & (F.col("seq") == F.struct(*map(F.lit, last)).cast(
        feed.schema["seq"].dataType))
    broken = feed.withColumn("category", F.when(~is_last, F.col("category")))
    try:
        load_feed(tables, broken, F.lit(SECOND_RUN))
        aborted = False
    except PySparkException as error:
        aborted = "feed row without a category" in str(error)
    return (tables.parts().select(*PART_COLUMNS)
            .join(tables.price_log().select("part_id", "price_pkr", "scraped_at"), "part_id")
            .withColumn("aborted", F.lit(aborted)))


@query(f"""WITH {CATALOGUE_SQL}
SELECT source, source_id, name, thumbnail_url, price_pkr, scraped_at
FROM parts p JOIN price_log l USING (part_id, source, source_id)""")
def incremental_load(spark, sf_dir):
    """The feed arrives as JSON files and is loaded by a stream; the files come in feed order, as the
    order of files is the order of runs."""
    arrived = scratch_path(spark, "arrived") + ".gz"
    write_json(product_feed(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq"), arrived)
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    stream = read_feed_stream(spark, arrived)
    start_loading(stream, tables, scratch_path(spark, "progress"), F.lit(FIRST_RUN)).awaitTermination()
    return (tables.parts().select("part_id", "source", "source_id", "name", "thumbnail_url")
            .join(tables.price_log().select("part_id", "price_pkr", "scraped_at"), "part_id")
            .drop("part_id"))


_WHOLE_SPECS = ", ".join(f'CASE WHEN price_pkr % 5 = 0 THEN NULL ELSE "{f}" END AS "{f}"' for f in fixed.SPEC_FIELDS)


@query(f"WITH {FEED_SQL} SELECT name, price_pkr, url, category, source, scraped_at, thumbnail_url, "
       f"{_WHOLE_SPECS} FROM feed")
def export_roundtrip(spark, sf_dir):
    """The feed written as JSON and read back, with its specifications turned to JSON text and back. Where the price
    is divisible by 5, something stands behind the text, which then is no JSON."""
    path = scratch_path(spark, "export") + ".gz"
    write_json(product_feed(spark, sf_dir), path)
    feed = with_specs(read_feed(spark, path))
    text = as_json(F.col("specs"))
    text = F.when(F.col("price_pkr") % 5 == 0, F.concat(text, F.lit("]x"))).otherwise(text)
    specs = from_json_text(text, schemas.SPECS).alias("specs")
    return feed.select("name", "price_pkr", "url", "category", "source", "scraped_at", "thumbnail_url",
                       specs).select("*", *SPEC_COLUMNS).drop("specs")


# -- listings --------------------------------------------------------------------------------------------

@query(f"WITH {CATALOGUE_SQL} SELECT part_id, price_pkr, scraped_at FROM latest")
def latest_prices(spark, sf_dir):
    return catalogue.latest_prices(fold_prices(clean_rows(spark, sf_dir)))


@query(f"WITH {CATALOGUE_SQL} SELECT part_id, price_pkr, scraped_at FROM latest")
def latest_prices_kept(spark, sf_dir):
    """The latest prices as kept up to date by each load."""
    log = fold_prices(clean_rows(spark, sf_dir))
    before, after = (log.where(F.col("scraped_at") < BATCH_BORDER),
                     log.where(F.col("scraped_at") >= BATCH_BORDER))
    return merge_latest(merge_latest(spark.createDataFrame([], schemas.LATEST_PRICES), before), after)


_LISTED = f"{PART_SQL}, {SPEC_SQL}, price_pkr"
_LISTING_SQL = f"SELECT {_LISTED} FROM parts JOIN latest USING (part_id)"


def _flat(listing):
    return listing.select(*PART_COLUMNS, *SPEC_COLUMNS, "price_pkr")


@query(f"""WITH {CATALOGUE_SQL} {_LISTING_SQL}
WHERE category = 'gpu' AND source = 'redtech.pk' AND price_pkr BETWEEN 20000 AND 90000
ORDER BY price_pkr DESC, source, source_id LIMIT 25 OFFSET 5""")
def list_parts_page(spark, sf_dir):
    return _flat(catalogue.list_parts(
        *parts_and_latest(spark, sf_dir), category="gpu", source="redtech.pk", min_price=20000,
        max_price=90000, sort="price_desc", limit=25, offset=5))


@query(f"""WITH {CATALOGUE_SQL} SELECT count(*) AS total FROM parts JOIN latest USING (part_id)
WHERE category = 'gpu' AND price_pkr BETWEEN 20000 AND 90000""")
def list_parts_total(spark, sf_dir):
    """An unknown shop is no filter."""
    return catalogue.count_parts(*parts_and_latest(spark, sf_dir), category="gpu", source="nowhere.pk",
                                 min_price=20000, max_price=90000)


@query(f"""WITH {CATALOGUE_SQL} {_LISTING_SQL} WHERE name ILIKE '%am_ %cold%'""")
def parts_name_search(spark, sf_dir):
    return _flat(catalogue.matching_parts(*parts_and_latest(spark, sf_dir), q="aM_ %CoLd"))


@query(f"""WITH {CATALOGUE_SQL} {_LISTING_SQL} WHERE brand = 'ASUS' AND socket = 'LGA1700'""")
def parts_by_specs(spark, sf_dir):
    """Unknown specification names are ignored."""
    return _flat(catalogue.matching_parts(*parts_and_latest(spark, sf_dir),
                                          specs={"brand": "ASUS", "socket": "LGA1700", "colour": "red"}))


@query(f"""WITH {CATALOGUE_SQL} {_LISTING_SQL} WHERE price_pkr % 3 <> 0""")
def parts_without_latest_price(spark, sf_dir):
    """Every price that 3 divides is missing in the log: a part whose newest row is such a one is not listed, whatever
    its older rows say."""
    rows = clean_rows(spark, sf_dir)
    log = fold_prices(rows).withColumn("price_pkr", F.when(F.col("price_pkr") % 3 != 0, F.col("price_pkr")))
    return _flat(catalogue.matching_parts(fold_parts(rows), catalogue.latest_prices(log)))


_FACETS_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT category, '{f}' AS field, \"{f}\" AS value FROM parts WHERE \"{f}\" <> '' "
    f"AND category = '{c}'" for c, fields in fixed.FACET_FIELDS.items() for f in fields)


@query(f"WITH {CATALOGUE_SQL} {_FACETS_SQL}")
def facet_values(spark, sf_dir):
    return catalogue.facet_values(fold_parts(clean_rows(spark, sf_dir)))


@query(f"""WITH {CATALOGUE_SQL} SELECT price_pkr, scraped_at FROM price_log
WHERE source = 'czone.com.pk' AND source_id = (
  SELECT min(source_id) FROM parts WHERE source = 'czone.com.pk' AND category = 'monitor')""")
def price_history(spark, sf_dir):
    """History of the shop's first monitor by key."""
    rows = clean_rows(spark, sf_dir)
    parts, log = fold_parts(rows), fold_prices(rows)
    key = parts.where("source = 'czone.com.pk' and category = 'monitor'").agg(F.min("source_id")).first()[0]
    return catalogue.price_history(parts, log, "czone.com.pk", key)


@query(f"""WITH {CATALOGUE_SQL}
SELECT 'total_parts' AS metric, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM parts
UNION ALL SELECT 'total_price_rows', NULL, count(*) FROM price_log
UNION ALL SELECT 'by_source', source, count(*) FROM parts GROUP BY source
UNION ALL SELECT 'by_category', category, count(*) FROM parts GROUP BY category""")
def catalog_stats(spark, sf_dir):
    rows = clean_rows(spark, sf_dir)
    return catalogue.catalogue_stats(fold_parts(rows), fold_prices(rows))


# -- listings from the stored tables ---------------------------------------------------------------------

def stored_catalogue(spark, sf_dir):
    """The feed loaded into stored tables in two runs, by time."""
    tables = CatalogueTables(spark, scratch_path(spark, "tables"))
    feed = product_feed(spark, sf_dir)
    for when, batch in ((FIRST_RUN, feed.where(F.col("scraped_at") < BATCH_BORDER)),
                        (SECOND_RUN, feed.where(F.col("scraped_at") >= BATCH_BORDER))):
        load_feed(tables, batch, F.lit(when))
    return tables


#: Parts after the two runs: names by run and then by feed order, unlike those of one run over the whole feed.
_STORED_SQL = f"""{_TWO_BATCHES_SQL},
two_log AS (
  SELECT source, source_id, price_pkr, scraped_at FROM (SELECT *, row_number() OVER (
    PARTITION BY source, source_id, scraped_at ORDER BY batch, l_orderkey, l_linenumber, l_suppkey) AS n FROM batches)
  WHERE n = 1),
two_latest AS (
  SELECT source, source_id, max_by(price_pkr, scraped_at) AS price_pkr FROM two_log GROUP BY source, source_id),
listing AS (
  SELECT md5(source || '/' || source_id) AS part_id, source, source_id, name, category, first_url AS url,
         last_thumbnail AS thumbnail_url, {SPEC_SQL}, l.price_pkr
  FROM (SELECT * EXCLUDE (price_pkr) FROM two_ranked WHERE from_last = 1) JOIN two_latest l USING (source, source_id))"""


@query(f"""WITH {_STORED_SQL} SELECT {_LISTED} FROM listing
WHERE category = 'ram' AND price_pkr >= 15000 ORDER BY price_pkr, source, source_id LIMIT 100 OFFSET 40""")
def stored_listing_page(spark, sf_dir):
    return _flat(catalogue.list_parts(stored_catalogue(spark, sf_dir).listing(), category="ram", min_price=15000,
                                      limit=100, offset=40))


@query(f"""WITH {_STORED_SQL} SELECT count(*) AS total FROM listing
WHERE category = 'gpu' AND brand = 'ASUS' AND price_pkr <= 60000""")
def stored_listing_total(spark, sf_dir):
    return catalogue.count_parts(stored_catalogue(spark, sf_dir).listing(), category="gpu", max_price=60000,
                                 specs={"brand": "ASUS"})


@query(f"""WITH {_STORED_SQL}, n AS (SELECT count(*) AS n FROM listing)
SELECT {_LISTED} FROM (SELECT *, row_number() OVER (ORDER BY price_pkr DESC, source, source_id) AS place FROM listing), n
WHERE place > n - 60 AND place <= n - 10""")
def stored_listing_deep(spark, sf_dir):
    """Fifty parts shortly before the listing's end, found by counting."""
    listing = stored_catalogue(spark, sf_dir).listing()
    total = catalogue.count_parts(listing).first()["total"]
    return _flat(paging.deep_page(catalogue.matching_parts(listing), "price_desc", 50, total - 60, few=200))


@query("WITH " + _STORED_SQL + " " + _FACETS_SQL.replace("FROM parts", "FROM listing"))
def stored_facets(spark, sf_dir):
    """From the counts that each load stores with its buckets."""
    return catalogue.facet_values(stored_catalogue(spark, sf_dir).part_counts())


@query(f"""WITH {_STORED_SQL}
SELECT 'total_parts' AS metric, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM listing
UNION ALL SELECT 'total_price_rows', NULL, count(*) FROM two_log
UNION ALL SELECT 'by_source', source, count(*) FROM listing GROUP BY source
UNION ALL SELECT 'by_category', category, count(*) FROM listing GROUP BY category""")
def stored_stats(spark, sf_dir):
    tables = stored_catalogue(spark, sf_dir)
    return catalogue.catalogue_stats(tables.part_counts(), tables.price_log())


@query(f"""WITH {_STORED_SQL} SELECT {_LISTED} FROM listing WHERE name ILIKE '%am_ %cold%'""")
def indexed_name_search(spark, sf_dir):
    """The search of ``parts_name_search``, over the stored listing and its index of trigrams."""
    listing, path = stored_catalogue(spark, sf_dir).listing(), scratch_path(spark, "names")
    name_index.write_index(listing, path)
    return _flat(catalogue.matching_parts(name_index.search(listing, path, "aM_ %CoLd")))


@query(f"""WITH {_TWO_BATCHES_SQL},
two_log AS (
  SELECT source, source_id, price_pkr, scraped_at FROM (SELECT *, row_number() OVER (
    PARTITION BY source, source_id, scraped_at ORDER BY batch, l_orderkey, l_linenumber, l_suppkey) AS n FROM batches)
  WHERE n = 1)
SELECT price_pkr, scraped_at FROM two_log WHERE source = 'czone.com.pk' AND source_id = (
  SELECT min(source_id) FROM clean WHERE source = 'czone.com.pk' AND category = 'monitor')""")
def stored_price_history(spark, sf_dir):
    """History of the shop's first monitor, from the stored log."""
    tables = stored_catalogue(spark, sf_dir)
    key = tables.parts().where("source = 'czone.com.pk' and category = 'monitor'").agg(F.min("source_id")).first()[0]
    return catalogue.price_history(tables.parts(), tables.price_log(), "czone.com.pk", key)


# -- saved part lists ------------------------------------------------------------------------------------

_DIGIT = "(instr('0123456789abcdef', substr(digest, {}, 1)) - 1)"
_LETTERS = " || ".join(
    "substr('" + fixed.CODE_ALPHABET + "', ("
    + " + ".join(f"{_DIGIT.format(8 * i + d + 1)} * {16 ** (7 - d)}" for d in range(8))
    + ") % 62 + 1, 1)" for i in range(fixed.CODE_LENGTH))


@query(f"""WITH {PART_LISTS_SQL},
hashed AS (SELECT build_id, count(*) AS slots, sha256('sample/' || build_id || '/0') AS digest
           FROM build_lines GROUP BY build_id)
SELECT build_id, slots, {_LETTERS} AS code FROM hashed""")
def save_builds(spark, sf_dir):
    """Share codes for all part lists. The salt is fixed here, so that SQL can say which codes come out."""
    shared = spark.createDataFrame([], schemas.SHARED_BUILDS)
    saved = builds.save_builds(part_lists(spark, sf_dir), shared, F.lit(FIRST_RUN), salt="sample")
    return saved.select("build_id", F.size("slots").cast("bigint").alias("slots"), "code")


@query(f"""WITH {PART_LISTS_SQL},
hashed AS (SELECT build_id, count(*) AS slots,
                  sha256('sample/' || build_id || CASE WHEN build_id % 4 = 0 THEN '/1' ELSE '/0' END) AS digest
           FROM build_lines GROUP BY build_id)
SELECT build_id, slots, {_LETTERS} AS code FROM hashed""")
def save_builds_again(spark, sf_dir):
    """Every fourth list is saved already. When all are saved with the same salt, the codes those would get first
    are taken, and they get the ones of the second attempt."""
    lists = part_lists(spark, sf_dir)
    none = spark.createDataFrame([], schemas.SHARED_BUILDS)
    shared = builds.save_builds(lists.where("build_id % 4 = 0"), none, F.lit(FIRST_RUN), salt="sample")
    saved = builds.save_builds(lists, shared, F.lit(SECOND_RUN), salt="sample")
    return saved.select("build_id", F.size("slots").cast("bigint").alias("slots"), "code")


_HALF = 62 ** 3
_RANGE_CODES_SQL = f"""steps AS (
  SELECT o_orderkey, 0 AS step, o_orderkey // {_HALF} AS a, o_orderkey % {_HALF} AS b FROM orders
  UNION ALL
  SELECT o_orderkey, step + 1, b,
         (a + CAST('0x' || substr(sha256('sample/' || step || '/' || b), 1, 15) AS BIGINT) % {_HALF}) % {_HALF}
  FROM steps WHERE step < 8)"""
_HALF_LETTERS = " || ".join("substr('" + fixed.CODE_ALPHABET + f"', CAST({{0}} // {62 ** k} % 62 + 1 AS INT), 1)"
                            for k in (2, 1, 0))


@query(f"""WITH RECURSIVE {_RANGE_CODES_SQL}
SELECT o_orderkey, {_HALF_LETTERS.format("a")} || {_HALF_LETTERS.format("b")} AS code, o_orderkey AS number
FROM steps WHERE step = 8""")
def range_codes(spark, sf_dir):
    """The share code that each order's key has as a number, and the number read back from the code."""
    coded = table(spark, sf_dir, "orders").select("o_orderkey", builds.code_of(F.col("o_orderkey"), "sample").alias("code"))
    return coded.withColumn("number", builds.number_of(F.col("code"), "sample"))


@query(f"""WITH {PART_LISTS_SQL},
saved AS (SELECT build_id, count(*) AS slots FROM build_lines GROUP BY build_id)
SELECT build_id, slots, 1000 AS least, 999 + (SELECT count(*) FROM saved) AS largest,
       (SELECT count(*) FROM saved) AS numbers FROM saved""")
def save_builds_in_range(spark, sf_dir):
    """All part lists saved under a range of numbers: which ones were handed out, beside each list."""
    saved, _ = builds.save_builds_in_range(part_lists(spark, sf_dir), 1000, F.lit(FIRST_RUN), "sample")
    numbers = saved.select(builds.number_of(F.col("code"), "sample").alias("number")).agg(
        F.min("number").alias("least"), F.max("number").alias("largest"), F.count_distinct("number").alias("numbers"))
    return saved.select("build_id", F.size("slots").cast("bigint").alias("slots")).join(F.broadcast(numbers))


@query(f"""WITH {CATALOGUE_SQL}, {PART_LISTS_SQL},
last_slots AS (SELECT build_id, part_id, max(slot_no) AS slot_no FROM build_lines GROUP BY ALL)
SELECT CAST(build_id AS VARCHAR) AS code, {sql_pick(fixed.BUILD_SLOTS, "slot_no")} AS slot, part_id,
       name, category, price_pkr
FROM last_slots JOIN parts USING (part_id) JOIN latest USING (part_id)""")
def resolve_builds(spark, sf_dir):
    """All part lists looked up; their order numbers stand in for the codes."""
    shared = part_lists(spark, sf_dir).select(F.col("build_id").cast("string").alias("code"), "slots")
    rows = cut_lineage(clean_rows(spark, sf_dir))      # read twice
    parts, latest = fold_parts(rows), catalogue.latest_prices(fold_prices(rows))
    found = builds.resolve_builds(shared, parts, latest)
    return found.select("code", "slot", "part_id", "name", "category", "price_pkr")


@query("""SELECT o_orderkey, code, regexp_full_match(code, '[\\p{L}\\p{N}]{6}') AS valid
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ab-' WHEN 1 THEN 'äb' ELSE 'abc' END || o_orderkey
      AS code FROM orders)""")
def valid_codes(spark, sf_dir):
    """Codes of various lengths and letters, one per order, put to the format check."""
    key = F.col("o_orderkey")
    code = F.concat(F.when(key % 3 == 0, "ab-").when(key % 3 == 1, "äb").otherwise("abc"), key)
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"),
                                                 builds.is_valid_code(code).alias("valid"))


# -- checks ----------------------------------------------------------------------------------------------

CHECK_TIME = datetime.datetime(2001, 11, 4, 6)

_WITHOUT_SOME_SQL = "SELECT * FROM parts WHERE NOT (source = 'pakbyte.pk' AND category = 'monitor')"
_CHECKS_SQL = CATALOGUE_SQL + f""",
kept AS ({_WITHOUT_SOME_SQL}),
shops AS (SELECT unnest({[*fixed.PART_SOURCES]}) AS source),
shop_parts AS (
  SELECT s.source, count(p.source) AS n, count(p.thumbnail_url) AS with_thumbnail,
         CASE WHEN s.source IN ('amdhouse.pk', 'rbtechngames.com') THEN 10 ELSE 70 END AS percent
  FROM shops s LEFT JOIN kept p ON p.source = s.source GROUP BY s.source),
fresh AS (
  SELECT s.source, count(l.part_id) AS n
  FROM shops s LEFT JOIN (
    SELECT k.source, l.part_id FROM price_log l JOIN kept k ON k.part_id = l.part_id
    WHERE l.scraped_at >= TIMESTAMP '2001-11-03 06:00:00') l ON l.source = s.source
  GROUP BY s.source),
report AS (
  SELECT 'all_sources_present' AS check_name, 'all' AS subject, count(*) FILTER (WHERE n > 0) = count(*) AS ok,
         count(*) FILTER (WHERE n > 0) AS observed, count(*) AS total FROM shop_parts
  UNION ALL SELECT 'source_has_parts', source, n > 0, n, n FROM shop_parts
  UNION ALL SELECT 'source_is_fresh', source, n > 0, n, n FROM fresh
  UNION ALL SELECT 'source_thumbnails', source, with_thumbnail * 100 >= n * percent, with_thumbnail, n
    FROM shop_parts WHERE n > 0
  UNION ALL SELECT 'spec_coverage', 'all', count(*) FILTER (WHERE {_ANY_SPEC}) * 100 >= count(*) * 80,
         count(*) FILTER (WHERE {_ANY_SPEC}), count(*) FROM kept
  UNION ALL SELECT 'distinct_categories', 'all', count(DISTINCT category) >= 5,
         count(DISTINCT category), 5 FROM kept
  UNION ALL SELECT 'sane_prices', 'all', count(*) FILTER (WHERE price_pkr NOT BETWEEN 100 AND 2000000) = 0,
         count(*) FILTER (WHERE price_pkr NOT BETWEEN 100 AND 2000000), count(*) FROM price_log
  UNION ALL SELECT 'no_orphan_prices', 'all', count(*) FILTER (WHERE k.part_id IS NULL) = 0,
         count(*) FILTER (WHERE k.part_id IS NULL), count(*)
    FROM price_log l LEFT JOIN kept k ON k.part_id = l.part_id
)"""


def _report(spark, sf_dir):
    """One shop's monitors are missing from the parts, so their price rows are orphans."""
    rows = clean_rows(spark, sf_dir)
    kept = fold_parts(rows).where("not (source = 'pakbyte.pk' and category = 'monitor')")
    return checks(kept, fold_prices(rows), F.lit(CHECK_TIME))


@query(f"WITH {_CHECKS_SQL} SELECT * FROM report")
def quality_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query("WITH " + _CHECKS_SQL.replace(_WITHOUT_SOME_SQL, "SELECT * FROM parts") + " SELECT * FROM report")
def quality_report_whole(spark, sf_dir):
    """All parts, nothing taken away."""
    rows = clean_rows(spark, sf_dir)
    return checks(fold_parts(rows), fold_prices(rows), F.lit(CHECK_TIME))


@query(f"WITH {_CHECKS_SQL} SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS total, "
       "count(*) FILTER (WHERE ok) = count(*) AS ok FROM report")
def quality_summary(spark, sf_dir):
    return summary(_report(spark, sf_dir))


_WHOLE_CHECKS_SQL = _CHECKS_SQL.replace(_WITHOUT_SOME_SQL, "SELECT * FROM parts")


def _profiled(spark, sf_dir):
    """The feed in two loads, shop by shop, each of which is profiled by itself."""
    tables, feed = CatalogueTables(spark, scratch_path(spark, "tables")), product_feed(spark, sf_dir)
    for batch in (feed.where("seq.source_no < 4"), feed.where("seq.source_no >= 4")):
        load_feed(tables, batch, F.lit(FIRST_RUN))
        profiles.profile_prices(tables)
    return profiles.quality_from_profiles(tables, F.lit(CHECK_TIME))


@query(f"WITH {_WHOLE_CHECKS_SQL} SELECT * FROM report")
def quality_from_profiles(spark, sf_dir):
    """The report on stored tables, from the profiles of the log's files and the counts of the parts."""
    return _profiled(spark, sf_dir)


@query(f"WITH {_WHOLE_CHECKS_SQL} SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS total, "
       "count(*) FILTER (WHERE ok) = count(*) AS ok FROM report")
def quality_summary_whole(spark, sf_dir):
    return summary(_profiled(spark, sf_dir))
