"""A product feed, a prebuilt feed and saved part lists, derived from the driver's tables.

Each derivation exists twice: as DataFrame expressions here, and as SQL text for the other engine.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import part_key, slug
from rigbook.schemas import COMPONENTS, FEED, PREBUILT_FEED
from samples.titles import PER_CATEGORY, TITLES

CPUS = ("AMD Ryzen 5 5600", "Intel Core i5 12400F", "Core i7 13700", None)
GPUS = ("MSI RTX 4060", "Sapphire Radeon RX 6600", "Intel Arc A750", "GTX 1660 Super", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, number):
    """The number-th of some literals, counted from 0 and around."""
    return F.get(literals(values), (number % len(values)).cast("int"))


def literals(values):
    """Some texts as one array literal."""
    quoted = ["CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "\\'") + "'" for v in values]
    return F.expr(f"array({', '.join(quoted)})")


def category(partkey):
    return pick(fixed.CATEGORIES, partkey)


def title(partkey):
    """The title of a part: its category's next one with each round through the categories."""
    titles = [t for c in fixed.CATEGORIES for t, _ in TITLES[c]]
    turn = F.floor(partkey / 10) % PER_CATEGORY
    return F.get(literals(titles),
                 ((partkey % 10) * PER_CATEGORY + turn).cast("int"))


def product_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed row per line item, scraped when it shipped.

    The name ends differently from scrape to scrape, pictures and prices are missing now and then, and
    an address may or may not end with a slash.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    key, source = F.col("p_partkey"), pick(fixed.PART_SOURCES, F.col("l_suppkey"))
    return rows.select(
        F.concat_ws(" ", title(key), "p_name", "l_returnflag",
                    F.concat(F.lit("#"), key)).alias("name"),
        F.when(F.col("l_quantity") != 13, F.floor("l_extendedprice")).alias("price_pkr"),
        F.concat(F.lit("https://"), source, F.lit("/product/"),
                 F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), key,
                 F.when(F.col("l_linenumber") % 2 == 0, "/").otherwise("")).alias("url"),
        category(key).alias("category"), source.alias("source"),
        F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
        F.when(F.col("l_linestatus") != "O", F.concat(
            F.lit("https://"), source, F.lit("/img/"), key, F.lit("-"), "l_linenumber",
            F.lit(".jpg"))).alias("thumbnail_url"),
        F.struct((F.col("l_suppkey") % 9).cast("int").alias("source_no"),
                 (key % 10).cast("int").alias("category_no"), F.col("l_orderkey").alias("page"),
                 (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_suppkey")).alias("pos"))
        .alias("seq")).to(FEED)


def prebuilt_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prebuilt feed row per line item: a complete system per part and shop, scraped repeatedly."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_linestatus", "l_shipdate")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    key, source = F.col("p_partkey"), pick(fixed.PREBUILT_SOURCES, F.col("l_suppkey"))
    cpu, gpu = pick(CPUS, key + F.col("l_linenumber")), pick(GPUS, key)
    values = {"cpu": cpu, "gpu": gpu, "ram": F.concat((F.col("p_size") % 4 * 8 + 8).cast("string"),
                                                      F.lit("GB"))}
    components = F.struct(*[values.get(f, F.lit(None).cast("string")).alias(f)
                            for f in fixed.COMPONENT_FIELDS])
    return rows.select(
        F.concat(F.lit("Gaming PC "), "p_name", F.lit(" #"), key).alias("name"),
        F.when(F.col("l_quantity") <= 45, F.floor("l_extendedprice")).alias("price_pkr"),
        F.concat(F.lit("https://"), source, F.lit("/product/pc-"), key, F.lit("/")).alias("url"),
        source.alias("source"), F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
        F.when(F.col("l_linestatus") != "O", F.concat(
            F.lit("https://"), source, F.lit("/img/"), key, F.lit("-"), "l_linenumber"))
        .alias("thumbnail_url"),
        F.when(F.col("l_linenumber") != 5, components).cast(COMPONENTS).alias("components"),
        F.struct((F.col("l_suppkey") % 3).cast("int").alias("source_no"),
                 F.lit(0).alias("category_no"), F.col("l_orderkey").alias("page"),
                 (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_suppkey")).alias("pos"))
        .alias("seq")).to(PREBUILT_FEED)


def part_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build_id, slots): one part list per order. Each line fills the slot of its number; of two lines
    for one slot the larger key stays. Some keys are of parts the catalogue rejected."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                    "l_suppkey")
    source = pick(fixed.PART_SOURCES, F.col("l_suppkey"))
    url = F.concat(F.lit("https://"), source, F.lit("/product/"),
                   F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey"))
    lines = (items.join(part, F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("l_orderkey").alias("build_id"),
                     (F.col("l_linenumber") % 8).cast("int").alias("slot_no"),
                     F.unhex(part_key(source, slug(url))).alias("key")))
    # At most eight slots per list, so one aggregation with a column for each makes them. Keys are shuffled as bytes,
    # which have the order of their letters. A line that belongs to no slot has none to name, and fails the job.
    numbers = range(len(fixed.BUILD_SLOTS))
    lists = lines.groupBy("build_id").agg(
        *[F.max(F.when(F.col("slot_no") == n, F.col("key"))).alias(f"key_{n}") for n in numbers],
        F.bool_or(F.coalesce(~F.col("slot_no").between(0, len(numbers) - 1), F.lit(True))).alias("astray"))
    slots = F.filter(F.array(*[F.struct(F.lit(s).alias("slot"), F.lower(F.hex(f"key_{n}")).alias("part_id"))
                               for n, s in enumerate(fixed.BUILD_SLOTS)]), lambda e: e["part_id"].isNotNull())
    entries = F.when(F.col("astray"), F.raise_error(F.lit("a line of a part list has no slot")).cast(
        "array<struct<slot:string,part_id:string>>")).otherwise(slots)
    return lists.select("build_id", F.map_from_entries(entries).alias("slots"))


# -- the same in SQL -------------------------------------------------------------------------------------

def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values, number: str) -> str:
    return f"({sql_list(values)})[CAST(({number}) % {len(values)} AS BIGINT) + 1]"


def _titles_sql() -> str:
    def text(value):
        return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"
    rows = [f"({c_no}, {turn}, {text(name)}, "
            + ", ".join(text(specs.get(f)) for f in fixed.SPEC_FIELDS) + ")"
            for c_no, c in enumerate(fixed.CATEGORIES) for turn, (name, specs) in enumerate(TITLES[c])]
    fields = ", ".join(f'"{f}"' for f in fixed.SPEC_FIELDS)
    return f"titles(category_no, turn, title, {fields}) AS (VALUES {', '.join(rows)})"


_SPEC_COLUMNS = ", ".join(f't."{f}"' for f in fixed.SPEC_FIELDS)

FEED_SQL = f"""{_titles_sql()},
feed AS (
  SELECT concat_ws(' ', t.title, p_name, l_returnflag, '#' || p_partkey) AS name,
         CASE WHEN l_quantity <> 13 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price_pkr,
         'https://' || {sql_pick(fixed.PART_SOURCES, "l_suppkey")} || '/product/'
           || replace(p_name, ' ', '-') || '-' || p_partkey
           || CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '' END AS url,
         'product-' || replace(p_name, ' ', '-') || '-' || p_partkey AS source_id,
         {sql_pick(fixed.CATEGORIES, "p_partkey")} AS category,
         {sql_pick(fixed.PART_SOURCES, "l_suppkey")} AS source,
         CAST(l_shipdate AS TIMESTAMP) AS scraped_at,
         CASE WHEN l_linestatus <> 'O' THEN 'https://' || {sql_pick(fixed.PART_SOURCES, "l_suppkey")}
           || '/img/' || p_partkey || '-' || l_linenumber || '.jpg' END AS thumbnail_url,
         l_orderkey, l_linenumber, l_suppkey, p_partkey, t.title, {_SPEC_COLUMNS}
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN titles t ON t.category_no = p_partkey % 10 AND t.turn = (p_partkey // 10) % {PER_CATEGORY}
)"""

# The floors and blocked terms, stated once more as plain SQL.
_FLOOR_SQL = "CASE category " + " ".join(
    f"WHEN '{c}' THEN {p}" for c, p in fixed.PRICE_FLOORS.items()) + " ELSE 0 END"
_BLOCKED_SQL = " OR ".join(
    [f"contains(lower(name), '{t}')" for t in fixed.BLOCKED_TERMS]
    + [f"(category = '{c}' AND contains(lower(name), '{t}'))"
       for c, terms in fixed.BLOCKED_TERMS_BY_CATEGORY.items() for t in terms])

CLEAN_SQL = FEED_SQL + f""",
judged AS (
  SELECT *, CASE WHEN price_pkr IS NULL THEN 'no_price' WHEN price_pkr < {_FLOOR_SQL} THEN 'below_floor'
                 WHEN {_BLOCKED_SQL} THEN 'blocked_name' END AS reason
  FROM feed
),
clean AS (SELECT * FROM judged WHERE reason IS NULL)"""

_SPEC_NAMES = ", ".join(f'"{f}"' for f in fixed.SPEC_FIELDS)

# The catalogue after loading the whole feed at once.
CATALOGUE_SQL = CLEAN_SQL + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, source_id
                               ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS from_last,
         first_value(url) OVER (PARTITION BY source, source_id
                                ORDER BY l_orderkey, l_linenumber, l_suppkey) AS first_url,
         last_value(thumbnail_url IGNORE NULLS) OVER (
           PARTITION BY source, source_id ORDER BY l_orderkey, l_linenumber, l_suppkey
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_thumbnail
  FROM clean
),
parts AS (
  SELECT md5(source || '/' || source_id) AS part_id, source, source_id, name, category,
         first_url AS url, last_thumbnail AS thumbnail_url, {_SPEC_NAMES}
  FROM ranked WHERE from_last = 1
),
price_log AS (
  SELECT part_id, source, source_id, price_pkr, scraped_at FROM (
    SELECT md5(source || '/' || source_id) AS part_id, *, row_number() OVER (
      PARTITION BY source, source_id, scraped_at ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n
    FROM clean) WHERE n = 1
),
latest AS (
  SELECT part_id, price_pkr, scraped_at FROM (
    SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY scraped_at DESC) AS n FROM price_log)
  WHERE n = 1
)"""

PREBUILTS_SQL = f"""prebuilt_feed AS (
  SELECT 'Gaming PC ' || p_name || ' #' || p_partkey AS name,
         CASE WHEN l_quantity <= 45 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price_pkr,
         'https://' || {sql_pick(fixed.PREBUILT_SOURCES, "l_suppkey")} || '/product/pc-' || p_partkey
           || '/' AS url,
         'product-pc-' || p_partkey AS source_id,
         {sql_pick(fixed.PREBUILT_SOURCES, "l_suppkey")} AS source,
         CAST(l_shipdate AS TIMESTAMP) AS scraped_at,
         CASE WHEN l_linestatus <> 'O' THEN 'https://'
           || {sql_pick(fixed.PREBUILT_SOURCES, "l_suppkey")} || '/img/' || p_partkey || '-'
           || l_linenumber END AS thumbnail_url,
         CASE WHEN l_linenumber <> 5 THEN {sql_pick(CPUS, "p_partkey + l_linenumber")} END AS cpu,
         CASE WHEN l_linenumber <> 5 THEN {sql_pick(GPUS, "p_partkey")} END AS gpu,
         CASE WHEN l_linenumber <> 5 THEN (p_size % 4 * 8 + 8) || 'GB' END AS ram,
         l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
prebuilts AS (
  SELECT md5(source || '/' || source_id) AS prebuilt_id, source, source_id, name, url,
         last_thumbnail AS thumbnail_url, price_pkr, cpu, gpu, ram, scraped_at
  FROM (
    SELECT *, row_number() OVER (PARTITION BY source, source_id
                                 ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS n,
           last_value(thumbnail_url IGNORE NULLS) OVER (
             PARTITION BY source, source_id ORDER BY l_orderkey, l_linenumber, l_suppkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_thumbnail
    FROM prebuilt_feed)
  WHERE n = 1
)"""

PART_LISTS_SQL = f"""build_lines AS (
  SELECT l_orderkey AS build_id, l_linenumber % 8 AS slot_no,
         max(md5({sql_pick(fixed.PART_SOURCES, "l_suppkey")} || '/product-' || replace(p_name, ' ', '-')
             || '-' || p_partkey)) AS part_id
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey, l_linenumber % 8
)"""
