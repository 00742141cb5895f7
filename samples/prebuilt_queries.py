"""Queries on complete systems built from the sample's prebuilt feed."""

import datetime
import hashlib

from pyspark.sql import functions as F

from rigbook import schemas
from rigbook.operators.loading import fold_prebuilts, upsert_prebuilts as upsert
from rigbook.plans import catalogue, prebuilts
from samples.feed import PREBUILTS_SQL, prebuilt_feed
from samples.registry import query

_COLUMNS = ["prebuilt_id", "source", "source_id", "name", "url", "thumbnail_url", "price_pkr",
            "components.cpu", "components.gpu", "components.ram", "scraped_at"]
_SQL = ("prebuilt_id, source, source_id, name, url, thumbnail_url, price_pkr, cpu, gpu, ram, scraped_at")


def _prebuilts(spark, sf_dir):
    return fold_prebuilts(prebuilt_feed(spark, sf_dir))


@query(f"""WITH {PREBUILTS_SQL},
runs AS (SELECT *, CASE WHEN scraped_at < TIMESTAMP '1998-07-01' THEN 1 ELSE 2 END AS run
         FROM prebuilt_feed),
last_rows AS (
  SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY run DESC, l_orderkey DESC,
                               l_linenumber DESC, l_suppkey DESC) AS n,
         last_value(thumbnail_url IGNORE NULLS) OVER (
           PARTITION BY source, source_id ORDER BY run, l_orderkey, l_linenumber, l_suppkey
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_thumbnail,
         min(run) OVER (PARTITION BY source, source_id) AS first_run
  FROM runs)
SELECT md5(source || '/' || source_id) AS prebuilt_id, source, source_id, name, url,
       last_thumbnail AS thumbnail_url, price_pkr, cpu, gpu, ram, scraped_at,
       CASE first_run WHEN 1 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2002-02-01' END AS created_at,
       CASE run WHEN 1 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2002-02-01' END AS updated_at
FROM last_rows WHERE n = 1""")
def upsert_prebuilts(spark, sf_dir):
    """Two runs: what was scraped before the border, then the rest."""
    feed, border = prebuilt_feed(spark, sf_dir), datetime.datetime(1998, 7, 1)
    empty = spark.createDataFrame([], schemas.PREBUILTS)
    first = upsert(empty, feed.where(F.col("scraped_at") < border), F.lit(datetime.datetime(2002, 1, 1)))
    both = upsert(first, feed.where(F.col("scraped_at") >= border), F.lit(datetime.datetime(2002, 2, 1)))
    return both.select(*_COLUMNS, "created_at", "updated_at")


@query(f"""WITH {PREBUILTS_SQL} SELECT {_SQL} FROM prebuilts
WHERE source = 'redtech.pk' AND price_pkr BETWEEN 20000 AND 90000 AND name ILIKE '%gizmo%'
ORDER BY price_pkr, source, source_id LIMIT 20 OFFSET 3""")
def prebuilts_page(spark, sf_dir):
    return prebuilts.list_prebuilts(
        _prebuilts(spark, sf_dir), source="redtech.pk", min_price=20000, max_price=90000, q="GIZMO",
        limit=20, offset=3).select(*_COLUMNS)


@query(f"WITH {PREBUILTS_SQL} SELECT count(*) AS total FROM prebuilts WHERE price_pkr >= 50000")
def prebuilts_total(spark, sf_dir):
    """A brand nobody knows is no filter."""
    return prebuilts.count_prebuilts(_prebuilts(spark, sf_dir), min_price=50000, cpu_brand="via")


@query(f"""WITH {PREBUILTS_SQL} SELECT {_SQL} FROM prebuilts
WHERE price_pkr IS NOT NULL AND (cpu ILIKE '%intel%' OR cpu ILIKE '%core i%')""")
def prebuilts_cpu_brand(spark, sf_dir):
    return prebuilts.matching_prebuilts(_prebuilts(spark, sf_dir), cpu_brand="Intel").select(*_COLUMNS)


@query(f"""WITH {PREBUILTS_SQL} SELECT {_SQL} FROM prebuilts
WHERE price_pkr IS NOT NULL AND (gpu ILIKE '%rtx%' OR gpu ILIKE '%gtx%' OR gpu ILIKE '%nvidia%')
  AND (cpu ILIKE '%amd%' OR cpu ILIKE '%ryzen%')""")
def prebuilts_gpu_brand(spark, sf_dir):
    return prebuilts.matching_prebuilts(_prebuilts(spark, sf_dir), gpu_brand="nvidia",
                                        cpu_brand="amd").select(*_COLUMNS)


@query(f"WITH {PREBUILTS_SQL} SELECT {_SQL} FROM prebuilts "
       "WHERE prebuilt_id = md5('zestrogaming.com/product-pc-7')")
def prebuilt_by_id(spark, sf_dir):
    key = hashlib.md5(b"zestrogaming.com/product-pc-7").hexdigest()
    return prebuilts.get_prebuilt(_prebuilts(spark, sf_dir), key).select(*_COLUMNS)


@query(f"""WITH {PREBUILTS_SQL}
SELECT 'total' AS metric, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM prebuilts
UNION ALL SELECT 'by_source', source, count(*) FROM prebuilts GROUP BY source""")
def prebuilt_stats(spark, sf_dir):
    return catalogue.prebuilt_stats(_prebuilts(spark, sf_dir))
