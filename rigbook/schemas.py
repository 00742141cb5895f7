"""Schemas of every table the library reads or writes."""

from pyspark.sql import types as T

from rigbook import fixed


def _strings(names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _table(**columns):
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()

#: Structs instead of JSON text: Parquet prunes to the one field a query asks for and takes the filter.
SPECS = _strings(fixed.SPEC_FIELDS)
COMPONENTS = _strings(fixed.COMPONENT_FIELDS)

#: Position of a feed row in refresh order; decides which of two rows with one key came last.
SEQ = _table(source_no=_I, category_no=_I, page=_L, pos=_L)

PAGES = _table(source=_S, seed_url=_S, page=_I, url=_S, html=_S, fetched_at=_TS)
FEED = _table(name=_S, price_pkr=_L, url=_S, category=_S, source=_S, scraped_at=_TS,
              thumbnail_url=_S, seq=SEQ)
PREBUILT_FEED = _table(name=_S, price_pkr=_L, url=_S, source=_S, scraped_at=_TS,
                       thumbnail_url=_S, components=COMPONENTS, seq=SEQ)

PARTS = _table(part_id=_S, source=_S, source_id=_S, name=_S, category=_S, url=_S,
               thumbnail_url=_S, specs=SPECS, created_at=_TS, updated_at=_TS)
#: The stored parts: with the latest price, which may be NULL, and its time.
LISTING = T.StructType([*PARTS, T.StructField("price_pkr", _L), T.StructField("priced_at", _TS)])
#: ``scraped_month`` is the directory column of the log.
PRICE_LOG = _table(part_id=_S, price_pkr=_L, scraped_at=_TS, scraped_month=T.DateType())
#: Rows of one log file by shop and hour (hours since 1970); ``part_id`` is that of rows without a part only.
PRICE_PROFILES = _table(file=_S, source=_S, part_id=_S, hour=_L, rows=_L, outliers=_L)
LATEST_PRICES = _table(part_id=_S, price_pkr=_L, scraped_at=_TS)
PREBUILTS = _table(prebuilt_id=_S, source=_S, source_id=_S, name=_S, url=_S, thumbnail_url=_S,
                   price_pkr=_L, components=COMPONENTS, scraped_at=_TS, created_at=_TS,
                   updated_at=_TS)
SHARED_BUILDS = _table(code=_S, slots=T.MapType(_S, _S), created_at=_TS)
