"""The stored catalogue: Parquet directories under one root.

``price_log`` and ``shared_builds`` only grow, so rows are appended. ``parts`` and ``prebuilts`` change in place,
which plain Parquet cannot do, so they are kept in buckets: rows of one shop and one hash range of keys. A load
writes the buckets its batch falls into anew, into a directory of its own, and then the list of which directory
holds each bucket now. That list counts once Spark has put its ``_SUCCESS`` marker there: readers see the old or
the new state, go on reading the one they opened, and a failed write leaves nothing visible. Buckets that a batch
does not touch are neither read nor written. With its buckets a load stores their counts, so that counts and
facets of the whole table are sums over small rows that are always those of the state read.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigbook import schemas
from rigbook.session import cut_lineage, freeing_shuffles

#: Groups of shops; each has so many buckets as the tables are made with.
SHOP_GROUPS = 32
#: Key, and order within a bucket's files, which lets readers skip what their filters exclude.
BUCKETED = {"parts": ("part_id", schemas.LISTING, ["category", "price_pkr"]),
            "prebuilts": ("prebuilt_id", schemas.PREBUILTS, ["source", "price_pkr"])}
#: What the rows of a bucket are counted by, beside the bucket itself.
COUNTED = {"parts": ["source", "category", "specs"], "prebuilts": ["source"]}
#: Bytes of a row group: small enough that a category's or a part's rows fill some of them, not a share of all.
ROW_GROUP = 16 << 20
#: Rows of a page where single keys are looked up; readers skip whole pages by their least and largest key.
PAGE_ROWS = 2000


class CatalogueTables:
    def __init__(self, spark: SparkSession, root: str, buckets_per_shop: int = 2):
        """``buckets_per_shop`` must stay the same for a root; a bucket should fill a few files."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets_per_shop = buckets_per_shop

    # -- reading -----------------------------------------------------------------------------------

    def listing(self) -> DataFrame:
        """All parts with their latest price, in one table: listings need no join."""
        return self._bucketed("parts")

    def parts(self) -> DataFrame:
        return self.listing().select(schemas.PARTS.names)

    def latest_prices(self) -> DataFrame:
        return self.listing().where("priced_at is not null").select(
            "part_id", "price_pkr", F.col("priced_at").alias("scraped_at"))

    def prebuilts(self) -> DataFrame:
        return self._bucketed("prebuilts")

    def part_counts(self) -> DataFrame:
        """(source, category, specs, n, thumbnails): how many parts there are of each kind, and with a thumbnail; sum
        over both."""
        return self._counts("parts")

    def prebuilt_counts(self) -> DataFrame:
        """(source, n, thumbnails) of the prebuilts; sum over both."""
        return self._counts("prebuilts")

    def price_log(self) -> DataFrame:
        return self._read("price_log", schemas.PRICE_LOG)

    def price_files(self, paths: list[str]) -> DataFrame:
        """Rows of some files of the log, with the file's directory and name."""
        reader = self.spark.read.schema(schemas.PRICE_LOG).option("basePath", f"{self.root}/price_log")
        name = F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0)
        return reader.parquet(*paths).select(*schemas.PRICE_LOG.names, name.alias("file"))

    def price_profiles(self) -> DataFrame:
        return self._read("price_profiles", schemas.PRICE_PROFILES)

    def unprofiled_files(self) -> list[str]:
        """Files of the log that no profile is about; names only, as the reader of the log holds them too."""
        paths = {"/".join(path.rsplit("/", 2)[1:]): path for path in self.price_log().inputFiles()}
        if not paths:
            return []
        names = self.spark.createDataFrame([(name,) for name in paths], "file string")
        new = names.join(self.price_profiles().select("file"), "file", "left_anti")
        return [paths[row.file] for row in new.collect()]

    def shared_builds(self) -> DataFrame:
        return self._read("shared_builds", schemas.SHARED_BUILDS)

    # -- writing -----------------------------------------------------------------------------------

    def merge_parts(self, folded: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrite the buckets of parts that a folded batch falls into; ``merge`` takes the stored rows of those
        buckets and the batch. Returns the buckets."""
        return self._merge("parts", folded, merge)

    def merge_prebuilts(self, folded: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        return self._merge("prebuilts", folded, merge)

    def replace_parts(self, listing: DataFrame) -> None:
        """Write all parts anew."""
        self._write_buckets("parts", listing, {})

    def append_prices(self, rows: DataFrame) -> int:
        """Append log rows, dealt out by month and part and sorted, with a Bloom filter of the parts in each row
        group: one part's history is read from a few pages, not from all of its months. The time belongs to the
        range, so that a part with most of a month's rows is cut as well."""
        laid_out = rows.repartitionByRange("scraped_month", "part_id", "scraped_at")
        return self._append("price_log", laid_out, ["scraped_month"], ["scraped_month", "part_id", "scraped_at"],
                            {"parquet.bloom.filter.enabled#part_id": "true",
                             "parquet.bloom.filter.adaptive.enabled": "true",   # as large as its parts need
                             "parquet.block.size": str(ROW_GROUP),
                             "parquet.page.row.count.limit": str(PAGE_ROWS)})

    def append_profiles(self, rows: DataFrame) -> int:
        return self._append("price_profiles", rows.to(schemas.PRICE_PROFILES).hint("rebalance"), [], ["file", "hour"], {})

    def append_builds(self, rows: DataFrame) -> int:
        return self._append("shared_builds", rows, [], ["code"], {})

    def keep_last(self, table: str, states: int = 1) -> int:
        """Remove what only older states of a bucketed table refer to; readers of those fail from then on. Returns
        the number of removed directories."""
        numbers = self._states(table)
        kept, gone = numbers[-states:], numbers[:-states]
        if not kept:
            return 0
        held = {(r.version, r.bucket) for n in kept for r in self._state(table, n).collect()}
        newest = max(v for v, _ in held)
        removed = 0
        for version in self._names(f"{table}/data", "version="):
            for bucket in self._names(f"{table}/data/version={version}", "bucket=") if version <= newest else []:
                if (version, bucket) not in held:
                    removed += self._remove(f"{table}/data/version={version}/bucket={bucket}")
        for version in self._names(f"{table}/counts", "version="):
            if version <= newest and version not in {v for v, _ in held}:
                self._remove(f"{table}/counts/version={version}")
        for number in gone:
            self._remove(f"{table}/_states/v{number:08d}")
        return removed

    # -- buckets -----------------------------------------------------------------------------------

    def _bucket(self, key: str) -> Column:
        return (F.pmod(F.xxhash64("source"), F.lit(SHOP_GROUPS)) * self.buckets_per_shop
                + F.pmod(F.xxhash64(key), F.lit(self.buckets_per_shop))).cast("int")

    def _states(self, table: str) -> list[int]:
        """Numbers of the finished states, in order."""
        return [n for n in self._names(f"{table}/_states", "v") if self._exists(f"{table}/_states/v{n:08d}/_SUCCESS")]

    def _state(self, table: str, number: int) -> DataFrame:
        return self.spark.read.schema("bucket int, version int").parquet(f"{self.root}/{table}/_states/v{number:08d}")

    def _places(self, table: str) -> dict[int, int]:
        """Which version holds each bucket now: at most as many rows as there are buckets."""
        numbers = self._states(table)
        return {r.bucket: r.version for r in self._state(table, numbers[-1]).collect()} if numbers else {}

    def _bucketed(self, table: str, only: list[int] | None = None) -> DataFrame:
        places = {b: v for b, v in self._places(table).items() if only is None or b in only}
        return self._at(table, places)

    def _at(self, table: str, places: dict[int, int], more: T.StructType = T.StructType()) -> DataFrame:
        schema = T.StructType([*BUCKETED[table][1], *more])
        paths = [f"{self.root}/{table}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
        if not paths:
            return self._none(schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}/data")
        return reader.parquet(*paths).select(schema.names)

    def _merge(self, table: str, folded: DataFrame, merge) -> list[int]:
        key, _, _ = BUCKETED[table]
        batch = cut_lineage(folded.withColumn("bucket", self._bucket(key)))
        touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())
        if touched:
            merged = merge(self._bucketed(table, touched), batch.drop("bucket"))
            self._write_buckets(table, merged, self._places(table))
        return touched

    def _write_buckets(self, table: str, rows: DataFrame, places: dict[int, int]) -> None:
        """Write the buckets of these rows, and the state in which the others stay where they are."""
        key, schema, order = BUCKETED[table]
        version = max(self._names(f"{table}/data", "version="), default=0) + 1
        path = f"{table}/data/version={version}"
        # Rebalancing, unlike a hash repartition, cuts a bucket that holds most of the rows into several files.
        laid_out = rows.to(schema).withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket")
        with freeing_shuffles(self.spark):
            (laid_out.sortWithinPartitions("bucket", *order).write.mode("errorifexists").partitionBy("bucket")
             .options(**{"compression": "zstd", "parquet.block.size": str(ROW_GROUP)}).parquet(f"{self.root}/{path}"))
        written = dict.fromkeys(self._names(path, "bucket="), version)
        self._write_counts(table, written, version)
        places = places | written
        number = max(self._names(f"{table}/_states", "v"), default=0) + 1
        state = self.spark.createDataFrame(sorted(places.items()), "bucket int, version int")
        state.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/{table}/_states/v{number:08d}")

    def _write_counts(self, table: str, places: dict[int, int], version: int) -> None:
        """The counts of freshly written buckets; only the columns counted by are read again."""
        rows = self._at(table, places, T.StructType([T.StructField("bucket", T.IntegerType())]))
        counts = rows.groupBy("bucket", *COUNTED[table]).agg(
            F.count(F.lit(1)).alias("n"), F.count("thumbnail_url").alias("thumbnails"))
        with freeing_shuffles(self.spark):
            counts.write.mode("errorifexists").parquet(f"{self.root}/{table}/counts/version={version}")

    def _counts(self, table: str) -> DataFrame:
        kept = [f for f in BUCKETED[table][1] if f.name in COUNTED[table]]
        schema = T.StructType([T.StructField("bucket", T.IntegerType()), *kept, T.StructField("n", T.LongType()),
                               T.StructField("thumbnails", T.LongType())])
        places = self._places(table)
        if not places:
            return self._none(schema).drop("bucket")
        versions = sorted(set(places.values()))
        rows = (self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}/counts")
                .parquet(*(f"{self.root}/{table}/counts/version={v}" for v in versions)))
        # A version's counts hold for those of its buckets that no later version has replaced.
        current = F.lit(False)
        for v in versions:
            current |= (F.col("version") == v) & F.col("bucket").isin([b for b, at in places.items() if at == v])
        return rows.where(current).select(*COUNTED[table], "n", "thumbnails")

    # -- files -------------------------------------------------------------------------------------

    def _folder(self, path: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, path: str) -> bool:
        fs, folder = self._folder(path)
        return fs.exists(folder)

    def _remove(self, path: str) -> bool:
        fs, folder = self._folder(path)
        return fs.delete(folder, True)

    def _names(self, path: str, prefix: str) -> list[int]:
        """The numbers in a folder whose names are this prefix and a number, in order."""
        fs, folder = self._folder(path)
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())

    def _none(self, schema: T.StructType) -> DataFrame:
        """No rows, and the planner knows: joins with them are dropped before anything is shuffled."""
        return self.spark.createDataFrame([], schema).limit(0)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        if not self._exists(path):
            return self._none(schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}").select(schema.names)

    def _append(self, table: str, rows: DataFrame, partition_by: list, order: list, options: dict) -> int:
        written = Observation()
        counted = rows.observe(written, F.count(F.lit(1)).alias("rows"))
        with freeing_shuffles(self.spark):
            (counted.sortWithinPartitions(*order).write.mode("append").option("compression", "zstd").options(**options)
             .partitionBy(*partition_by).parquet(f"{self.root}/{table}"))
        return written.get["rows"]
