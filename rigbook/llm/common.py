"""What several of the text operators share."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigbook.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes of UTF-8: lower-cases A-Z and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker holds at once, by rows as well as by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def lower_az(text):
    """The text with A-Z, and nothing else, in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def id_remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo a number; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def columns_of(table: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names, whatever else the table carries."""
    return table.select(*(F.col(f"`{name}`").alias(alias) for alias, name in wanted.items()))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str],
            columns: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """The groups of rows that come in order of their keys, one at a time: the key and the columns' values."""
    last, held = None, {c: [] for c in columns}
    for batch in batches:
        of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        values = [batch.column(c).to_pylist() for c in columns]
        begin = 0
        for k in range(1, len(of) + 1):
            if k == len(of) or of[k] != of[begin]:
                if of[begin] != last:
                    if last is not None:
                        yield last, held
                    last, held = of[begin], {c: [] for c in columns}
                for c, v in zip(columns, values, strict=True):
                    held[c] += v[begin:k]
                begin = k
    if last is not None:
        yield last, held


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (node, component) for each node in a link, where
    component is the smallest node that can be reached.

    Stars are merged until nothing changes: every node links its larger neighbours to its smallest one,
    then its smaller neighbours to the smallest among them. Minima are aggregated before their shuffle and
    joined back, so no node's neighbours are gathered in a task. Each round is written to the shared folder.
    """
    edges = cut_lineage(links.where("a is not null and b is not null and a <> b")
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))))
        edges = cut_lineage(small.distinct())
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
