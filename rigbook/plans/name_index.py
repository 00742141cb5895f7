"""Name search by an index of trigrams.

The index holds, for each three successive letters of a name (A-Z folded, as the search folds them), the parts
that have them. A search takes the trigrams between its wildcards, looks up how many parts have each, intersects
the lists from the rarest on, and verifies what is left by the search itself. Trigrams that a large share of all
parts have are not looked up: verification is cheaper than reading their lists.

Lists hold numbers of parts, their places, and not their keys: keys are long and cannot be compressed, while places
stand in order and take about a byte each. The key of a place is looked up once the lists are intersected.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigbook.functions.text import name_matches
from rigbook.session import cut_lineage, scans_of, scratch_run
from rigbook.sources.tables import PAGE_ROWS, ROW_GROUP

#: Trigrams that a search looks up at most, the rarest ones.
LISTS = 4
#: Of the parts' table a task reads so much; its postings, some fifty times as many rows, are sorted in memory.
SCAN = "8m"
#: A block of keys has so many, as a power of two: few rows, none of which is large.
BLOCK_BITS = 12
#: Letters A-Z and their small forms: what the search folds, and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trigrams(text: Column) -> Column:
    """The different trigrams of a text; none for shorter ones. One pass of a pattern that looks ahead, which, unlike
    a function mapped over places, is compiled and need not count letters from the text's beginning each time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))."), F.lit(1)))


def build_postings(parts: DataFrame) -> DataFrame:
    """(gram, place) of all names. A name has no more trigrams than letters, so the index grows with the text."""
    return parts.select(F.explode(trigrams(folded(F.col("name")))).alias("gram"), "place")


def write_index(parts: DataFrame, path: str) -> None:
    """Store the index: postings, sorted so that a list lies together, and how many parts have each trigram.

    Parts are numbered in the order of a written table. Each task sorts and writes the postings of its own parts, so
    that none are shuffled and a trigram of most names is cut like any other; tasks are small enough to sort in
    memory. Pages are small, so that a look-up reads little more than its lists, of each file that has any. Beside
    the postings lie the keys of the parts, in rows without a trigram that hold a block of keys each.
    """
    spark, store = parts.sparkSession, f"{path}/postings"
    with scratch_run(spark), scans_of(spark, SCAN):
        numbered = cut_lineage(parts.select(F.monotonically_increasing_id().alias("place"), "part_id", "name"))
        (build_postings(numbered).sortWithinPartitions("gram", "place")
         .select("gram", "place", F.lit(None).cast("array<string>").alias("part_ids")).write
         .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#place", "false")
         .option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.row.count.limit", str(PAGE_ROWS))
         .parquet(store))
        keys = (numbered.groupBy(F.shiftright("place", BLOCK_BITS).alias("block"))
                .agg(F.sort_array(F.collect_list(F.struct("place", "part_id"))).alias("keys")))
        (keys.select(F.lit(None).cast("string").alias("gram"), F.col("block").alias("place"),
                     F.col("keys.part_id").alias("part_ids")).write.mode("append").parquet(store))
    stored = spark.read.parquet(store).where("gram is not null")
    (stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("gram").write
     .parquet(f"{path}/counts"))


def grams_of(query: str) -> list[str]:
    """The trigrams that every name found must have: those of the pieces between wildcards."""
    low = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in query)
    pieces = low.replace("_", "%").split("%")
    return sorted({p[k:k + 3] for p in pieces for k in range(len(p) - 2)})


def candidates(index: DataFrame, counts: DataFrame, query: str, share: float = 0.1, total: int | None = None) -> DataFrame | None:
    """part_id of the parts that have the rarest trigrams of the query, at most LISTS of them; None if it has no
    trigram, or none that fewer than ``share`` of all parts have, so that all names must be read."""
    grams = grams_of(query)
    if not grams:
        return None
    known = {r.gram: r.n for r in counts.where(F.col("gram").isin(grams)).collect()}
    rare = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LISTS]
    if total is not None:
        rare = [g for g in rare if known.get(g, 0) <= max(share * total, 1)]
    if not rare:
        return None
    lists = [index.where(F.col("gram") == g).select("place") for g in rare]
    found = lists[0]
    for more in lists[1:]:
        found = found.join(more, "place", "left_semi")       # lists of different parts: a semi join intersects them
    blocks = index.where("gram is null").select(F.col("place").alias("block"), "part_ids")
    return (found.join(blocks, F.shiftright(found["place"], BLOCK_BITS) == blocks["block"])
            .select(F.get("part_ids", found["place"].bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")).alias("part_id")))


def search(listing: DataFrame, path: str, query: str, share: float = 0.1) -> DataFrame:
    """The parts of a stored listing whose names match the query, as :func:`name_matches` has it.

    Where the index helps, the candidates are written out, a table of known size, and the listing is streamed past
    it, so that the pattern runs on candidates alone. A query without a trigram of letters reads all names.
    """
    spark = listing.sparkSession
    index, counts = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "counts"))
    total = counts.agg(F.max("n")).first()[0]       # a lower bound of the number of parts: the most frequent trigram
    found = candidates(index, counts, query, share, total)
    if found is None:
        return listing.where(name_matches(F.col("name"), query))
    chosen = cut_lineage(found)
    return listing.join(chosen, "part_id", "left_semi").where(name_matches(F.col("name"), query))
