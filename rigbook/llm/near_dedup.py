"""MinHash near-deduplication with sequential Bayesian verification.

Texts that share a band of their signatures are candidates. Their signatures are compared batch by batch, and
a candidate goes as soon as the posterior chance that it reaches the similarity asked for, given the hashes
that agreed so far, falls under the miss probability. What survives is connected into clusters, and within a
cluster every pair is verified exactly on the full shingle sets. Work on a bucket or a cluster is dealt out in
pairs of blocks, and only spanning links leave a task, never all pairs of a group.
"""

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import LOWER_BYTES, columns_of, components, small_batches
from rigbook.llm.similarity import (band_keys, buckets, in_units, other_side, shingle_sets, signatures, similar,
                                    spanning)
from rigbook.session import cut_lineage

#: Bands of hashes: a pair of similarity 0.8 shares none with a chance of (1 - 0.8**4)**26, about 1e-6.
BANDS, BAND_ROWS = 26, 4
#: Hashes compared at a time, and the posterior chance of the similarity under which a pair is given up. A pair of
#: exactly 0.8 is given up with a chance of 5e-6, over all batches.
BATCH, MISS = 26, 1e-6
#: Members of a bucket, and of a cluster, that one block of a work unit holds.
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 256


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends, A-Z lower-cased."""
    return (text or "").encode().translate(LOWER_BYTES).split()


@functools.cache
def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """How many hashes must agree after each batch for the posterior of a similarity of at least ``percent``,
    from a uniform prior, not to fall under ``miss``."""
    x = (np.arange(4000) + 0.5) / 4000
    needed = []
    for n in range(BATCH, BANDS * BAND_ROWS + 1, BATCH):
        for m in range(n + 1):
            weight = m * np.log(x) + (n - m) * np.log(1 - x)
            weight = np.exp(weight - weight.max())
            if weight[x >= percent / 100].sum() >= miss * weight.sum():
                needed.append(m)
                break
    return needed


def described(rows: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, digest of the word sequence, n_shingles, band keys, and a byte of each hash, of rows with row,
    doc_id and text; without words the digest is null. Narrow."""
    small_batches(rows.sparkSession)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            sets = shingle_sets(texts, shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            found = signatures([sets[k] for k in full], BANDS * BAND_ROWS)
            keys, low = band_keys(found, BAND_ROWS), found.astype(np.uint8)
            at = {k: i for i, k in enumerate(full)}
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"),
                "digest": pa.array([xxhash.xxh3_128_digest(b" ".join(t)) if t else None for t in texts], pa.binary()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "keys": pa.array([keys[at[k]] if k in at else None for k in range(len(sets))], pa.list_(pa.int64())),
                "hashes": pa.array([low[at[k]].tobytes() if k in at else None for k in range(len(sets))],
                                   pa.binary())})

    return rows.select("row", "doc_id", "text").mapInArrow(
        describe, "row long, doc_id long, digest binary, n_shingles long, keys array<long>, hashes binary")


def surviving(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of signatures are never given up, compared batch by batch."""
    n = len(hashes)
    a, b = np.triu_indices(n, 1)
    agreed = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(percent)):
        part = hashes[:, k * BATCH:(k + 1) * BATCH]
        for begin in range(0, len(a), 1 << 18):
            some = slice(begin, begin + (1 << 18))
            agreed[some] += (part[a[some]] == part[b[some]]).sum(axis=1, dtype=np.int32)
        alive = agreed >= least
        a, b, agreed = a[alive], b[alive], agreed[alive]
    linked = np.zeros((n, n), bool)
    linked[a, b] = linked[b, a] = True
    return linked


def near_links(rows: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between different texts that connect what is similar, exactly verified.

    ``texts`` has a line for each different text: node (the number of a row that has it), keys and hashes;
    ``rows`` has row and text.
    """
    members = texts.select("node", F.explode("keys").alias("key"))
    units = buckets(members, BUCKET_BLOCK).join(texts.select("node", "hashes"), "node")

    def prune(unit: dict[str, list]) -> list[tuple]:
        hashes = np.frombuffer(b"".join(unit["hashes"]), np.uint8).reshape(-1, BANDS * BAND_ROWS)
        return spanning(unit["node"], other_side(unit["side"], surviving(hashes, percent)))

    candidates = cut_lineage(in_units(units, prune, ["node", "side", "hashes"], "a long, b long"))
    clusters = cut_lineage(components(candidates).select("node", F.col("component").alias("key")))
    words = rows.select(F.col("row").alias("node"), "text")
    # Merged at every size: texts are far too large to depend on a broadcast, and small runs show what large ones do.
    units = buckets(clusters, CLUSTER_BLOCK).join(words.where("text is not null").hint("merge"), "node")

    def verify(unit: dict[str, list]) -> list[tuple]:
        sets = shingle_sets([words_of(t) for t in unit["text"]], shingle)
        return spanning(unit["node"], other_side(unit["side"], similar(sets, percent)))

    return in_units(units, verify, ["node", "side", "text"], "a long, b long")


def same_document(named: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the different texts of ids that have several: from each to the first of them."""
    nodes = named.select("doc_id", "digest").join(texts.select("digest", "node"), "digest").select("doc_id", "node")
    several = (nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
               .where("a <> z").select("doc_id", "a"))
    return nodes.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))


def near_dedup(documents: DataFrame, shingle: int = 5, percent: int = 80, *, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the smallest id of its component).

    Documents are linked if their sets of ``shingle`` successive words have a Jaccard similarity of at least
    ``percent`` in a hundred; a text of fewer words is one shingle. Texts that are null, empty or blank have
    no shingle and are linked with nothing. Copies are linked without being compared. Rows that repeat an id
    are one document: each has the size of its own text, and all are in one component. A null id is linked with
    nothing, has a null component, and is kept.

    Rows are told apart by their number in the order of reading, whatever their ids. The texts are read a second
    time for those in clusters, so ``documents`` should be a stored table.
    """
    rows = (columns_of(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
            .withColumn("row", F.monotonically_increasing_id()))
    found = cut_lineage(described(rows, shingle))
    named = found.where("digest is not null and doc_id is not null")
    texts = cut_lineage(named.groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("low"), F.first("keys").alias("keys"),
        F.first("hashes").alias("hashes")))
    links = near_links(rows, texts, shingle, percent).unionAll(same_document(named, texts))
    parts = components(links)
    lows = (texts.select("node", "low").join(parts, "node").groupBy("component")
            .agg(F.min("low").alias("component_id")))
    classes = (texts.select("digest", "node", "low").join(parts, "node", "left").join(lows, "component", "left")
               .select("digest", F.coalesce("component_id", "low").alias("component_id")))
    linked = named.join(classes, "digest").select("doc_id", "n_shingles", "component_id")
    alone = (found.where("digest is null or doc_id is null")
             .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return (linked.unionAll(alone)
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
