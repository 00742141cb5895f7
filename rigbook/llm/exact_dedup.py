"""Exact deduplication against a minimal perfect hash of the distinct digests of history.

The index is a table of parts, each a minimal perfect hash of some hundred thousand digests: bit levels that
place every digest in a slot of its own, and by slot the full digest, its winner's locator (the largest id)
and how many rows it stands for. A new digest is looked up in one part; only equal digest bytes in the slot
make it a repeat, which joins the slot's group. All others group among themselves.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import columns_of, lower_az
from rigbook.session import cut_lineage

#: Digests in one part of the index, on average.
PART_KEYS = 100_000
#: Bits of a level for each digest still without a slot.
ROOM = 2

INDEX = "part int, n int, levels array<int>, bits binary, digests binary, winners binary, sizes binary"


def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each 32-byte digest falls on a level; another quarter of it stirs each level."""
    words = keys.view("<u8").reshape(-1, 4)
    with np.errstate(over="ignore"):
        x = words[:, 1] + words[:, 2] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Levels of bits for distinct digests: a digest has its slot on the first level where it falls alone."""
    sizes, bits, level = [], [], 0
    while len(keys):
        size = ROOM * len(keys) + 64
        spot = _spots(keys, level, size)
        alone = np.bincount(spot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys, level = keys[~alone[spot]], level + 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Each digest's slot; -1 if no level holds it. Foreign digests may get a slot: bytes must be compared."""
    ranks = np.cumsum(bits) - 1
    slots, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        spot = start + _spots(keys[open_], level, size)
        hit = bits[spot]
        slots[open_[hit]] = ranks[spot[hit]]
        open_, start = open_[~hit], start + size
    return slots


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def build_index(winners: DataFrame, parts: int) -> DataFrame:
    """The index of a table of distinct digests (digest, winner, size), one row for each part."""
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(rows["digest"])
        sizes, bits = build_levels(keys)
        order = np.empty(len(keys), np.int64)
        order[find_slots(keys, sizes, bits)] = np.arange(len(keys))
        return pd.DataFrame([{
            "part": key[0], "n": len(keys), "levels": sizes, "bits": np.packbits(bits).tobytes(),
            "digests": keys[order].tobytes(),
            "winners": rows["winner"].fillna(NO_ID).to_numpy(np.int64)[order].tobytes(),
            "sizes": rows["size"].to_numpy(np.int64)[order].tobytes()}])

    return _with_part(winners, parts).groupBy("part").applyInPandas(build, INDEX)


#: Stands in the index for the locator of a group all of whose ids are null.
NO_ID = -2**63


def _with_part(winners: DataFrame, parts: int) -> DataFrame:
    return winners.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))


def merge_with_index(arrivals: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """All groups after the arrivals: digest, keep_id, group_size, repeat (an arrival was in the index).

    ``arrivals`` holds distinct digests (digest, winner, size): a text of which there are thousands was
    aggregated before, so that no part gets more than its share of digests.
    """
    def merge(key: tuple, new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(new["digest"])
        winner, size = new["winner"].fillna(NO_ID).to_numpy(np.int64), new["size"].to_numpy(np.int64)
        found = []
        member = np.zeros(len(keys), bool)
        for row in held.itertuples():
            bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), count=int(sum(row.levels))).astype(bool)
            there = np.frombuffer(row.digests, np.uint8).reshape(-1, 32)
            best, total = (np.frombuffer(x, np.int64).copy() for x in (row.winners, row.sizes))
            slots = find_slots(keys, list(row.levels), bits)
            member = slots >= 0
            member[member] = (there[slots[member]] == keys[member]).all(axis=1)
            at = slots[member]      # distinct digests, hence distinct slots
            best[at] = np.maximum(best[at], winner[member])
            total[at] += size[member]
            repeat = np.zeros(len(there), bool)
            repeat[at] = True
            found.append((there, best, total, repeat))
        rest = ~member
        found.append((keys[rest], winner[rest], size[rest], np.zeros(rest.sum(), bool)))
        digests, best, total, repeat = map(np.concatenate, zip(*found, strict=True))
        keep = pd.Series(best, dtype="Int64").mask(best == NO_ID)
        return pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": keep, "group_size": total,
                             "repeat": repeat})

    return (_with_part(arrivals, parts).groupBy("part").cogroup(index.groupBy("part"))
            .applyInPandas(merge, "digest binary, keep_id long, group_size long, repeat boolean"))


def winners_of(digests: DataFrame) -> DataFrame:
    """Distinct digests with the largest id and the number of rows; aggregated before the shuffle."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))


def digests_of(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = columns_of(documents, doc_id=doc_id, text=text)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(lower_az(F.col("text")), 256)).alias("digest"))


def exact_dedup(documents: DataFrame, history: DataFrame, **columns) -> DataFrame:
    """One row for each row of both tables: doc_id, keep_id, group_size, kept, text_sha256, repeat.

    ``history`` is indexed, ``documents`` are looked up. Texts are equal if they are identical once A-Z are
    lower-cased; null counts as empty. Of equal texts, across both tables, the largest id stays. Rows that
    repeat one id are one document: all are kept or none. A null id stays only if its text has no other;
    either table may be empty. ``repeat`` tells groups that were in history and arrived again.
    """
    new = digests_of(documents, **columns).withColumn("old", F.lit(False))
    old = digests_of(history, **columns).withColumn("old", F.lit(True))
    digests = cut_lineage(new.unionAll(old))
    count = cut_lineage(winners_of(digests.where("old")))
    arrived = winners_of(digests.where("not old"))
    parts = max(1, -(-digests.count() // PART_KEYS))
    index = cut_lineage(build_index(count, parts))
    groups = merge_with_index(arrived, index, parts)
    return (digests.join(groups, "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "repeat"))
