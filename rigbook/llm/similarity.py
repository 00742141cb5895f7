"""Shared steps of the near-duplicate operators: shingles, bands, blocks of a bucket, exact overlaps."""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import grouped

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a Bloom filter (16 MB), and how many of them one row of its table holds.
SLOT_BITS = 27
SLOTS, STRETCH = 1 << SLOT_BITS, 1 << 19


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count=len(words))


def stirred(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """The hashed shingles of each text as they follow each other; fewer words make one shingle, none make none."""
    ends = np.cumsum([0, *map(len, texts)])
    if not ends[-1]:
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = hash_words([w for t in texts for w in t])
    rows = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        rows[:len(hashes) - k] = stirred(rows[:len(hashes) - k] * MIX + hashes[k:] + np.uint64(k + 1))
    found = []
    for text, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            found.append(rows[a:b - size + 1])
        else:
            found.append(hash_words([b" ".join(text)]) if b > a else np.zeros(0, np.uint64))
    return found


def shingle_sets(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, in order; fewer words make one shingle, none make none."""
    return [np.unique(s) for s in shingles(texts, size)]


def distinct_counts(values: list[np.ndarray]) -> np.ndarray:
    """How many different values each array has. All are sorted at once, by array and the upper bits of the value; only
    arrays in which two agree there are looked at one by one."""
    counts = np.array([len(v) for v in values], np.int64)
    bits = np.uint64(max(len(values).bit_length(), 1))
    of = np.repeat(np.arange(len(values), dtype=np.uint64) << (np.uint64(64) - bits), counts)
    marks = np.sort(of | (np.concatenate(values) >> bits)) if len(values) else of
    for k in np.unique(marks[1:][marks[1:] == marks[:-1]] >> (np.uint64(64) - bits)).tolist():
        counts[k] = len(np.unique(values[k]))
    return counts


def signatures(sets: list[np.ndarray], hashes: int, seed: int = 5) -> np.ndarray:
    """Minimum hashes of non-empty sets, one row each."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    term = rng.integers(0, 2**32, hashes, dtype=np.uint32)
    out = np.empty((len(sets), hashes), np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 1 << 16):
            held += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        begins = np.cumsum([0, *(len(s) for s in sets[at:end - 1])])
        spare = np.empty_like(x)
        for k in range(hashes):
            np.multiply(x, factor[k], out=spare)
            np.add(spare, term[k], out=spare)
            out[at:end, k] = np.minimum.reduceat(spare, begins)
        at = end
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many hashes."""
    n, bands = len(signature), signature.shape[1] // rows
    keys = np.zeros((n, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = stirred(keys * MIX + signature[:, k::rows][:, :bands])
    return keys.view(np.int64)


def buckets(members: DataFrame, block: int) -> DataFrame:
    """Members (node, key) of keys that at least two share, dealt out to work units: a key's members are
    split into blocks by a hash, and each pair of blocks is a unit. Columns: key, i, j, side, node.

    So every pair of a bucket meets in one unit, and no unit holds more than about two blocks.
    """
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (members.join(shared, "key")
             .select("key", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node", "key"), blocks).cast("int").alias("side")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (dealt.select("key", "node", "side", other.alias("o"))
            .select("key", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "node"))


def bits_of(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of SLOTS bits over a column of 64-bit hashes. Each task fills its own stretches of it, so
    that what reaches the driver is at most SLOTS bits, whatever the number of hashes."""
    name = hashes.columns[0]
    slots = hashes.select(F.explode(F.array(F.shiftrightunsigned(name, 64 - SLOT_BITS),
                                            F.col(name).bitwiseAND(SLOTS - 1))).alias("slot"))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            part = slot // STRETCH
            for k in np.unique(part).tolist():
                bits = held.setdefault(k, np.zeros(STRETCH // 8, np.uint8))
                at = slot[part == k] % STRETCH
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int64()),
                                          "bits": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    parts = (slots.distinct().withColumn("part", F.expr(f"slot div {STRETCH}")).repartition("part").select("slot")
             .mapInArrow(fill, "part long, bits binary"))
    filled = np.zeros((SLOTS // STRETCH, STRETCH // 8), np.uint8)
    for row in parts.toLocalIterator():
        filled[row.part] = np.frombuffer(row.bits, np.uint8)
    return filled.ravel()


def maybe_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter; none that is among them is missed."""
    x = hashes.view(np.uint64)
    found = np.ones(len(x), bool)
    for slot in (x >> np.uint64(64 - SLOT_BITS), x & np.uint64(SLOTS - 1)):
        found &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def in_units(rows: DataFrame, work: Callable[[dict[str, list]], Iterable[tuple]], columns: list[str],
             schema: str) -> DataFrame:
    """``work`` on the columns of each unit (key, i, j); yields rows of the schema. Units are streamed one
    after the other through a task that has them in order."""
    names = [part.split()[0] for part in schema.split(",")]
    types = [{"long": pa.int64(), "int": pa.int32()}[part.split()[1]] for part in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in grouped(batches, ["key", "i", "j"], columns):
            if len(unit[columns[0]]) > 1 and (found := list(work(unit))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def overlap_rows(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set in turn, how many elements it shares with every set."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    by_value = of[np.argsort(number, kind="stable")]
    first = np.cumsum(np.concatenate([[0], count]))[:-1]
    ends = np.cumsum([0, *(len(s) for s in sets)])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        ids = number[a:b]
        lengths = count[ids]
        at = np.repeat(first[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if b > a else \
            np.zeros(0, np.int64)
        yield np.bincount(by_value[at + np.arange(len(at))], minlength=len(sets))


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are linked: 100 * intersection >= percent * union, counted exactly."""
    sizes = np.array([len(s) for s in sets])
    linked = np.zeros((len(sets), len(sets)), bool)
    for k, shared in enumerate(overlap_rows(sets)):
        linked[k] = (shared > 0) & (100 * shared >= percent * (sizes[k] + sizes - shared))
    return linked


def linked_pair(nodes: list[int], texts: list[list[bytes]], size: int, percent: int) -> list[tuple[int, int]]:
    """The link between two texts, if their shingles are similar: what ``shingle_sets``, ``similar`` and ``spanning`` find
    for a unit of two, without their arrays."""
    one, two = ({tuple(t[k:k + size]) for k in range(max(len(t) - size, 0) + 1)} if t else set() for t in texts)
    shared = len(one & two)
    linked = shared > 0 and 100 * shared >= percent * (len(one) + len(two) - shared)
    return [(nodes[0], nodes[1])] if linked and nodes[0] != nodes[1] else []


def spanning(nodes: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects, fewer than there are nodes."""
    seen, out = np.zeros(len(nodes), bool), []
    for root in range(len(nodes)):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
            out += [(nodes[root], nodes[x]) for x in front if nodes[x] != nodes[root]]
    return out


def other_side(sides: list[int], linked: np.ndarray) -> np.ndarray:
    """In a unit of two blocks, only links between them; those within a block have their own unit."""
    side = np.array(sides)
    return linked & (side[:, None] != side) if (side != side[0]).any() else linked
