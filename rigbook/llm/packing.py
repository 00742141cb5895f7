"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

An instance of bin packing is the number of pieces of each length, so it has no more entries than a sequence
has places, however many documents there are. The plan is made on those counts: while some length has a small
set of partners that dominates every other set it could share a sequence with, such sequences are fixed for
good and taken off the instance; what is left is packed by best fit, longest first, whole groups of equal
sequences at a time. Pieces then find their places by their rank among the pieces of their length.
"""

import bisect
import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from rigbook.llm.common import columns_of, small_batches
from rigbook.llm.token_counts import LETTERS, NUMERALS, PLAIN
from rigbook.session import cut_lineage

#: The vocabulary's own split for texts of plain characters.
WORDS = re.compile(f" ?[{LETTERS}A-ZÀ-ÖØ-Þ]+| ?[{NUMERALS}]+|'s|'t|'re|'ve|'m|'ll|'d"
                   f"| ?[^\\s{LETTERS}A-ZÀ-ÖØ-Þ{NUMERALS}]+|\\s+(?!\\S)|\\s+").findall

#: So many pre-tokens are remembered before the memory starts afresh.
REMEMBERED = 400_000

#: (length, how many of it) pairs of one sequence, and how many sequences are filled like that.
Pattern = tuple[tuple[tuple[int, int], ...], int]


class TokenIds(dict):
    """Pre-token to its ids as little-endian 32-bit numbers; remembers what it has merged."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.blank = self.as_bytes(" ")[0][0]
        self.model = self.tokenizer.model
        self.coded = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        # Letters of ASCII are spelled as themselves, and the blank before a word as one sign.
        spelled = word.replace(" ", self.blank) if word.isascii() and word.isprintable() else self.as_bytes(word)[0][0]
        self[word] = ids = b"".join([self.coded[t.id] for t in self.model.tokenize(spelled)])
        return ids

    def of(self, text: str) -> bytes:
        """The ids of a whole text; special strings are taken as the library takes them by default."""
        if PLAIN(text) and not any(s in text for s in self.specials):
            return b"".join(map(self.__getitem__, WORDS(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def ids_for(path: str) -> TokenIds:
    return TokenIds(path)


def pieces(documents: DataFrame, vocabulary: str, size: int = 2048, *, end_id: int = 0, with_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A document is its ids and then ``end_id``. One of more than ``size`` ids is cut from its end, so that only
    its first piece may be shorter. A null text counts as empty and gives one piece, the end id. Narrow.
    """
    small_batches(documents.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids_for(vocabulary)
        for batch in batches:
            rows = {name: [] for name in ("of", "piece", "start", "length", "crc", "ids")}
            for at, value in enumerate(batch.column("text").to_pylist()):
                ids = known.of(value or "") + end
                n = len(ids) // 4
                starts = [0, *range(n % size or size, n, size)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    part = ids[4 * a:4 * b]
                    for name, x in zip(rows, (at, k, a, b - a, zlib.crc32(part), part), strict=True):
                        if name != "ids" or with_ids:
                            rows[name].append(x)
            out = {"doc_id": batch.column("doc_id").take(pa.array(rows["of"], pa.int32())),
                   "piece": pa.array(rows["piece"], pa.int32()), "start": pa.array(rows["start"], pa.int64()),
                   "length": pa.array(rows["length"], pa.int64()), "ids_crc32": pa.array(rows["crc"], pa.int64())}
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in rows["ids"]],
                                      pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    rows = columns_of(documents, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                           + ", ids array<int>" * with_ids)


def dominating(length: int, left: Counter, size: int) -> tuple[int, ...] | None:
    """Partners that, put with one piece of this length, dominate every other choice of partners, or None.

    Any other set dominates less if its pieces fit into the places that these partners take, since the two
    can then be exchanged in any packing. ``left`` counts the pieces beside the one at hand.
    """
    room = size - length
    fits = sorted(x for x, n in left.items() if n and x <= room)
    if not fits:
        return ()
    best = fits[-1]
    smallest = [x for x in fits[:3] for _ in range(min(left[x], 3))][:3]
    if best == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (best,)  # fills the sequence, or nothing but single partners fits
    if len(smallest) == 3 and sum(smallest) <= room:
        return None     # sets of three partners are not looked into
    taken = left - Counter([best])
    second = max((x for x in fits if x <= room - best and taken[x]), default=0)
    # Pairs whose smaller piece does not fit the second place must fit the first one together.
    pairs = [x for x in fits if x > second]
    low, high, most = 0, len(pairs) - 1, 0
    while low <= high:
        if low == high and left[pairs[low]] < 2:
            break
        if pairs[low] + pairs[high] <= room:
            most, low = max(most, pairs[low] + pairs[high]), low + 1
        else:
            high -= 1
    if most > best:
        return None
    return (best, second) if second else (best,)


def reduce_instance(counts: dict[int, int], size: int) -> tuple[list[Pattern], Counter]:
    """Fix dominating sets until there are none: the fixed sequences, and the pieces that are left."""
    left, fixed = Counter(counts), []
    while True:
        before = len(fixed)
        for length in sorted(left, reverse=True):
            while left[length]:
                left[length] -= 1
                partners = dominating(length, left, size)
                left[length] += 1
                if partners is None:
                    break
                group = Counter((length, *partners))
                times = min(left[x] // n for x, n in group.items())
                fixed.append((tuple(sorted(group.items(), reverse=True)), times))
                left -= Counter({x: n * times for x, n in group.items()})
        left = +left
        if len(fixed) == before:
            return fixed, left


def best_fit(counts: Counter, size: int) -> list[Pattern]:
    """Best fit, longest pieces first, on groups of sequences that are filled alike."""
    groups: dict[int, list[list]] = {}      # room left: [pattern, how many]
    rooms: list[int] = []                   # the rooms in order

    def put(room: int, pattern: list, times: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append([pattern, times])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each, bins = size // length, n // (size // length)
                if bins:
                    put(size - each * length, [(length, each)], bins)
                if n % each:
                    put(size - n % each * length, [(length, n % each)], 1)
                break
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            full = min(times, n // each)
            if full:
                put(room - each * length, [*pattern, (length, each)], full)
            n -= full * each
            if full < times:
                times -= full
                if n:
                    put(room - n * length, [*pattern, (length, n)], 1)
                    times, n = times - 1, 0
                if times:
                    put(room, pattern, times)
    return [(tuple(pattern), times) for group in groups.values() for pattern, times in group]


def plan(counts: dict[int, int], size: int) -> list[Pattern]:
    """How to fill sequences of ``size`` with so many pieces of each length."""
    fixed, left = reduce_instance(counts, size)
    return fixed + best_fit(left, size)


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset, as few sequences as the method finds, gapless from 0.

    ``cut`` holds doc_id, piece and length (other columns stay) and is read twice, so it should be a written
    table. Only the counts by length reach the driver, at most ``size`` rows. A piece's rank within its
    length comes from its rank in one of many slices of that length and the sizes of the slices before, so
    no length is ordered in one task. An empty table gives an empty one.
    """
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, first = [], 0
    ranks: Counter = Counter()
    for pattern, times in plan(counts, size):
        offset = 0
        for length, each in pattern:
            rows.append((length, ranks[length], each, offset, first))
            ranks[length] += each * times
            offset += each * length
        first += times
    rows.sort()
    places = np.array(rows, np.int64).reshape(-1, 5)
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(counts.values(), default=0) // 20_000))

    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("in_slice"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("l"), F.col("slice").alias("s"),
                          F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("skip"))
    ranked = (sliced.join(starts, (F.col("length") == F.col("l")) & (F.col("slice") == F.col("s")))
              .withColumn("rank", F.col("skip") - 1 + F.row_number().over(
                  Window.partitionBy("length", "slice").orderBy("doc_id", "piece")))
              .drop("l", "s", "skip", "slice"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = places[:, 0] * 2**40 + places[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = places[np.searchsorted(order, length * 2**40 + rank, "right") - 1]
            nth = rank - at[:, 1]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(at[:, 4] + nth // at[:, 2]),
                 pa.array(at[:, 3] + nth % at[:, 2] * length)], names=[*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, vocabulary: str, size: int = 2048, **options) -> DataFrame:
    """Cut, write and pack whole documents; see ``pieces`` and ``pack``."""
    return pack(cut_lineage(pieces(documents, vocabulary, size, **options)), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids as training rows: sequence_id, ids, and doc_ids, which tells documents apart in them.

    Takes pieces packed with their ids. A sequence is bounded by its size, and so is each group here.
    """
    spots = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(spots.alias("parts"))
            .select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                    F.flatten(F.transform("parts", lambda p: F.array_repeat(p["doc_id"], F.size(p["ids"]))))
                    .alias("doc_ids")))
