"""Spelling variants by dense prefix-suffix tiling.

Two words are one edit apart if their common prefix and common suffix together reach the longer length minus
one. The vocabulary is cut into tiles whose words are padded matrices of code points, one aligned at the first
letter and one at the last; a tile's rows are compared with another's columns, a position at a time for all pairs
at once. An edit leaves the first or the last half of the longer word alone, so only words with such a half in
common come into one bucket, and every pair of a bucket meets in one tile: large buckets are dealt out in pairs
of blocks, and small ones share a tile. No pairs leave a tile, only a count and the most frequent near word of each word.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import columns_of, grouped, lower_az
from rigbook.session import cut_lineage

#: Words of one block of a bucket, and of a tile that small buckets share.
BLOCK, SHARED = 512, 128
#: Letters that a run may consist of.
RUN = "[A-Za-zÀ-ÿ]+"


def counted_words(documents: DataFrame, *, every: int = 199, least_length: int = 6, least_count: int = 5,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: the runs of letters of all texts, A-Z lower-cased, with their number of occurrences.

    Where ``every`` divides the crc32 of ``<doc_id>:<run>``, the run loses one code point (a stand-in for real
    misspellings; 0 leaves all runs as they are). A null text has no words, and a null id counts as empty text.
    Counts are added up in each task before the shuffle, so a word that makes up much of all text costs one row
    per task.
    """
    rows = columns_of(documents, doc_id=doc_id, text=text).where("text is not null")
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all(lower_az(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if every:
        name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
        runs = runs.withColumn("h", F.crc32(name.cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(
            "run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def half(longer):
    """How many letters of the longer word an edit leaves alone at one end, at least."""
    return F.floor(longer / 2).cast("int")


def bucket_members(words: DataFrame) -> DataFrame:
    """word, n, and each bucket (key) it belongs to: by length of the longer word, end, and half at that end.

    A word is the longer one, or as long, in the buckets of its own length, and the shorter one in those above.
    """
    length = F.length("word")
    keys = []
    for longer in (length, length + 1):
        many = half(longer)
        for end, part in ((0, F.substring("word", F.lit(1), many)), (1, F.substring("word", length - many + 1, many))):
            keys.append(F.struct(longer.alias("longer"), F.lit(end).alias("end"), part.alias("half")))
    return words.select("word", "n", F.explode(F.array(*keys)).alias("key")).select("word", "n", "key.*")


def dealt(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of buckets that hold a longer word and another one, in work units (bucket, i, j): the pairs of a
    bucket's blocks. ``side`` is a word's block."""
    bucket = ["longer", "end", "half"]
    sizes = (members.groupBy(*bucket)
             .agg(F.count("*").alias("size"), F.max(F.length("word")).alias("most"))
             .where("size > 1 and most = longer").drop("most"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = members.join(sizes, bucket).withColumn("blocks", blocks).withColumn(
        "side", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (placed.withColumn("o", other).withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))
            .select(*bucket, "i", "j", "blocks", "side", "word", "n"))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` and each row of ``b``, in how many of their first columns they agree."""
    alive = np.ones((len(a), len(b)), bool)
    many = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        alive &= a[:, k][:, None] == b[:, k]
        if not alive.any():
            break
        many += alive
    return many


def near(a: list[str], b: list[str], longer: int, end: int) -> np.ndarray:
    """Which words of ``a`` and ``b``, of ``longer`` letters or one less and one of them longer, are one edit
    apart, and belong to the buckets of this end: pairs that agree in the first half belong to the first ones."""
    sides = []
    for words in (a, b):
        left = np.array(words, f"U{longer}").view(np.uint32).reshape(len(words), longer)
        short = left[:, -1] == 0
        right = np.where(short[:, None], np.roll(left, 1, axis=1), left)
        sides.append((left, right[:, ::-1], short))
    (left_a, right_a, short_a), (left_b, right_b, short_b) = sides
    prefix = agreeing(left_a, left_b)
    found = prefix < longer                              # all letters agree only between a word and itself
    found &= ~(short_a[:, None] & short_b)
    found &= prefix >= longer // 2 if end == 0 else prefix < longer // 2
    if found.any():
        found &= prefix + agreeing(right_a, right_b) >= longer - 1
    return found


class Tally:
    """Counts of near words, and the most frequent of them (of equal ones the first in code-point order)."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, words: list[str], others: list[str], counts: np.ndarray, found: np.ndarray) -> None:
        """``found`` has a row for each of ``words``; ``others`` come by falling count, then in order."""
        many = found.sum(axis=1)
        for k in np.flatnonzero(many):
            best = int(found[k].argmax())
            self.rows.append((words[k], int(many[k]), int(counts[best]), others[best]))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [(), (), (), ()]
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["word", "n_near", "form_n", "form"])


def compared(units: DataFrame) -> DataFrame:
    """word, n_near, form_n, form of each tile: partial answers, to be put together by word."""
    def ordered(words: list[str], counts: list[int]) -> tuple[list[str], np.ndarray]:
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        return [words[k] for k in order], np.array([counts[k] for k in order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, shared, held = Tally(), [], 0

        def small() -> None:
            """Several buckets of one length and end in one tile; only pairs within a bucket count."""
            words, counts = ordered([w for of, _, _, _ in shared for w in of], [n for _, of, _, _ in shared for n in of])
            _, _, longer, end = shared[0]
            own = longer // 2
            half_of = np.array([w[:own] if end == 0 else w[len(w) - own:] for w in words])
            found = near(words, words, longer, end)
            if found.any():
                tally.add(words, words, counts, found & (half_of[:, None] == half_of))

        for (longer, end, _, i, j), unit in grouped(batches, ["longer", "end", "half", "i", "j"], ["word", "n", "side", "blocks"]):
            if shared and (shared[0][2:] != (longer, end) or held + len(unit["word"]) > SHARED):
                small()
                shared, held = [], 0
            if unit["blocks"][0] == 1 and len(unit["word"]) <= SHARED:
                shared.append((unit["word"], unit["n"], longer, end))
                held += len(unit["word"])
            else:
                sides = [ordered(*([x for x, s in zip(unit[c], unit["side"], strict=True) if s == side] for c in ("word", "n")))
                         for side in ((i, j) if i != j else (i,))]
                (words, counts), (others, more) = sides[0], sides[-1]
                if words and others:
                    found = near(words, others, longer, end)
                    tally.add(words, others, more, found)
                    if i != j:
                        tally.add(others, words, counts, found.T)
            if len(tally.rows) > 20_000:
                yield tally.batch()
        if shared:
            small()
        if tally.rows:
            yield tally.batch()

    in_order = ["longer", "end", "half", "i", "j"]
    return (units.repartition(*in_order).sortWithinPartitions(*in_order)
            .mapInArrow(run, "word string, n_near long, form_n long, form string"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for a written table of different words and their counts n.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its most
    frequent near word (of equal ones the first in code-point order) if that is at least ``ratio`` times as
    frequent. The root is where following forms ends. Chains grow by the ratio with each step, so their length is
    bounded by the logarithm of the largest count, and jumping over two forms at a time by the logarithm of that.
    """
    parts = compared(dealt(bucket_members(words)))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    known = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.m") >= ratio * F.col("n")
    found = cut_lineage(words.join(known, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.form")).alias("form"),
        F.when(often, -F.col("best.m")).alias("form_n")))

    seen = found.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = math.floor(math.log(seen.most / seen.least, ratio) + 1e-9) if seen.most and ratio > 1 else 0
    links = found.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = links.select(F.col("at").alias("root"), F.col("root").alias("next"))
        links = cut_lineage(links.join(onward, "root", "left").select("at", F.coalesce("next", "root").alias("root")))
    return (found.join(links, F.col("word") == F.col("at"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(documents: DataFrame, *, ratio: int = 5, **options) -> DataFrame:
    """Words of whole texts with their spelling variants; see ``counted_words`` and ``variants``. An empty table
    gives an empty one."""
    return variants(cut_lineage(counted_words(documents, **options)), ratio)
