"""Toxic passages by maximum-scoring segments.

A word scores the log-odds of standing in toxic rather than clean documents, under a Dirichlet prior that
the whole corpus gives, less a constant for every word. One scan over a text finds all its
maximal segments. How likely a clean text of that length has a segment of such a score follows the
extreme-value law of segment scores, whose two parameters come from the words of clean documents.
"""

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import columns_of, id_remainder, small_batches
from rigbook.session import cut_lineage

#: Words are whole: forms of one stem differ in what they mark.
WORDS = re.compile(r"[^\W\d_]+").findall
#: At most about so many labelled documents are learnt from; chosen by a hash of the id.
LEARN_ROWS = 40_000
#: Weight of the prior in words, least significance of a log-odds in standard deviations, cost of a word.
PRIOR, SIGNIFICANT, COST = 2000.0, 4.5, 0.25
#: Passages expected by chance, in a clean text of that length, at which a document counts as toxic.
CHANCE = 0.001
#: Different words that a task holds before it sends their counts on.
HELD_WORDS = 200_000


def numbers_of(text: str | None, known: dict[str, int]) -> np.ndarray:
    """The words of a text by their numbers; 0 stands for every word that marks nothing."""
    words = WORDS((text or "").lower())
    return np.fromiter(map(known.get, words, repeat(0)), np.int64, count=len(words))


def labelled_ids(labels: DataFrame, label: str, modulus: int) -> dict[int, int]:
    """Ids and labels to learn from, at most about LEARN_ROWS; of several labels of an id the largest."""
    usable = (columns_of(labels, doc_id="doc_id", y=label).where("y is not null and doc_id is not null")
              .where(id_remainder(F.col("doc_id"), modulus) != 0))
    share = min(1.0, LEARN_ROWS / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return {r.doc_id: int(r.y) for r in chosen.groupBy("doc_id").agg(F.max("y").alias("y")).collect()}


def labelled_words(documents: DataFrame, known_labels: dict[int, int]) -> DataFrame:
    """Every word of the labelled documents, and in how many clean and toxic ones it stands: word, clean, toxic."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(known_labels)   # at most about LEARN_ROWS

    def rows(held: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(held, pa.string()),
                                           "clean": pa.array([n for n, _ in held.values()], pa.int64()),
                                           "toxic": pa.array([n for _, n in held.values()], pa.int64())})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if (y := sent.value.get(key)) is None:
                    continue
                for word in set(WORDS((text.as_py() or "").lower())):
                    held.setdefault(word, [0, 0])[y > 0] += 1
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held = {}
        yield rows(held)

    return (columns_of(documents, doc_id="doc_id", text="text")
            .mapInArrow(count, "word string, clean long, toxic long")
            .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def corpus_counts(documents: DataFrame, words: list[str]) -> np.ndarray:
    """In how many of all documents each word stands; place 0 holds all other words together."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast({word: k for k, word in enumerate(words, 1)})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        marked, totals = frozenset(known), np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = set(WORDS((text or "").lower()))
                here = found & marked
                totals[0] += len(found) - len(here)
                totals[[known[w] for w in here]] += 1
        yield pa.RecordBatch.from_pydict({"number": pa.array(range(len(totals)), pa.int32()), "n": pa.array(totals)})

    sums = (columns_of(documents, text="text").mapInArrow(count, "number int, n long")
            .groupBy("number").agg(F.sum("n").alias("n")))
    found = np.zeros(len(words) + 1)
    for row in sums.collect():      # one row for each word that was asked for
        found[row.number] = row.n
    return found


def word_counts(documents: DataFrame, known_labels: dict[int, int]) -> tuple[list[str], np.ndarray]:
    """The words that differ significantly between clean and toxic documents, and a table of how many documents have
    each: all, clean and toxic ones. Row 0 holds all other words together, row k the k-th word.

    Words are counted by themselves, however many there are. Only those of labelled documents can be significant,
    and only significant ones reach the driver.
    """
    words = cut_lineage(labelled_words(documents, known_labels))
    all_clean, all_toxic = (float(n or 0) for n in words.agg(F.sum("clean"), F.sum("toxic")).first())
    share = (F.col("clean") + F.col("toxic")) / F.lit(max(1.0, all_clean + all_toxic))

    def part(n, total: float):
        return n * F.log(F.greatest(n, F.lit(1)) / F.greatest(F.lit(total) * share, F.lit(1e-300)))
    ratio = 2 * (part(F.col("clean"), all_clean) + part(F.col("toxic"), all_toxic))
    chosen = words.where(ratio >= SIGNIFICANT ** 2).orderBy("word").collect()   # a part of the labelled sample's words
    table = np.zeros((len(chosen) + 1, 3))
    table[:, 0] = corpus_counts(documents, [r.word for r in chosen])
    table[1:, 1:] = np.array([(r.clean, r.toxic) for r in chosen]).reshape(-1, 2)
    table[0, 1:] = (all_clean, all_toxic) - table[1:, 1:].sum(axis=0)
    return [r.word for r in chosen], table


def significance(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Root of the likelihood ratio of two shares and one: standard deviations by which they differ. It holds for
    words that one side never has as well, whose log-odds have no finite deviation."""
    share = (toxic + clean) / max(1.0, toxic.sum() + clean.sum())

    def part(n: np.ndarray) -> np.ndarray:
        return n * np.log(np.maximum(n, 1) / np.maximum(n.sum() * share, 1e-300))
    return np.sqrt(np.maximum(2 * (part(toxic) + part(clean)), 0))


class SegmentModel:
    """Scores of words by number, and the parameters of the law of the largest segment score of a clean text. Row 0
    of the counts holds all words that mark nothing; each of them costs what a word costs."""

    def __init__(self, counts: np.ndarray):
        everything, clean, toxic = counts.T
        prior = PRIOR * (everything + 0.01) / (everything.sum() + 0.01 * len(everything))
        a, b = toxic + prior, clean + prior
        certain = significance(toxic, clean) >= SIGNIFICANT
        certain[0] = False
        odds = np.zeros(len(counts))
        odds[certain] = (np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b)))[certain] if certain.any() else 0.0
        self.scores = np.where(certain, np.clip(odds, -2, 12), 0.0) - COST
        self.learnt = bool(toxic.sum() and clean.sum() and (self.scores > 0).any())
        if not self.learnt:
            self.scores[:] = -COST
        share = b / b.sum()
        self.rate = self._rate(share)
        # A segment of one word is the rule, so the factor is the chance that a word begins one, per unit.
        tail = share[self.scores > 0] @ np.exp(self.rate * self.scores[self.scores > 0])
        self.factor = float(np.clip(tail, 1e-6, 1.0))

    def _rate(self, share: np.ndarray) -> float:
        """The positive root of E[exp(rate * score)] = 1 over words of clean documents."""
        if not (self.scores > 0).any():
            return 1.0
        low, high = 1e-4, 5.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if share @ np.exp(middle * self.scores) < 1 else (low, middle)
        return low

    def expected(self, score: float, words: int) -> float:
        """Segments of at least this score that a clean text of so many words has by chance."""
        return self.factor * max(1, words) * float(np.exp(-self.rate * score))

    def segments(self, numbers: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (begin, end, score), in one scan over the words that score above 0.

        A list of candidates is kept, each with the sums before and after it. A new one is joined to the
        last candidate that starts lower, if it ends higher as well.
        """
        scores = self.scores[numbers]
        # The n-th time in a row a marked word scores an n-th; any other word costs what an unknown one does.
        again = np.concatenate([np.zeros(min(1, len(numbers)), bool), numbers[1:] == numbers[:-1]])
        if again.any():
            places = np.arange(len(numbers))
            nth = places - np.maximum.accumulate(np.where(again, 0, places)) + 1
            scores[again] = np.where(scores > 0, (scores + COST) / nth, 0.0)[again] - COST
        at = np.flatnonzero(scores > 0)
        if not len(at):
            return []
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        stack: list[tuple[int, int, float, float]] = []     # begin, end, sum before, sum after
        lower: list[int] = []                               # nearest candidate before that starts lower, or -1
        for p in map(int, at):
            begin, end, left, right = p, p + 1, sums[p], sums[p + 1]
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= left:
                    j = lower[j]
                if j < 0 or stack[j][3] >= right:
                    stack.append((begin, end, left, right))
                    lower.append(j)
                    break
                begin, left = stack[j][0], stack[j][2]
                del stack[j:], lower[j:]
        return [(a, b, float(r - x)) for a, b, x, r in stack]

    def document(self, numbers: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score from 0 to 1, and its significant passages."""
        found = self.segments(numbers)
        chances = [self.expected(s, len(numbers)) for _, _, s in found]
        passages = [x for x, e in zip(found, chances, strict=True) if e <= CHANCE]
        least = min(chances, default=1e9)
        return 1 / (1 + (least / CHANCE) ** 0.5), passages


def toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out (its id's remainder is 0), score, predicted, and its passages
    as (begin, end in words, score).

    A score is at least 0.5 if the best passage is as rare in clean texts as CHANCE says. A text that is null,
    empty or without letters scores near 0, and so does every text when labels of both kinds are missing. Words are counted over
    all documents; labels come from ids whose remainder is not 0. Rows that repeat are scored each.
    """
    words, counts = word_counts(documents, labelled_ids(labels, label, modulus))
    sent = documents.sparkSession.sparkContext.broadcast(
        ({word: k for k, word in enumerate(words, 1)}, SegmentModel(counts)))   # significant words only

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = sent.value
        for batch in batches:
            found = [model.document(numbers_of(t, known)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": pa.array([s for s, _ in found], pa.float64()),
                "passages": pa.array([[{"begin": a, "end": b, "score": s} for a, b, s in p] for _, p in found],
                                     pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()),
                                                         ("score", pa.float64())])))})

    rows = columns_of(documents, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(score, f"doc_id {kind}, score double, "
                                   "passages array<struct<begin: int, end: int, score: double>>")
            .select("doc_id", (id_remainder(F.col("doc_id"), modulus) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"))
