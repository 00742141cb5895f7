"""Benchmark decontamination with a positional inverted index of the training text.

The index is stored in segments of whole documents, as search engines shard theirs: for every different word
of a segment, in order, the sorted positions where it stands. It is written once and searched for any set of
test phrases, in blocks of a fixed size. In a segment a phrase's lists are intersected from its rarest word
on, each shifted by the word's offset; words that are missing end the search at once.
"""

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import LOWER_BYTES, columns_of, small_batches
from rigbook.session import cut_lineage

#: Every byte that is no part of a word becomes a blank, A-Z become a-z; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(LOWER_BYTES[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

#: Words after which a segment is closed. A document is never divided.
SEGMENT_WORDS = 400_000
#: Phrases that are searched for at once; more are searched in further passes over the index.
BLOCK_PHRASES = 100_000

INDEX = "segment long, doc_ids array<long>, starts binary, words binary, first binary, positions binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def build_index(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index, one row for each segment; no shuffle.

    ``starts`` holds where each document's words begin in the segment, ``words`` the different words in byte
    order, ``first`` where each word's positions begin in ``positions``. A null text has no words.
    """
    small_batches(documents.sparkSession)

    def segment(number_of: int, ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        starts = np.cumsum([0, *map(len, texts)])
        number = defaultdict(count().__next__)
        seen = np.fromiter((number[w] for t in texts for w in t), np.int32, count=starts[-1])
        words = list(number)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        seen = rank[seen] if len(words) else seen
        positions = np.argsort(seen, kind="stable").astype(np.int32)
        first = np.concatenate([[0], np.cumsum(np.bincount(seen, minlength=len(words)))])
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([number_of], pa.int64()),
            "doc_ids": pa.array([ids], pa.list_(pa.int64())), "starts": [starts.astype(np.int64).tobytes()],
            "words": [b" ".join(words[i] for i in order)], "first": [first.astype(np.int32).tobytes()],
            "positions": [positions.tobytes()]})

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, next_one = [], [], 0, count((TaskContext.get().partitionId() << 32))
        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(key)
                texts.append(words_of(value))
                held += len(texts[-1])
                if held >= SEGMENT_WORDS:
                    yield segment(next(next_one), ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield segment(next(next_one), ids, texts)

    rows = columns_of(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(build, INDEX)


class Segment:
    """A segment, opened for a vocabulary of query words."""

    def __init__(self, row: dict, vocabulary: list[bytes]):
        self.number, self.doc_ids = row["segment"], row["doc_ids"]
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.first = np.frombuffer(row["first"], np.int32)
        self.positions = np.frombuffer(row["positions"], np.int32)
        at = {w: i for i, w in enumerate(row["words"].split(b" "))} if row["words"] else {}
        self.rank = np.array([at.get(w, -1) for w in vocabulary], np.int64)
        self.many = np.where(self.rank >= 0, np.diff(self.first, append=0)[self.rank], 0)

    def list_of(self, word: int) -> np.ndarray:
        r = self.rank[word]
        return self.positions[self.first[r]:self.first[r + 1]]

    def phrase(self, words: np.ndarray) -> np.ndarray:
        """Where the phrase begins, each time within one document."""
        order = np.argsort(self.many[words], kind="stable")
        if not self.many[words[order[0]]]:
            return np.zeros(0, np.int64)
        begins = self.list_of(words[order[0]]).astype(np.int64) - order[0]
        for k in order[1:]:
            there = self.list_of(words[k])
            at = np.searchsorted(there, begins + k)
            begins = begins[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == begins + k)]
            if not len(begins):
                return begins
        ends = np.searchsorted(self.starts, begins + len(words) - 1, "right")
        return begins[(begins >= 0) & (np.searchsorted(self.starts, begins, "right") == ends)]

    def near(self, words: np.ndarray, slack: int) -> list[tuple[int, int]]:
        """Spans (begin, end) that hold the words in order with at most ``slack`` others between them: from
        each place of the rarest word, the nearest next word on either side, which spans the least."""
        rarest = int(np.argmin(self.many[words]))
        if not self.many[words].all():
            return []
        spans = []
        for p in map(int, self.list_of(words[rarest])):
            doc = np.searchsorted(self.starts, p, "right") - 1
            low, high = self.starts[doc], self.starts[doc + 1]
            begin = end = p
            for k in range(rarest - 1, -1, -1):
                there = self.list_of(words[k])
                at = np.searchsorted(there, begin) - 1
                begin = int(there[at]) if at >= 0 else -1
                if begin < low:
                    break
            for k in range(rarest + 1, len(words)):
                if begin < low:
                    break
                there = self.list_of(words[k])
                at = np.searchsorted(there, end, "right")
                end = int(there[at]) if at < len(there) else high
                if end >= high:
                    break
            if low <= begin and end < high and end - begin + 1 <= len(words) + slack:
                spans.append((begin, end + 1))
        return spans


def _search(index: DataFrame, phrases: list[tuple[str, list[bytes]]], schema: str, answer) -> DataFrame:
    """``answer(segment, phrases)`` of every segment, the phrases given as (item, word numbers)."""
    number = defaultdict(count().__next__)
    coded = [(item, np.array([number[w] for w in words], np.int64)) for item, words in phrases]
    vocabulary = list(number)
    sent = index.sparkSession.sparkContext.broadcast((coded, vocabulary))   # at most BLOCK_PHRASES phrases
    index.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = sent.value
        words = np.concatenate([w for _, w in asked]) if asked else np.zeros(0, np.int64)
        begins = np.cumsum([0, *(len(w) for _, w in asked)])[:-1]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, known)
                whole = np.minimum.reduceat(segment.many[words], begins) if asked else []
                yield answer(segment, [asked[i] for i in np.flatnonzero(whole)])

    return index.mapInArrow(search, schema)


def windows(items: Iterable[tuple[str, str | None]], size: int) -> list[tuple[str, list[bytes]]]:
    """Each different window of each item; an item of fewer words is one window, one of none has none."""
    found = {}
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            found[item, tuple(words[k:k + size])] = None
    return [(item, list(words)) for item, words in found]


def phrase_spans(index: DataFrame, phrases: list[tuple[str, list[bytes]]]) -> DataFrame:
    """Exact occurrences, one row for each document: segment and at (its place there), doc_id, n_words, spans
    (begin and end in words, merged where they meet) and items; both are empty where nothing occurs."""
    schema = "segment long, at int, doc_id long, n_words long, spans array<array<int>>, items array<string>"

    def answer(segment: Segment, asked) -> pa.RecordBatch:
        begins, lengths, items = [], [], []
        for item, words in asked:
            if len(at := segment.phrase(words)):
                begins.append(at)
                lengths.append(np.full(len(at), len(words)))
                items += [item] * len(at)
        docs, n = len(segment.doc_ids), np.diff(segment.starts)
        spans, names = [[] for _ in range(docs)], [set() for _ in range(docs)]
        if begins:
            begin, length = np.concatenate(begins), np.concatenate(lengths)
            doc = np.searchsorted(segment.starts, begin, "right") - 1
            for k in np.lexsort((begin, doc)):
                d, a = doc[k], int(begin[k] - segment.starts[doc[k]])
                b = a + int(length[k])
                names[d].add(items[k])
                if spans[d] and spans[d][-1][1] >= a:
                    spans[d][-1][1] = max(spans[d][-1][1], b)
                else:
                    spans[d].append([a, b])
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([segment.number] * docs, pa.int64()), "at": pa.array(range(docs), pa.int32()),
            "doc_id": pa.array(segment.doc_ids, pa.int64()), "n_words": pa.array(n, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            "items": pa.array([sorted(x) for x in names], pa.list_(pa.string()))})

    return _search(index, phrases, schema, answer)


def proximity_spans(index: DataFrame, phrases: list[tuple[str, list[bytes]]], slack: int) -> DataFrame:
    """Phrases whose words stand in order with at most ``slack`` others between: doc_id, item_id, begin, end
    (in words of the document), one row for each different span."""
    schema = "doc_id long, item_id string, begin int, end int"

    def answer(segment: Segment, asked) -> pa.RecordBatch:
        rows = {}
        for item, words in asked:
            for begin, end in segment.near(words, slack):
                d = int(np.searchsorted(segment.starts, begin, "right")) - 1
                rows[d, item, begin - int(segment.starts[d]), end - int(segment.starts[d])] = None
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([segment.doc_ids[d] for d in columns[0]], pa.int64()),
            "item_id": pa.array(columns[1], pa.string()), "begin": pa.array(columns[2], pa.int32()),
            "end": pa.array(columns[3], pa.int32())})

    return _search(index, phrases, schema, answer)


def item_blocks(benchmark: DataFrame, window: int, *, item_id: str = "item_id",
                text: str = "text") -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's windows in blocks, however large it is: the driver holds one block at a time."""
    rows = columns_of(benchmark, item_id=item_id, text=text).where("text is not null")
    block = []
    for row in rows.withColumn("item_id", F.col("item_id").cast("string")).toLocalIterator():
        block += windows([(row.item_id, row.text)], window)
        if len(block) >= BLOCK_PHRASES:
            yield block
            block = []
    if block:
        yield block


def joined(answers: list[DataFrame]) -> DataFrame:
    """The answers of several blocks of phrases as one; a document's spans of different blocks may overlap."""
    parts = answers[0]
    for more in answers[1:]:
        parts = parts.unionAll(more)
    rows = parts.groupBy("segment", "at", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # In order, a span either goes on from the one before it or begins a new one.
    meet = F.aggregate("spans", F.array().cast("array<array<int>>"), lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)[1] >= s[0]),
        F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.array(
            F.element_at(out, -1)[0], F.greatest(F.element_at(out, -1)[1], s[1])))))
        .otherwise(F.concat(out, F.array(s))))
    return rows.withColumn("spans", meet)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    Words, windows and hits are those of whole texts. A document is contaminated if at least one in ``share``
    of its words lies in an occurrence of a window. Null texts have no words; ties and repeated rows are
    answered row by row; an empty benchmark hits nothing. Items without an id count as the item "".
    """
    index = cut_lineage(build_index(documents))
    items = benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    answers = [phrase_spans(index, block) for block in item_blocks(items, window)] or [phrase_spans(index, [])]
    found = joined(answers) if len(answers) > 1 else answers[0]
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return (found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
            .select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                    "spans", "items"))
