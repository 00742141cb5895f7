"""Repeated passages by MinHash banding of paragraphs.

A paragraph is a line, and a line of several sentences is as many paragraphs as it has sentences of some
length, so that a passage is found wherever it was pasted. Paragraphs of equal words are one; the different
ones are banded for high recall, those that collide are verified by their exact Jaccard similarity, and what
is connected is one class. Long paragraphs are cut into pieces as well, behind words whose hash says so: a passage
pasted between two marks has the same cuts everywhere, and its pieces are classes if they are equal. Of a class
that stands in several documents, the first document keeps it. In the others, neighbouring repeated paragraphs
and pieces form passages, which go if they are long enough.
"""

import bisect
import functools
import itertools
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import LOWER_BYTES, columns_of, components, small_batches
from rigbook.llm.similarity import (band_keys, bits_of, buckets, distinct_counts, in_units, linked_pair, maybe_in,
                                    other_side, shingle_sets, shingles, signatures, similar, spanning)
from rigbook.session import cut_lineage

SHINGLE, PERCENT = 5, 80
#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8**2)**6, about 0.2 %; equal ones always do.
BANDS, BAND_ROWS = 6, 2
#: Words below which a sentence goes with the next one of its line.
SENTENCE_WORDS = 5
#: Words above which a paragraph is cut into pieces too: of a passage of over 50 words, shorter ones at its ends leave half.
LONG_WORDS = 24
#: Least words of a piece, and the share of words behind which it may end: 8 words on average.
PIECE_WORDS, PIECE_RATE = 4, 4
#: Shingles below which no set is similar to another without being equal.
LEAST = PERCENT // (100 - PERCENT)
#: Words from which neighbouring repeated paragraphs are a passage, unless the caller says otherwise: half of the 50
#: words that make a passage, as one that begins and ends inside paragraphs is seen without its ends.
PASSAGE_WORDS = 25
BLOCK = 512
#: So many paragraphs a task remembers to have sent, before it starts afresh.
REMEMBERED = 500_000

#: What lies between words, as bytes.split has it.
BLANKS = " \t\n\r\x0b\x0c"
#: A sentence or a line ends behind it. One set of first letters, which re looks for without trying the pattern everywhere.
_BREAKS = re.compile(r"[.!?\n](?:(?<=\n)|(?=\s))").finditer


@functools.cache
def _next_words(n: int):
    """Matches so many words with the blanks before them."""
    return re.compile(rf"(?:[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+){{{n}}}").match


PARAGRAPHS = "row long, doc_id long, at int, begin int, end int, n_words int, digest long, words binary"


def pieces_of(text: str, begin: int, end: int, words: list[bytes], single: bool) -> Iterator[
        tuple[int, int, int, list[bytes]]]:
    """(begin, end, number of the first word, words) of the pieces of a long paragraph, which fill it. ``single`` says
    that the paragraph is ASCII and has one blank between any two words, so that places follow from lengths."""
    first, last = 0, len(words) - 1
    marks = [k for k, word in enumerate(words) if not crc32(word) % PIECE_RATE]
    marks.append(last)
    if single:      # the end of the word before a piece; of the first, as if a blank were before the paragraph
        before = end - len(text[begin:end].lstrip(BLANKS)) - 1
    for k in marks:
        if k < last and k < first + PIECE_WORDS - 1:
            continue
        part = words[first:k + 1]
        if single:
            before += sum(map(len, part)) + len(part)
        cut = end if k == last else before if single else skipped(text, begin, len(part))
        yield begin, cut, first, part
        if k == last:
            return
        begin, first = cut, k + 1


def skipped(text: str, begin: int, n: int) -> int:
    """Where the n-th word from a place on ends."""
    while n > 0:
        begin = _next_words(min(n, 64))(text, begin).end()
        n -= 64
    return begin


def paragraphs_of(text: str | None) -> Iterator[tuple[int, int, int, list[bytes], bool]]:
    """(begin, end, number of the first word, words, is whole) of each paragraph, and of each piece of long ones. Places
    are in characters, and those of paragraphs follow each other without a gap; words lie between blanks, A-Z
    lower-cased."""
    text = text or ""
    begin = at = 0
    size = len(text)
    for cut in [*(found.end() for found in _BREAKS(text)), size]:
        whole = text[begin:cut].encode().translate(LOWER_BYTES)
        words = whole.split()
        if words and (len(words) >= SENTENCE_WORDS or cut == size or text[cut - 1] == "\n"):
            yield begin, cut, at, words, True
            if len(words) > LONG_WORDS:
                single = len(whole) == cut - begin and len(whole.strip()) == sum(map(len, words)) + len(words) - 1
                for a, b, first, part in pieces_of(text, begin, cut, words, single):
                    yield a, b, at + first, part, False
            begin, at = cut, at + len(words)


def paragraphs(documents: DataFrame) -> DataFrame:
    """All paragraphs and pieces with their digests; narrow. Null texts and null ids have none. ``row`` numbers the
    rows in the order of reading, ``at`` the words of a text.

    ``words`` holds the words of paragraphs that can be like others without being equal, and is null elsewhere:
    sets of fewer than five shingles are only ever similar from 80 % on if one has five, so all that can have
    four have it. Within a task the words of a digest are given once while it is remembered.
    """
    small_batches(documents.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            counts, places, digests, sending = [], [], [], []
            for text in batch.column("text").to_pylist():
                before = len(digests)
                for begin, end, at, words, whole in paragraphs_of(text):
                    joined = b" ".join(words)
                    node, n_words = xxhash.xxh3_64_intdigest(joined), len(words)
                    places += (at, begin, end, n_words)
                    digests.append(node)
                    if whole and n_words >= SHINGLE + LEAST - 1 and node not in sent:
                        sending.append(joined)
                        sent.add(node)
                    else:
                        sending.append(None)
                counts.append(len(digests) - before)
            if len(sent) > REMEMBERED:
                sent.clear()
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            by_place = np.array(places, np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(of) for c in ("row", "doc_id")),
                 *(pa.array(np.ascontiguousarray(by_place[:, k])) for k in range(4)),
                 pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sending, pa.binary())],
                names=["row", "doc_id", "at", "begin", "end", "n_words", "digest", "words"])

    rows = numbered(documents).where("doc_id is not null and text is not null")
    return rows.mapInArrow(cut, PARAGRAPHS)


def numbered(documents: DataFrame) -> DataFrame:
    """row, doc_id and text of all rows; the row is its number in the order of reading."""
    return (columns_of(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
            .withColumn("row", F.monotonically_increasing_id()))


def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (node, key) for each band of each paragraph; neither keys nor shingles are stored."""
    for batch in batches:
        found = shingles([w.split() for w in batch.column("words").to_pylist()], SHINGLE)
        enough = distinct_counts(found) >= LEAST
        # A shingle that stands twice changes no minimum.
        keys = band_keys(signatures(list(itertools.compress(found, enough)), BANDS * BAND_ROWS), BAND_ROWS)
        node = batch.column("node").to_numpy(zero_copy_only=False)[enough]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS), pa.int64()),
                                          pa.array(keys.ravel(), pa.int64())], names=["node", "key"])


def shared_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and node, the different ones whose key another node has as well."""
    def rows(node: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(key, pa.int64())], names=["node", "key"])

    node = key = np.zeros(0, np.int64)      # the last row, which waits for the next one
    shares = False                          # the row before it has its key
    for batch in batches:
        node = np.concatenate([node, batch.column("node").to_numpy(zero_copy_only=False)])
        key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        node, key = node[new], key[new]
        same = key[1:] == key[:-1]
        before = np.concatenate([[shares], same])
        out = (before[:-1] | same)
        yield rows(node[:-1][out], key[:-1][out])
        node, key, shares = node[-1:], key[-1:], bool(before[-1])
    if shares:
        yield rows(node, key)


def paragraph_links(paragraphs: DataFrame) -> DataFrame:
    """Links (a, b) between digests of paragraphs that are similar but not equal."""
    rows = paragraphs.where("words is not null").select(F.col("digest").alias("node"), "words")
    # One shuffle: each task sends a paragraph once, and with the keys in order one look at the neighbours
    # tells which keys different paragraphs share, in constant memory.
    members = rows.mapInArrow(banded, "node long, key long")
    shared = cut_lineage(members.repartition("key").sortWithinPartitions("key", "node")
                         .mapInArrow(shared_keys, "node long, key long"))
    # Few paragraphs share a key: a Bloom filter keeps most others out of the words' shuffle, and the join
    # decides. Over too many nodes the filter lets everything through, and the result stays the same.
    filled = rows.sparkSession.sparkContext.broadcast(bits_of(shared.select("node")))   # 16 MB at every size

    def possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(filled.value, batch.column("node").to_numpy())))

    words = (rows.mapInArrow(possible, rows.schema).join(shared.select("node").distinct(), "node")
             .groupBy("node").agg(F.first("words").alias("words")))
    units = buckets(shared, BLOCK).join(words, "node")

    def verify(unit: dict[str, list]) -> list[tuple]:
        if len(unit["node"]) == 2:      # as most units are
            return linked_pair(unit["node"], [w.split() for w in unit["words"]], SHINGLE, PERCENT)
        sets = shingle_sets([w.split() for w in unit["words"]], SHINGLE)
        return spanning(unit["node"], other_side(unit["side"], similar(sets, PERCENT)))

    return in_units(units, verify, ["node", "side", "words"], "a long, b long")


def repeated_paragraphs(documents: DataFrame) -> DataFrame:
    """Paragraphs whose class stands in several documents: their columns, class_id and first_doc."""
    found = cut_lineage(paragraphs(documents))
    rows = found.drop("words")
    classes = cut_lineage(components(paragraph_links(found)))
    seen = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    by_class = seen.join(classes, seen.digest == classes.node, "left").select(
        "digest", F.coalesce("component", "digest").alias("class_id"), "low", "high",
        F.col("component").isNotNull().alias("linked"))
    by_class = cut_lineage(by_class.where("linked or low <> high"))
    spread = (by_class.groupBy("class_id").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc"))
              .where("first_doc <> last_doc").select("class_id", "first_doc"))
    return rows.join(by_class.select("digest", "class_id").join(spread, "class_id"), "digest")


Stretch = tuple[int, int, int, int, int, int]
"""Words from and to, characters from and to, class and first document of repeated text."""


def joined(stretches: Iterable[Stretch]) -> list[Stretch]:
    """What overlaps or follows without a gap becomes one, with the class and first document of its beginning."""
    out: list[Stretch] = []
    for x in sorted(stretches):
        if out and x[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], x[1]), last[2], max(last[3], x[3]), *last[4:])
        else:
            out.append(x)
    return out


def outside(stretch: Stretch, others: list[Stretch]) -> Iterator[Stretch]:
    """The parts of a stretch that none of the others, joined and in order, covers."""
    at, end, begin, stop, *rest = stretch
    k = bisect.bisect_right(others, at, key=lambda x: x[1])
    while at < end and k < len(others) and others[k][0] < end:
        if others[k][0] > at:
            yield at, others[k][0], begin, others[k][2], *rest
        at, begin = others[k][1], others[k][3]
        k += 1
    if at < end:
        yield at, end, begin, stop, *rest


def repeated_passages(documents: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row for each passage: row, doc_id, begin, end (in characters), n_words, class_id (of its first paragraph),
    first_doc (the first document that has it), removed (this is not the first document).

    A passage is a run of repeated paragraphs and pieces without anything between; runs of fewer than ``least_words``
    words are none. What goes and what the document keeps are passages of their own kinds; where both cover a
    word, it goes. Grouped by row, so a group is no larger than a text.
    """
    rows = repeated_paragraphs(documents)
    parts = rows.groupBy("row", "doc_id").agg(F.collect_list(F.struct(
        "at", "begin", "end", "n_words", "class_id", "first_doc")).alias("parts"))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            parts = batch.column("parts")
            # The fields of all rows at once: rows of a struct one by one are dear.
            found = list(zip(*(field.to_pylist() for field in parts.flatten().flatten()), strict=True))
            ends = np.cumsum(parts.value_lengths().to_numpy()).tolist()
            for row, key, a, b in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(),
                                      [0, *ends[:-1]], ends, strict=True):
                kinds: tuple[list[Stretch], list[Stretch]] = [], []
                for at, begin, end, n_words, class_id, first in found[a:b]:
                    kinds[first != key].append((at, at + n_words, begin, end, class_id, first))
                gone = joined(kinds[True])
                kept = joined(x for own in joined(kinds[False]) for x in outside(own, gone))
                out += [(row, key, begin, end, to - at, of, first, removed)
                        for runs, removed in ((gone, True), (kept, False))
                        for at, to, begin, end, of, first in runs if to - at >= least_words]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[
                "row", "doc_id", "begin", "end", "n_words", "class_id", "first_doc", "removed"])

    return parts.mapInArrow(join, "row long, doc_id long, begin int, end int, n_words long, class_id long, "
                                  "first_doc long, removed boolean")


def substring_dedup(documents: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document: doc_id, row (its number in the order of reading), n_passages, n_repeated and n_removed
    (words in repeated passages, and in those that an earlier document keeps), class_id and first_doc of its first
    passage, spans (what to remove).

    A null or empty text has no passage, nor has a null id. Rows that repeat an id count as one document
    whose paragraphs stand beside each other, so a passage in them alone is no repeat; each has the spans of its own
    text. Rows are told apart by their number, so ``documents`` should be a stored table.
    """
    spot = F.struct("begin", "end", "class_id", "first_doc")
    by_row = repeated_passages(documents, least_words).groupBy("row").agg(
        F.count("*").alias("n_passages"), F.sum("n_words").alias("n_repeated"),
        F.sum(F.when(F.col("removed"), F.col("n_words")).otherwise(0)).alias("n_removed"), F.min(spot).alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("removed"), F.struct("begin", "end")))).alias("spans"))
    return (numbered(documents).select("doc_id", "row").join(by_row, "row", "left")
            .select("doc_id", "row", *(F.coalesce(c, F.lit(0).cast("long")).alias(c)
                                       for c in ("n_passages", "n_repeated", "n_removed")),
                    F.col("first.class_id").alias("class_id"), F.col("first.first_doc").alias("first_doc"),
                    F.coalesce("spans", F.array().cast("array<struct<begin: int, end: int>>")).alias("spans")))


def without_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with their spans cut out of the text; all other columns stay."""
    named = found.where("size(spans) > 0").select(F.col("row").alias("_of"), F.col("spans").alias("_spans"))
    kept = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda s, x: F.struct(
        F.concat(s["out"], F.col("text").substr(s["at"] + 1, x["begin"] - s["at"])).alias("out"),
        x["end"].alias("at")), lambda s: F.concat(s["out"], F.col("text").substr(s["at"] + 1, F.length("text"))))
    rows = documents.withColumn("_row", F.monotonically_increasing_id())
    return (rows.join(named, rows["_row"] == named["_of"], "left")
            .withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept))
            .drop("_row", "_of", "_spans"))
