"""Language identification with hyperdimensional profiles.

Every letter of every script has a random vector of signs, drawn from its code point. Three neighbouring letters are
bound into one vector by multiplying the first one's vector moved by two places, the second one's moved by one, and
the third one's; signs are bits here, so that a product is an exclusive or and a place is a byte of eight of them.
A text is the sum of the vectors of its n-grams, a language the sum of its texts, and a text's language the
one whose sum has the largest cosine with it.
"""

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import columns_of, id_remainder, small_batches

DIMENSIONS = 1024
UNKNOWN = "und"
#: n-grams, or places of a text, whose vectors are held at once; block of characters looked at together.
CHUNK, BLOCK = 4096, 1 << 20
#: Least number of letters, cubed, from which n-grams are sorted and not marked in a table.
TABLE = 1 << 22
#: An n-gram is added place by place if it stands in a block fewer times than one in so many texts of it.
RARE = 32


@functools.cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_bits(points: np.ndarray) -> np.ndarray:
    """The vector of each code point, as 64-bit words; 0 stands for whatever is no letter. The words are a counter's
    values, mixed until every bit depends on all of it."""
    words = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64)
    x = (points.astype(np.uint64)[:, None] << np.uint64(8)) + words + np.uint64(2024 << 32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of some texts. An n-gram is a letter with its neighbours; whatever stands between two words, or
    texts, counts as one sign. ``codes`` are the different ones as numbers of three letters, ``number`` and ``of``
    say which n-gram stands where, and in which text."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        of = np.cumsum(points == 10, dtype=np.int32)
        letters = np.where(is_letter()[points], points, 0)
        keep = (letters > 0) | (np.concatenate([[1], letters[:-1]]) > 0) if len(letters) else letters > 0
        letters, of = np.concatenate([[0], letters[keep], [0]]), of[keep]
        used = np.zeros(0x110000, bool)
        used[letters] = True
        alphabet = np.flatnonzero(used)
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        letters, n = place[letters], len(alphabet)
        at = letters[1:-1] > 0
        code = ((letters[:-2] * n + letters[1:-1]) * n + letters[2:])[at]
        self.texts, self.of = len(texts), of[at]
        if n ** 3 <= TABLE:
            seen = np.zeros(n ** 3, bool)
            seen[code] = True
            self.codes = np.flatnonzero(seen)
            self.number = (np.cumsum(seen, dtype=np.int32) - 1)[code]
        else:
            self.codes, self.number = np.unique(code, return_inverse=True)
        self.n, self.moved = n, [np.roll(letter_bits(alphabet).view(np.uint8), k, axis=1).view(np.uint64)
                                 for k in (2, 1, 0)]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, one byte for each place: 1 for a minus sign."""
        first, second, third = self.moved
        mixed = first[codes // self.n ** 2] ^ second[codes // self.n % self.n] ^ third[codes % self.n]
        return np.unpackbits(mixed.view(np.uint8), axis=1)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the vectors of each text's n-grams, and how many it has. What stands often is multiplied,
        what is rare is added place by place; both hold the vectors of CHUNK n-grams at most."""
        minus = np.zeros((self.texts, DIMENSIONS))
        lengths = np.bincount(self.of, minlength=self.texts)
        often = np.bincount(self.number, minlength=len(self.codes)) * RARE >= self.texts
        chosen = np.flatnonzero(often)
        rank = np.cumsum(often) - 1
        common = often[self.number]
        order = rank[self.number[common]]
        turn = np.argsort(order // CHUNK, kind="stable")
        order, of = order[turn], self.of[common][turn]
        cuts = np.searchsorted(order // CHUNK, np.arange(-(-len(chosen) // CHUNK) + 1))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            some = chosen[k * CHUNK:(k + 1) * CHUNK]
            counts = np.bincount(of[a:b].astype(np.int64) * len(some) + order[a:b] - k * CHUNK,
                                 minlength=self.texts * len(some)).reshape(self.texts, len(some))
            minus += counts.astype(np.float32) @ self.bits(self.codes[some]).astype(np.float32)
        rare, of = self.number[~common], self.of[~common]
        for a in range(0, len(rare), CHUNK):
            texts, begins = np.unique(of[a:a + CHUNK], return_index=True)
            minus[texts] += np.add.reduceat(self.bits(self.codes[rare[a:a + CHUNK]]), begins, axis=0, dtype=np.int32)
        return lengths[:, None] - 2 * minus, lengths


def _blocks(texts: list, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def bundles(documents: DataFrame) -> DataFrame:
    """The sum of the n-gram vectors of each language: lang, dim, value. Each task sends its own sums only."""
    small_batches(documents.sparkSession)

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in _blocks(texts):
                total, _ = Block(texts[a:b]).sums()
                names = sorted(set(langs[a:b]))
                by = np.zeros((len(names), DIMENSIONS))
                np.add.at(by, np.searchsorted(names, langs[a:b]), total)
                for name, row in zip(names, by, strict=True):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * DIMENSIONS, "dim": pa.array(range(DIMENSIONS), pa.int32()),
                                              "value": pa.array(np.rint(row).astype(np.int64))})

    rows = columns_of(documents, text="text", lang="lang").where("lang is not null and text is not null")
    return (rows.mapInArrow(bundle, "lang string, dim int, value long")
            .groupBy("lang", "dim").agg(F.sum("value").alias("value")))


def prototypes(sums: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names and unit vectors; as many rows reach the driver as there are languages and places."""
    rows = sums.collect()
    names = sorted({r.lang for r in rows})
    vectors = np.zeros((len(names), DIMENSIONS))
    number = {name: k for k, name in enumerate(names)}
    for r in rows:
        vectors[number[r.lang], r.dim] = r.value
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    names = [n for n, x in zip(names, norms[:, 0], strict=True) if x > 0]
    return names, (vectors[norms[:, 0] > 0] / norms[norms[:, 0] > 0]).astype(np.float32)


def identify(texts: list[str | None], names: list[str], vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each text's language and its cosine with it, not below 0. A text without letters is UNKNOWN, 0."""
    sums, lengths = Block(texts).sums()
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    norms = np.linalg.norm(sums, axis=1)
    cosine = sums @ vectors.T / np.maximum(norms, 1e-9)[:, None]
    best = cosine.argmax(axis=1)
    has = lengths > 0
    return ([names[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)],
            np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0))


def language_ids(documents: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine, 0 to 1).

    Languages are learnt from all texts with a non-null lang whose id's remainder is not ``held``; a prediction
    uses the whole text and nothing else. A text that is null or has no letter is "und", 0, and so is every
    text if no language was learnt. Of equal cosines the first name wins; rows that repeat are answered each.
    """
    seen = documents.where(id_remainder(F.col("doc_id"), modulus) != held)
    names, vectors = prototypes(bundles(seen))

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [], [np.zeros(0)]
            for a, b in _blocks(texts):
                some, cosines = identify(texts[a:b], names, vectors)
                langs += some
                scores.append(cosines)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                              "lang_pred": pa.array(langs, pa.string()),
                                              "score": pa.array(np.concatenate(scores).astype(np.float64))})

    rows = columns_of(documents, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(answer, f"doc_id {kind}, lang_pred string, score double")
            .select("doc_id", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "lang_pred", "score"))
