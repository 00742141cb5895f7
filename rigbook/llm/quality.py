"""A quality classifier learnt from preference pairs (Bradley-Terry).

A document's strength is a weighted sum of text statistics. Of two labelled documents the better one should
win with the logistic probability of the difference of their strengths; weights minimise that loss over pairs
of one good and one poor document, of which all count. The threshold is a quantile of the strengths of labelled
documents.
"""

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigbook.llm.common import columns_of, id_remainder, small_batches
from rigbook.session import cut_lineage

#: Cells of strengths, for each kind, in which pairs are counted; cells in which ranks are looked up.
CELLS, FINE = 128, 4096
#: Passes over the labelled documents at most, the step that counts as none, and the weight of small weights.
PASSES, STILL, RIDGE = 40, 1e-4, 1e-3

FEATURES = ("long", "empty", "upper", "digits", "signs", "letters", "marks", "bars", "shouts", "repeats", "twins",
            "distinct", "packed", "word", "line", "same_line", "glued")

_SIGNS = bytes.maketrans(bytes(range(256)), bytes(
    1 if 97 <= b < 123 or b >= 128 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 if b in (9, 10, 13, 32)
    else 5 if b in b".,;:'\"-()?" else 6 for b in range(256)))
_GLUED = re.compile(rb"[A-Za-z\x80-\xff][^\sA-Za-z0-9\x80-\xff]{2,}(?=\s|$)").findall


def features(text: str | None) -> list[float]:
    """The statistics of a whole text, each between about 0 and 1."""
    raw = (text or "").encode()
    if not raw.strip():
        return [0.0, 1.0, *[0.0] * (len(FEATURES) - 2)]
    kinds = np.bincount(np.frombuffer(raw.translate(_SIGNS), np.uint8), minlength=7)
    shown = max(1, len(raw) - int(kinds[4]))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    letters = max(1, int(kinds[1] + kinds[2]))
    return list(map(float, (
        min(1.0, np.log1p(len(raw)) / 12), 0.0, kinds[2] / letters, kinds[3] / shown, kinds[6] / shown,
        letters / shown, kinds[5] / shown, min(1.0, 4 * words.count(b"|") / n), min(1.0, 4 * raw.count(b"!") / n),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 0.0,
        len(set(words)) / n, min(1.0, len(zlib.compress(raw, 1)) / len(raw)), min(1.0, shown / n / 20),
        min(1.0, n / max(1, len(lines)) / 100), 1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(_GLUED(raw)) / n))))


def described(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id and the features of each document as an array, and ``row`` if that names a column; narrow. A null
    text is an empty one."""
    small_batches(documents.sparkSession)
    carried = {"row": row} if row else {}

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", *carried)} | {
                "features": pa.array(found, pa.list_(pa.float64()))})

    rows = columns_of(documents, doc_id=doc_id, text=text, **carried)
    return rows.mapInArrow(describe, kinds_of(rows, "doc_id", *carried) + ", features array<double>")


def kinds_of(rows: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)


def labelled(described_rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The rows to learn from: all whose id has a label; of several labels of an id the largest."""
    known = columns_of(labels, doc_id="doc_id", y=label).where("y is not null and doc_id is not null")
    return described_rows.join(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))


#: What a pass makes of some rows (features, labels): numbers to be added up, and numbers of which the least counts.
Partial = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def over_all(rows: DataFrame, partial: Partial) -> tuple[np.ndarray, np.ndarray]:
    """A partial result for all rows (features, y): folded by each task, then by Spark, number by number."""
    sums, lows = partial(np.zeros((0, len(FEATURES))), np.zeros(0))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = sums.copy(), lows.copy()
        for batch in batches:
            more, low = partial(matrix(batch), batch.column("y").to_numpy(zero_copy_only=False))
            total += more
            np.minimum(least, low, out=least)
        at = np.flatnonzero(np.concatenate([total != 0, least < np.inf]))
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int32()),
                                          "v": pa.array(np.concatenate([total, least])[at], pa.float64())})

    got = rows.mapInArrow(fold, "k int, v double").groupBy("k").agg(
        F.sum("v").alias("total"), F.min("v").alias("least")).toArrow()
    at = got.column("k").to_numpy()
    added = at < len(sums)
    sums[at[added]] = got.column("total").to_numpy()[added]
    lows[at[~added] - len(sums)] = got.column("least").to_numpy()[~added]
    return sums, lows


class Strengths:
    """Standardised features, their weights, and where the strength's threshold lies.

    All pairs of a good and a poor document count. Their loss and its slopes need of each document only its strength's
    cell: cells are narrow, and a cell stands at the mean strength of its documents, whose spread there is minded.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self._learn(lambda partial: partial(x, y))

    @classmethod
    def of(cls, rows: DataFrame) -> "Strengths":
        """Learnt from a stored table (features, y), which is read once for each pass; only sums reach the driver."""
        model = cls.__new__(cls)
        model._learn(lambda partial: over_all(rows, partial))
        return model

    def _learn(self, total: Callable[[Partial], tuple[np.ndarray, np.ndarray]]) -> None:
        width = len(FEATURES)
        sums, _ = total(lambda x, y: (np.concatenate([
            [len(x), (y == 1).sum(), (y == 0).sum()], x.sum(axis=0), (x * x).sum(axis=0)]).astype(float), np.zeros(0)))
        n, n_good, n_poor = map(int, sums[:3])
        # Rounded, as sums differ in their last digits with the order in which tasks end.
        self.middle = np.round(sums[3:3 + width] / max(1, n), 9)
        self.spread = np.ones(width)
        if n:
            variance = np.maximum(sums[3 + width:] / n - (sums[3:3 + width] / n) ** 2, 0)
            self.spread = np.maximum(np.round(np.sqrt(variance), 9), 1e-3)
        self.weights, self.threshold, self.scale = np.zeros(width), 0.0, 1.0
        if not n_good or not n_poor:
            self.threshold = -1.0 if n_good or not n_poor else 1.0    # one kind only: all are of that kind
            return
        self._minimise(total)
        self._place(total, n, n_poor)

    def _minimise(self, total) -> None:
        """Newton's method; a step that makes the loss larger is halved."""
        width = len(FEATURES)
        one, other = np.triu_indices(width)
        self.mean, self.cover = np.zeros(width), np.eye(width)    # of the standardised features
        weights, step, best = np.zeros(width), np.zeros(width), np.inf
        for _ in range(PASSES):
            tried = weights + step
            at, per = self._centre(tried)

            def moments(x, y):
                z = self.standard(x)
                cell = np.floor(CELLS / (1 + np.exp(-np.clip((z @ tried - at) / per, -30, 30)))).astype(int)
                slot = np.where(y == 1, CELLS, 0) + np.clip(cell, 0, CELLS - 1)
                some = (y == 0) | (y == 1)
                found = np.hstack([np.ones((len(z), 1)), z, z[:, one] * z[:, other]])
                return (np.eye(2 * CELLS)[slot[some]].T @ found[some]).ravel(), np.zeros(0)

            sums = total(moments)[0].reshape(2, CELLS, -1)
            poor, good = (kind[kind[:, 0] > 0] for kind in sums)
            shares = [kind[:, 0] / kind[:, 0].sum() for kind in (poor, good)]
            means = [kind[:, 1:1 + width] / kind[:, :1] for kind in (poor, good)]
            squares = [np.zeros((len(kind), width, width)) for kind in (poor, good)]
            for kind, square in zip((poor, good), squares, strict=True):
                square[:, one, other] = square[:, other, one] = kind[:, 1 + width:] / kind[:, :1]
            ahead = (means[1] @ tried)[:, None] - (means[0] @ tried)[None]    # good by poor
            lost = shares[1][:, None] * shares[0][None] / (1 + np.exp(np.clip(ahead, -30, 30)))
            bent = lost / (1 + np.exp(-np.clip(ahead, -30, 30)))
            # What the spread within the cells adds: how strength goes with the features there.
            inside = sum(of @ (square @ tried - (mean @ tried)[:, None] * mean) for of, square, mean in zip(
                (bent.sum(axis=0), bent.sum(axis=1)), squares, means, strict=True))
            loss = (shares[1] @ np.logaddexp(0, -ahead) @ shares[0] + (inside + RIDGE * tried) @ tried / 2)
            if loss > best:
                step = step / 2
                if np.abs(step).max() < STILL:
                    break
                continue
            weights, best = tried, loss
            gradient = lost.sum(axis=0) @ means[0] - lost.sum(axis=1) @ means[1] + inside + RIDGE * weights
            crossed = means[1].T @ bent @ means[0]
            curvature = (np.tensordot(bent.sum(axis=1), squares[1], 1) + np.tensordot(bent.sum(axis=0), squares[0], 1)
                         - crossed - crossed.T + RIDGE * np.eye(width))
            step = -np.linalg.solve(curvature, gradient)
            if np.abs(step).max() < STILL:
                break
            every = sums.sum(axis=(0, 1))
            self.mean, square = every[1:1 + width] / every[0], np.zeros((width, width))
            square[one, other] = square[other, one] = every[1 + width:] / every[0]
            self.cover = square - np.outer(self.mean, self.mean)
        self.weights = np.round(weights, 6)

    def _centre(self, weights: np.ndarray) -> tuple[float, float]:
        """Middle and width of the logistic curve that is about the distribution of the strengths."""
        return float(self.mean @ weights), max(float(weights @ self.cover @ weights), 1e-18) ** 0.5 / 1.7

    def _profile(self, total, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, least and largest strength between the edges, of kinds 0, 1 and others."""
        size = len(edges) + 1

        def profile(x, y):
            strength = self.standard(x) @ self.weights
            slot = np.searchsorted(edges, strength, side="right") + size * np.where(y == 1, 1, np.where(y == 0, 0, 2))
            lows = np.full((2, 3 * size), np.inf)
            np.minimum.at(lows[0], slot, strength)
            np.minimum.at(lows[1], slot, -strength)
            return np.bincount(slot, minlength=3 * size).astype(float), lows.ravel()

        n, lows = total(profile)
        least, largest = lows.reshape(2, 3, size)
        return n.reshape(3, size).astype(int), least, -largest

    def _place(self, total, n: int, n_poor: int) -> None:
        """Threshold and scale. As many labelled documents fall below the quantile as are poor; of the two strengths
        around that place the threshold takes the middle of the widest gap nearby. A gap of less than a FINE-th of the
        strengths nearby may be passed over for one as narrow."""
        at, per = self._centre(self.weights)
        quantiles = np.arange(1, FINE) / FINE
        counts, least, largest = self._profile(total, at + per * np.log(quantiles / (1 - quantiles)))
        medians = []
        for kind in (0, 1):
            cell = np.searchsorted(np.cumsum(counts[kind]), counts[kind].sum() / 2)
            medians.append((least[kind, cell] + largest[kind, cell]) / 2)
        self.scale = max(float(medians[1] - medians[0]) / 8, 1e-6)
        near = max(3, n // 100)
        low, high = max(1, n_poor - near), min(n - 1, n_poor + near)
        first, last = np.searchsorted(np.cumsum(counts.sum(axis=0)), [low - 1, high], side="right")
        counts, least, largest = self._profile(
            total, np.linspace(least[:, first].min(), largest[:, last].max(), FINE))
        counts, least, largest = counts.sum(axis=0), least.min(axis=0), largest.max(axis=0)
        cells = np.flatnonzero(counts)
        below, bottom, top = np.cumsum(counts)[cells[:-1]], largest[cells[:-1]], least[cells[1:]]
        if not len(below):
            self.threshold = float(least[cells[0]])
            return
        nearby = (below >= low) & (below <= high)
        gap = np.argmax(np.where(nearby, top - bottom, -1)) if nearby.any() else np.argmin(np.abs(below - n_poor))
        self.threshold = float((bottom[gap] + top[gap]) / 2)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -5, 5)

    def scores(self, x: np.ndarray, at_threshold: float) -> np.ndarray:
        """Strengths brought to 0..1, with the threshold at the given score."""
        odds = (self.standard(x) @ self.weights - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(odds + np.log(at_threshold / (1 - at_threshold)), -30, 30)))


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5) -> Strengths:
    """Learn from all labelled documents whose id's remainder is not 0; ``rows`` are described documents."""
    usable = labels.where(id_remainder(F.col("doc_id"), modulus) != 0)
    return Strengths.of(cut_lineage(labelled(rows, usable, label).select("features", "y")))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, *,
                   row: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out (its id's remainder is 0), score (0 to 1), predicted (0 or 1).

    The score comes from the whole text alone. An empty or null text has a score like any other. A document
    with several labels counts by the largest; rows that repeat are scored each. Without labels, or with labels
    of one kind only, all are predicted to be of that kind (of kind 1 if there are none). ``row`` names a column
    that tells rows of one id apart; it comes back as ``row``.
    """
    rows = cut_lineage(described(documents, row=row))
    model = fit(rows, labels, modulus=modulus)
    kept = [c for c in rows.columns if c != "features"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {
                "score": pa.array(model.scores(matrix(batch), threshold))})

    return (rows.mapInArrow(score, kinds_of(rows, *kept) + ", score double")
            .select(*kept, (id_remainder(F.col("doc_id"), modulus) == 0).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
