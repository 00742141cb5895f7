"""Hard negatives by a secondary sort.

Anchors are scored against all rows in pairs of blocks. A pair's score becomes a key (anchor, descending score,
id), rows are dealt out by anchor and sorted within their partitions by that key, and one streaming pass opens a
window of scores at each positive and puts out the negatives that fall into the windows still open. An anchor's
rows are never gathered: the pass holds at most as many windows as an anchor has positives.

Before the shuffle each pair of blocks keeps only what can still count, and loses nothing by it: the best
positives of its rows first, and then, the windows being known, the best rows of each window.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigbook.session import cut_lineage

#: Anchors, and rows, that meet in one work unit. Anchors are held, rows stream past them.
ANCHOR_BLOCK, ROW_BLOCK = 4096, 1 << 17
#: Scores that are held at once.
SCORES = 1 << 21
#: Sums below this are exact in doubles; larger ones are worked out as whole numbers, and cut at a long's range.
EXACT, LONG = 2**53, 2**63 - 1

SCORED = "anchor long, score long, vec_id long, row long"


def quantised(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: str | Column) -> DataFrame:
    """row (a number of its own), vec_id, label, and floor(scale * x) of each component as doubles, for rows that
    take part: those with a label and a vector whose components are all finite numbers. Narrow."""
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # null becomes NaN
            whole = np.floor(scale * values)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
            fine = [k for k in range(len(ends) - 1) if odd[ends[k]] == odd[ends[k + 1]]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(fine, pa.int64())) for c in ("row", "vec_id", "label")),
                 pa.array([whole[ends[k]:ends[k + 1]].tobytes() for k in fine], pa.binary())],
                names=["row", "vec_id", "label", "vector"])

    known = rows.where("label is not null and vector is not null")
    return known.mapInArrow(cut, "row long, vec_id long, label long, vector binary")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones are filled up with zeros."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), width)
    return np.array([np.pad(x, (0, width - len(x))) for x in (np.frombuffer(v, "<f8") for v in vectors)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG).astype(np.int64)


class Best:
    """The best ``most`` columns of each row seen so far; of equal scores the earlier ones."""

    def __init__(self, rows: int, most: int):
        self.most = most
        self.least = np.full(rows, -LONG - 1)       # what a score must beat once a row is full
        self.of, self.score, self.value = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, at: np.ndarray, scores: np.ndarray, allowed: np.ndarray, values: np.ndarray) -> None:
        """Scores of rows ``at`` for columns with these values; only the allowed ones count."""
        allowed = allowed & (scores > self.least[at][:, None])
        of, column = np.nonzero(allowed)
        if scores.shape[1] > 4 * self.most and len(of) > 4 * self.most * len(at):
            # Most of a block's first scores lose at once: none below the block's own best few can stay.
            masked = np.where(allowed, scores, -LONG - 1)
            nth = np.partition(masked, -self.most, axis=1)[:, -self.most]
            of, column = np.nonzero(allowed & (scores >= nth[:, None]))
        if not len(of):
            return
        of_all = np.concatenate([self.of, at[of]])
        score_all = np.concatenate([self.score, scores[of, column]])
        value_all = np.concatenate([self.value, values[column]])
        order = np.lexsort((-score_all, of_all))    # stable, so that what came first stays first
        of_all, score_all, value_all = of_all[order], score_all[order], value_all[order]
        begins = np.flatnonzero(np.diff(of_all, prepend=-1))
        rank = np.arange(len(of_all)) - np.repeat(begins, np.diff(begins, append=len(of_all)))
        keep = rank < self.most
        self.of, self.score, self.value = of_all[keep], score_all[keep], value_all[keep]
        last = self.of[rank[keep] == self.most - 1]
        self.least[last] = self.score[rank[keep] == self.most - 1]


def units(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Anchors (with further columns) and rows, dealt out so that each anchor meets each row in one unit (i, j);
    in a unit the anchors come first, then the rows by id."""
    many, much = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))

    def block(of):
        return F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")

    def every(of):
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    extra = [c for c in anchors.columns if c not in rows.columns]
    left = anchors.select(block(many).alias("i"), F.lit(0).alias("side"), "*").select("*", every(much).alias("j"))
    right = rows.select(block(much).alias("j"), F.lit(1).alias("side"), "*").select("*", every(many).alias("i"))
    both = left.unionByName(right.withColumns({c: F.lit(None).cast(anchors.schema[c].dataType) for c in extra}))
    return both.repartition("i", "j").sortWithinPartitions("i", "j", "side", "vec_id", "row")


def in_units(dealt: DataFrame, begin, score, finish, schema: str) -> DataFrame:
    """A streaming pass over units: ``begin`` gets the columns of a unit's anchors, ``score`` the state and the
    columns of some rows after the other, ``finish`` the state; it returns a batch."""
    names = [c for c in dealt.columns if c not in ("i", "j", "side")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, state, held = None, None, {c: [] for c in names}
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side")), strict=True))
            columns = {c: batch.column(c).to_pylist() for c in names}
            at = 0
            while at < len(marks):
                end = at
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                if marks[at][:2] != unit:
                    if state is not None:
                        yield finish(state)
                    unit, state, held = marks[at][:2], None, {c: [] for c in names}
                part = {c: v[at:end] for c, v in columns.items()}
                if marks[at][2] == 0:
                    for c in names:
                        held[c] += part[c]
                elif held["row"]:
                    if state is None:
                        state = begin(held)
                    step = max(16, SCORES // len(held["row"]))
                    for k in range(0, end - at, step):
                        score(state, {c: v[k:k + step] for c, v in part.items()})
                at = end
        if state is not None:
            yield finish(state)

    return dealt.mapInArrow(run, schema)


def top_positives(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], width: int, positives: int) -> DataFrame:
    """anchor (its row), score, vec_id, row: the best rows of each anchor's own label, some for each block of rows."""
    def begin(held: dict) -> dict:
        label = np.array(held["label"], np.int64)
        return {"row": np.array(held["row"], np.int64), "label": label, "vectors": matrix(held["vector"], width),
                "best": Best(len(label), positives), "ids": [], "rows": []}

    def score(state: dict, part: dict) -> None:
        label, row = np.array(part["label"], np.int64), np.array(part["row"], np.int64)
        vectors, number = matrix(part["vector"], width), len(state["ids"]) + np.arange(len(row))
        state["ids"] += part["vec_id"]
        state["rows"] += part["row"]
        for one in np.intersect1d(label, state["label"]):
            at, to = np.flatnonzero(state["label"] == one), np.flatnonzero(label == one)
            scores = products(state["vectors"][at], vectors[to])
            state["best"].offer(at, scores, state["row"][at][:, None] != row[to], number[to])

    return in_units(units(anchors, rows, *sizes), begin, score, lambda state: _scored(state, state["row"]), SCORED)


def _scored(state: dict, anchor: np.ndarray) -> pa.RecordBatch:
    best = state["best"]
    return pa.RecordBatch.from_pydict({
        "anchor": pa.array(anchor[best.of], pa.int64()), "score": pa.array(best.score, pa.int64()),
        "vec_id": pa.array([state["ids"][k] for k in best.value], pa.int64()),
        "row": pa.array([state["rows"][k] for k in best.value], pa.int64())})


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest score that are at least ``low`` and at most ``high`` hundredths of a positive's."""
    return -(-low * score // 100), high * score // 100


def top_negatives(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], width: int, negatives: int,
                  low: int, high: int) -> DataFrame:
    """anchor, score, vec_id, row: the best rows of other labels in each window of each anchor, some for each block
    of rows. Anchors carry ``scores``, the scores of their positives."""
    def begin(held: dict) -> dict:
        of = [k for k, scores in enumerate(held["scores"]) for _ in set(scores)]
        bounds = [window(s, low, high) for scores in held["scores"] for s in sorted(set(scores), reverse=True)]
        label = np.array(held["label"], np.int64)
        return {"row": np.array(held["row"], np.int64), "label": label, "vectors": matrix(held["vector"], width),
                "of": np.array(of, np.int64), "bounds": np.array(bounds, np.int64).reshape(-1, 2),
                "best": Best(len(of), negatives), "ids": [], "rows": []}

    def score(state: dict, part: dict) -> None:
        label = np.array(part["label"], np.int64)
        vectors, number = matrix(part["vector"], width), len(state["ids"]) + np.arange(len(label))
        state["ids"] += part["vec_id"]
        state["rows"] += part["row"]
        scores = products(state["vectors"], vectors)
        other = state["label"][:, None] != label
        nth = np.arange(len(state["of"])) - np.searchsorted(state["of"], state["of"])
        for k in range(nth.max(initial=-1) + 1):
            at = np.flatnonzero(nth == k)
            some, (least, most) = scores[state["of"][at]], state["bounds"][at].T
            allowed = (some >= least[:, None]) & (some <= most[:, None]) & other[state["of"][at]]
            state["best"].offer(at, some, allowed, number)

    return in_units(units(anchors, rows, *sizes), begin, score,
                    lambda state: _scored(state, state["row"][state["of"]]), SCORED)


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, label: str | Column = "label", positives: int = 5,
                   negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, vec_id: str = "vec_id",
                   vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``. A row's score is the inner product of its components and the
    anchor's, each rounded down after multiplication with ``scale``. An anchor's positives are the first
    ``positives`` other rows of its label. For each of them come the first ``negatives`` rows of other labels with
    a score from ``low`` to ``high`` hundredths of the positive's. Higher scores are first, then smaller ids (null
    before all), then rows in the order they were read.

    Rows without label or vector, and rows with a component that is null or not finite, take no part. Repeated ids
    are rows of their own, as anchors too. Shorter vectors are filled up with zeros. A score outside a long's range
    becomes the nearest long. An empty table gives an empty one. The work is anchors times rows, in blocks; a label
    that most rows share is cut into blocks like any other, as blocks go by row.
    """
    all_rows = cut_lineage(quantised(vectors, scale, vec_id, vector, label))
    marked = all_rows.where(F.coalesce(is_anchor, F.lit(False)))
    seen = all_rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(is_anchor, F.lit(False))).alias("anchors"),
                        F.max(F.octet_length("vector")).alias("bytes")).first()
    sizes, width = (seen.anchors, seen.rows), (seen.bytes or 0) // 8

    found = top_positives(marked, all_rows, sizes, width, positives)
    # Limited per anchor before the shuffle as well, so what is gathered then are at most ``positives`` rows.
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    chosen = cut_lineage(found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives).drop("nth"))
    scores = chosen.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("scores"))
    offered = top_negatives(marked.join(scores, "row"), all_rows, sizes, width, negatives, low, high)

    # At one score the positive comes first: its window is open before negatives that may fall into it.
    keyed = chosen.withColumn("side", F.lit(0)).unionByName(offered.withColumn("side", F.lit(1)))
    ids = marked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    sorted_pairs = (keyed.withColumn("down", -F.col("score")).join(ids, "anchor")
                    .select("anchor", "down", "side", "vec_id", "row", "anchor_id")
                    .repartition("anchor").sortWithinPartitions("anchor", "down", "side", "vec_id", "row"))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, opened, last = None, [], None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "down", "side", "vec_id", "row", "anchor_id"))
            for of, down, side, key, row, anchor_id in zip(*columns, strict=True):
                if of != anchor:
                    anchor, opened, last = of, [], None
                if side == 0:
                    opened.append([key, -down, *window(-down, low, high), 0])
                elif row != last:                       # a row that several windows of a block offered
                    last = row
                    for each in opened:
                        if each[2] <= -down <= each[3] and each[4] < negatives:
                            each[4] += 1
                            out.append((anchor_id, each[0], each[4], key, each[1], -down))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=list(names))

    return sorted_pairs.mapInArrow(stream, "anchor_id long, positive_id long, rank int, negative_id long, "
                                           "positive_score long, negative_score long")
