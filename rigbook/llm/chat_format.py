"""Chat formatting by minimum-cost role repair.

Legal turns are those of an automaton: a system turn may come first, then user and assistant take turns, and
an assistant turn is last. For every conversation dynamic programming chooses the cheapest repair: merge a
turn into the one before, relabel it, or insert an empty turn before it. The costs of a run of turns are a
small matrix from the state before to the state after, and matrices multiply; so a conversation of any length
is worked on in parts, and no part has more turns than its share.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rigbook.llm.common import grouped, small_batches
from rigbook.session import cut_lineage

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}

#: What a merge, an inserted empty turn and a relabelled turn cost; a role nobody knows is cheap to relabel.
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
#: Turns of one part of a conversation, at most.
PART_TURNS = 1000
#: Rows, and characters of text, after which a task hands on its answers.
BATCH_ROWS, BATCH_CHARS = 512, 4 << 20
NEVER = 10**9

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _moves() -> dict[int, list[tuple[int, int, tuple[int, ...], bool]]]:
    """For each state: (state after, cost, empty turns inserted, merged) of taking a turn in as each role."""
    moves = {}
    for state in range(4):
        moves[state] = []
        for role in (SYSTEM, USER, ASSISTANT):
            if role in NEXT[state]:
                moves[state].append((role, 0, (), False))
            if role == state:
                moves[state].append((role, MERGE, (), True))
            moves[state] += [(role, INSERT, (x,), False) for x in NEXT[state] if x != SYSTEM and role in NEXT[x]]
    return moves


MOVES = _moves()
#: Empty turns that bring each state to a legal end, and what they cost. No turns at all are legal.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_cost(name: str | None, role: int) -> int:
    known = (name or "").strip().lower()
    return NAME if known not in ROLES else 0 if ROLES[role - 1] == known else RELABEL


def step(costs: np.ndarray, name: str | None) -> tuple[np.ndarray, list[tuple[int, int] | None]]:
    """Least costs of each state after a turn, and for each the state before and the move's number."""
    after, back = np.full(4, NEVER), [None] * 4
    for state in range(4):
        if costs[state] < NEVER:
            for k, (role, cost, _, _) in enumerate(MOVES[state]):
                total = costs[state] + cost + role_cost(name, role)
                if total < after[role]:
                    after[role], back[role] = total, (state, k)
    return after, back


def matrix(names: list[str | None]) -> np.ndarray:
    """Least cost of the turns from every state to every state."""
    out = np.full((4, 4), NEVER)
    for state in range(4):
        costs = np.full(4, NEVER)
        costs[state] = 0
        for name in names:
            costs, _ = step(costs, name)
        out[state] = costs
    return out


def repair(names: list[str | None], first: int, last: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """The cheapest repair between two states: for each turn its role, empty turns before it, and whether it
    is merged into the turn before. Of equal ones, the first in the order of states and moves."""
    costs = np.full(4, NEVER)
    costs[first] = 0
    trail = []
    for name in names:
        costs, back = step(costs, name)
        trail.append(back)
    out, state = [], last
    for back in reversed(trail):
        before, k = back[state]
        role, _, inserted, merged = MOVES[before][k]
        out.append((role, inserted, merged))
        state = before
    return out[::-1]


def borders(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """States before and after each part on the cheapest way through all of them, endings counted in."""
    ways = [np.array([0, NEVER, NEVER, NEVER])]
    for m in matrices:
        ways.append(np.minimum(ways[-1][:, None] + m, NEVER).min(axis=0))
    ends = ways[-1] + np.array([INSERT * len(ENDINGS[s]) for s in range(4)])
    state, out = int(ends.argmin()), []
    for k in range(len(matrices) - 1, -1, -1):
        before = int((ways[k] + matrices[k][:, state]).argmin())
        out.append((before, state))
        state = before
    return out[::-1]


def render(names: list[str | None], texts: list[str | None], first: int, last: int, ends: bool) -> tuple[str, dict]:
    """The repaired turns as text, and what was done. A turn is closed by the next one, or by the end, so
    that the parts of a conversation are put together by writing one after the other."""
    out, done = [], {"n_turns": 0, "n_merged": 0, "n_relabelled": 0, "n_inserted": 0}
    state = first

    def opened(role: int) -> None:
        out.append(CLOSE * (state != START) + OPEN.format(ROLES[role - 1]))
        done["n_turns"] += 1

    for (role, inserted, merged), name, text in zip(repair(names, first, last), names, texts, strict=True):
        for empty in inserted:
            opened(empty)
            out.append("\n")
            done["n_inserted"] += 1
            state = empty
        if merged:
            done["n_merged"] += 1
        else:
            opened(role)
        out.append((text or "") + "\n")
        done["n_relabelled"] += role_cost(name, role) > 0
        state = role
    if ends:
        for empty in ENDINGS[state]:
            opened(empty)
            out.append("\n")
            done["n_inserted"] += 1
            state = empty
        out.append(CLOSE * (state != START))
    return "".join(out), done


def in_parts(rows: DataFrame, part_turns: int) -> DataFrame:
    """The rows with their part: how many turns of the conversation come before, divided by ``part_turns``.

    A conversation of one part needs no order. The rows of the others are put in order by ranges, in which a
    conversation may go over many tasks, and equal rows too; the rows in the ranges before are added to a row's
    rank in its own.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > part_turns)
    long = cut_lineage(sizes.select(F.col("conv_id").alias("_long")))
    is_long = rows["conv_id"].eqNullSafe(long["_long"])
    short = rows.join(long, is_long, "left_anti").withColumn("part", F.lit(0).cast("long"))

    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("_row")]
    ranges = (rows.join(long, is_long, "left_semi").withColumn("_row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order).drop("_row"))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, n = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            ranks = []
            for key in batch.column("conv_id").to_pylist():
                n = n + 1 if key == last else 0
                last = key
                ranks.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([task] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())],
                names=[*batch.schema.names, "_range", "_rank"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranked = cut_lineage(ranges.mapInArrow(number, f"{kinds}, _range int, _rank long"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranked.groupBy("conv_id", "_range").agg(F.count("*").alias("n"))
              .select(F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), F.sum("n").over(before).alias("_skip")))
    starts = cut_lineage(starts.where("_skip > 0"))     # one row at most for each range
    placed = ranked.join(starts, ranked["conv_id"].eqNullSafe(starts["_c"]) & (ranked["_range"] == starts["_r"]), "left")
    part = F.floor((F.col("_rank") + F.coalesce("_skip", F.lit(0))) / part_turns).cast("long")
    return short.unionByName(placed.withColumn("part", part).select(*short.columns))


def in_batches(rows: Iterable[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some hundred rows, or of fewer once their texts are large."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == BATCH_ROWS or size > BATCH_CHARS:
            yield _batch(held, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)],
                                      names=list(kinds))


def chat_format(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per part of a conversation (conv_id, part): rendered, is_last, n_source, n_turns, n_merged,
    n_relabelled, n_inserted. The parts of a conversation in order make its rendered text.

    Turns are ordered by turn, role and text, null turn numbers last; a null text is an empty one, a null or
    unknown role may become any. Repeated turns are turns. All rows of a null conv_id are one conversation.
    Every part is a group of its own and has at most ``part_turns`` turns, whatever their numbers, so a
    conversation with most of all turns is spread like any others. Parts are numbered from 0.
    """
    small_batches(conversations.sparkSession)
    rows = in_parts(conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), "text"), part_turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    to_arrow = to_arrow_type(rows.schema["conv_id"].dataType)
    order = [F.col("conv_id"), F.col("part"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]

    def dealt(table: DataFrame) -> DataFrame:
        return table.repartition("conv_id", "part").sortWithinPartitions(*order)

    def cost(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*key, matrix(part["role"]).ravel().tolist()) for key, part in grouped(batches, ["conv_id", "part"], ["role"]))
        yield from in_batches(found, {"conv_id": to_arrow, "part": pa.int64(), "costs": pa.list_(pa.int64())})

    def pass_through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, held in grouped(batches, ["conv_id"], ["part", "costs"]):
                ways = borders([np.array(c).reshape(4, 4) for c in held["costs"]])
                for k, (part, (first, last)) in enumerate(zip(held["part"], ways, strict=True)):
                    yield key[0], part, first, last, k == len(ways) - 1
        yield from in_batches(rows(), {"conv_id": to_arrow, "part": pa.int64(), "first_state": pa.int32(),
                                       "last_state": pa.int32(), "is_last": pa.bool_()})

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, held in grouped(batches, ["conv_id", "part"], ["role", "text", "first_state", "last_state", "is_last"]):
                last = held["is_last"][0]
                text, done = render(held["role"], held["text"], held["first_state"][0], held["last_state"][0], last)
                yield *key, text, last, len(held["role"]), *done.values()
        counts = dict.fromkeys(("n_source", "n_turns", "n_merged", "n_relabelled", "n_inserted"), pa.int64())
        yield from in_batches(rows(), {"conv_id": to_arrow, "part": pa.int64(), "rendered": pa.string(),
                                       "is_last": pa.bool_()} | counts)

    costs = dealt(rows.drop("text").withColumn("text", F.lit(None).cast("string"))).mapInArrow(
        cost, f"conv_id {kind}, part long, costs array<long>")
    states = cut_lineage(costs.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        pass_through, f"conv_id {kind}, part long, first_state int, last_state int, is_last boolean"))
    by = states.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "first_state", "last_state", "is_last")
    known = rows.join(by, rows.conv_id.eqNullSafe(by._c) & (rows.part == by._p)).drop("_c", "_p")
    return dealt(known).mapInArrow(write, f"conv_id {kind}, part long, rendered string, is_last boolean, n_source long, "
                                          "n_turns long, n_merged long, n_relabelled long, n_inserted long")
