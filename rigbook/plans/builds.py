"""Saved part lists: handing out share codes, and looking lists up again."""

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigbook import fixed
from rigbook.functions.text import bind, packed_key
from rigbook.schemas import SHARED_BUILDS
from rigbook.session import cut_lineage

CODE_FORMAT = r"\A[\p{L}\p{N}]{6}\z"


def is_valid_code(code: Column) -> Column:
    """Six letters or digits, of any script."""
    return code.rlike(CODE_FORMAT)


def _code(salt: str, build_id: Column, attempt: int) -> Column:
    """A share code out of a salted hash: nobody can guess it without the salt, and a task that has to
    be run again finds the same one. Eight hash digits make one letter."""
    digest = F.sha2(F.concat_ws("/", F.lit(salt), build_id.cast("string"), F.lit(attempt)), 256)
    def letter(i):
        number = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        return F.substring(F.lit(fixed.CODE_ALPHABET), (number % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(i) for i in range(fixed.CODE_LENGTH)])


def drop_empty_slots(builds: DataFrame) -> DataFrame:
    """Part lists without their empty slots. A list with no part at all fails the job."""
    slots = F.map_filter("slots", lambda slot, part: part.isNotNull())
    empty = F.raise_error(F.concat(F.lit("build has no parts selected: "), F.col("build_id")))
    return builds.withColumn("slots", F.when(F.size(slots) > 0, slots).otherwise(empty.cast(
        SHARED_BUILDS["slots"].dataType)))


def save_builds(builds: DataFrame, shared: DataFrame, now: Column, salt: str | None = None) -> DataFrame:
    """Give each new part list (build_id, slots) a code that neither ``shared`` nor another list has.

    A ``build_id`` may occur once only. Lists whose code is taken try again, up to ten times in all. A
    second round is rare: of a million new lists about nine collide with each other. The rounds are few,
    and each one is written to the shared folder, so plans do not grow.
    """
    salt = salt or secrets.token_hex(32)
    waiting = cut_lineage(drop_empty_slots(builds).select("build_id", "slots"))
    if not waiting.groupBy("build_id").count().where("count > 1").isEmpty():
        raise ValueError("build_id is not unique")
    given = None
    for attempt in range(fixed.CODE_ATTEMPTS):
        tried = cut_lineage(waiting.withColumn("code", _code(salt, F.col("build_id"), attempt)))
        # The saved codes are streamed past the new ones, and only those that are taken come back.
        for others in [shared, *([] if given is None else [given])]:
            taken = others.select("code").join(tried.select("code"), "code", "left_semi")
            tried = tried.join(taken, "code", "left_anti")
        unused = tried
        # The rank is limited to 1, so Spark drops losers before the shuffle too.
        order = Window.partitionBy("code").orderBy("build_id")
        won = unused.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        won = cut_lineage(won.select("build_id", "code", "slots"))
        given = won if given is None else given.unionByName(won)
        waiting = cut_lineage(waiting.join(won.select("build_id"), "build_id", "left_anti"))
        if waiting.isEmpty():
            return given.withColumn("created_at", now)
    raise RuntimeError(f"no unique share code after {fixed.CODE_ATTEMPTS} attempts")


#: Numbers that a half of a code can be, and how often the halves are mixed.
HALF = len(fixed.CODE_ALPHABET) ** (fixed.CODE_LENGTH // 2)
ROUNDS = 8
#: How many different codes there are.
CODES = HALF * HALF


def _mask(key: str, step: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("/", F.lit(key), step.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % HALF


def _halves(left: Column, right: Column) -> Column:
    return F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))


def code_of(number: Column, key: str) -> Column:
    """The share code with this number, from 0 up to ``CODES``: a permutation of all codes that only ``key`` tells.

    The number's two halves are mixed in turn, each step adding a keyed hash of one half to the other (a Feistel
    network with addition modulo HALF). Every step can be taken back, so different numbers have different codes.
    """
    mixed = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _halves(F.floor(number / HALF), number % HALF),
        lambda s, step: _halves(s["right"], (s["left"] + _mask(key, step, s["right"])) % HALF))

    def letters(half):
        digits = [F.floor(half / 62 ** k) % 62 for k in range(fixed.CODE_LENGTH // 2 - 1, -1, -1)]
        return [F.substring(F.lit(fixed.CODE_ALPHABET), d.cast("int") + 1, F.lit(1)) for d in digits]
    return bind(mixed, lambda s: F.concat(*letters(s["left"]), *letters(s["right"])))


def number_of(code: Column, key: str) -> Column:
    """The number whose code this is, the inverse of :func:`code_of`; NULL for what is no such code."""
    def half(begin):
        digits = [F.position(F.substring(code, begin + k, 1), F.lit(fixed.CODE_ALPHABET)) - 1
                  for k in range(fixed.CODE_LENGTH // 2)]
        return sum((d.cast("bigint") * 62 ** k for k, d in enumerate(reversed(digits))), F.lit(0))
    mixed = F.aggregate(
        F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), _halves(half(1), half(1 + fixed.CODE_LENGTH // 2)),
        lambda s, step: _halves(F.pmod(s["right"] - _mask(key, step, s["left"]), F.lit(HALF)), s["left"]))
    known = code.rlike(rf"\A[{fixed.CODE_ALPHABET}]{{{fixed.CODE_LENGTH}}}\z")
    return F.when(known, bind(mixed, lambda s: s["left"] * HALF + s["right"]))


def save_builds_in_range(builds: DataFrame, first: int, now: Column, key: str) -> tuple[DataFrame, int]:
    """Give each new part list (build_id, slots) a code out of the numbers from ``first`` on, and say where the next
    range begins.

    The codes are unique by construction, so none is looked up: neither the saved ones nor those of other jobs, as long
    as all codes come from this key and the caller hands out each range once, say from a counter. Lists are
    numbered in the order of a written table: tasks count their rows, and a running sum of these counts, one row for
    each task, gives each its place. So a task that is run again hands out the same numbers.
    """
    rows = cut_lineage(drop_empty_slots(builds).select("build_id", "slots")
                       .withColumn("place", F.monotonically_increasing_id()))
    task = F.shiftright("place", 33)        # the identifier is the task's number and, in 33 bits, the row's
    tasks = rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(tasks.select("task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    end = first + (starts.agg(F.sum("n")).first()[0] or 0)
    if not 0 <= first <= end <= CODES:
        raise ValueError(f"no codes from {first} to {end}; there are {CODES}")
    number = F.lit(first) + F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)
    coded = rows.join(starts, task == F.col("task")).select("build_id", code_of(number, key).alias("code"), "slots")
    return coded.withColumn("created_at", now), end


def _last_slots(slots: Column) -> Column:
    """A part list without empty slots, and of several slots with one part the last only."""
    filled = F.map_filter(slots, lambda slot, part: part.isNotNull())

    def place(slot):
        return F.struct(F.array_position(F.lit(list(fixed.BUILD_SLOTS)), slot), slot)

    def is_last(entries, slot, part):
        return ~F.exists(entries, lambda e: (e["value"] == part) & (place(e["key"]) > place(slot)))
    several = bind(F.map_values(filled), lambda parts: F.size(F.array_distinct(parts)) < F.size(parts))
    return F.when(several, bind(F.map_entries(filled), lambda entries: F.map_filter(
        filled, lambda slot, part: is_last(entries, slot, part)))).otherwise(filled)


def resolve_builds(shared: DataFrame, parts: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per slot of each saved list, with the part and its latest price, which may be NULL.

    Slots whose part is gone are left out. A part that stands in several slots of a list comes back in
    the last of them only, in the order of ``BUILD_SLOTS``, as a map has none of its own. Filter ``shared``
    by code first to look up single lists.

    One part may stand in very many lists. So the different parts are looked up first, each once, and
    written out: with that table of known size on one side, Spark either broadcasts it or can split the
    hot part's slots over several tasks.
    """
    order = F.array_position(F.lit(list(fixed.BUILD_SLOTS)), F.col("slot"))
    # Written out, as the lists may be dear to make, and are read several times.
    slots = cut_lineage(shared.select("code", F.monotonically_increasing_id().alias("row"),
                                      _last_slots(F.col("slots")).alias("slots"))
                        .select("code", "row", F.explode("slots").alias("slot", "part_id")))
    # Only if a code stands in several rows need their slots meet. Finding out shuffles codes alone, and no keys.
    repeated = slots.groupBy("code").agg((F.min("row") < F.max("row")).alias("repeated")).where("repeated")
    if not repeated.isEmpty():
        slots = cut_lineage(slots.groupBy("code", "part_id").agg(F.max_by("slot", order).alias("slot")))
    needed = slots.select("part_id").distinct()
    priced = cut_lineage(needed.join(parts, "part_id")
                         .join(latest.select("part_id", "price_pkr"), "part_id"))
    # The keys of slots and parts meet as bytes, which are half as long.
    found = (slots.select("code", "slot", packed_key(F.col("part_id")).alias("key"))
             .join(priced.withColumn("key", packed_key(F.col("part_id"))), "key"))
    return found.select("code", "slot", "part_id", "source", "source_id", "name", "category", "url", "thumbnail_url",
                        "specs", "price_pkr")


def resolve_build(shared: DataFrame, code: str, listing: DataFrame) -> DataFrame | None:
    """The slots of one saved list as :func:`resolve_builds` gives them, or None if nobody saved this code; a list
    whose parts are all gone is there and empty.

    The list is read by its code, sorted files and statistics skip the others, and its few parts, at most one for
    each slot, go as literals into the scan of the stored listing.
    """
    found = shared.where(F.col("code") == code).select("slots").head()
    if found is None:
        return None
    order = {slot: k for k, slot in enumerate(fixed.BUILD_SLOTS)}
    slot_of = {part: slot for slot, part in sorted(found.slots.items(), key=lambda x: order.get(x[0], -1)) if part}
    slots = F.create_map(*[F.lit(x) for pair in slot_of.items() for x in pair]) if slot_of else F.lit(None).cast(
        "map<string,string>")
    return (listing.where(F.col("part_id").isin(list(slot_of)) & F.col("priced_at").isNotNull())
            .select(F.lit(code).alias("code"), slots[F.col("part_id")].alias("slot"), "part_id", "source", "source_id",
                    "name", "category", "url", "thumbnail_url", "specs", "price_pkr"))
