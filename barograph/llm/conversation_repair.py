"""Conversation structure repair by weighted finite-state composition.

The rows of a conversation are a linear acceptor, edits (keep, re-role, delete, insert) a transducer, and the order of
roles ``(s?(ua)+)?`` an acceptor. Their composition is expanded state by state as the search asks for arcs; states
are (row, inserts since the last row, grammar state), which is a topological order, and the best path is found from the
end in the semiring of (cost, label string). A string is kept as its first label and the state after it: the grammar is
deterministic, so that each label of a state leads to one state and strings differ where their first labels differ.

Rows are sorted over range partitions. A conversation that reaches over several parts is solved by parts: each
part's costs from state to state are a matrix, and products of matrices give what is still to pay at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import BLANKS, cut, table

#: Costs of edits, and of a truncated row that stays (fixed values).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Moves of the role grammar by initial: start, after s, after u, after a; the first and the last may end it.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: More inserts than these before a row lead where fewer lead for less.
MOST_INSERTS = 2
NEVER = 1 << 60
ROLES = {"u": "user", "a": "assistant"}


@lru_cache(maxsize=1 << 14)
def arcs(sign: str, inserts: int, state: int) -> list[tuple[str, str, int, bool, int]]:
    """(label, new initial, cost, whether the row is used, next state) from a state of the composition.

    ``sign`` is a row: ``-`` whole, ``t`` truncated or ``x`` to be deleted, and its role's initial; '' is the end.
    """
    out = []
    for initial, to in MOVES[state].items():
        if initial in ROLES and inserts < MOST_INSERTS:
            out.append(("I", initial, INSERT, False, to))
        if sign and sign[0] != "x":
            extra = TRUNCATED * (sign[0] == "t")
            if sign[1:] == initial:
                out.append(("K", "", KEEP + extra, True, to))
            if initial in ROLES:
                out.append(("R", initial, REROLE + extra, True, to))
    if sign:
        out.append(("D", "", DELETE, True, state))
    return out


def layer(sign: str, after: list[int]) -> list[list[int]]:
    """Costs to go before a row, by inserts so far and state; ``after``: those behind it by state (at the end, of ending)."""
    below: list[list[int]] = []
    for inserts in range(MOST_INSERTS, -1, -1):
        costs = [] if sign else list(after)
        for state in range(len(MOVES)):
            best = min((cost + (after[to] if used else below[0][to]) for _, _, cost, used, to in arcs(sign, inserts, state)), default=NEVER)
            if sign:
                costs.append(min(best, NEVER))
            else:
                costs[state] = min(best, costs[state])
        below.insert(0, costs)
    return below


def layers(signs: tuple[str, ...], after: list[int] | None) -> list[list[list[int]]]:
    """Costs to go before each row and at the end. ``after`` are those of the rows of later parts; None: there are none."""
    out = [layer("", [0 if q in ENDS else NEVER for q in range(len(MOVES))]) if after is None else [after] * (MOST_INSERTS + 1)]
    for sign in reversed(signs):
        out.append(layer(sign, out[-1][0]))
    return out[::-1]


def walk(signs: tuple[str, ...], after: list[int] | None, state: int) -> tuple[list[tuple[str, str]], int]:
    """For each row the labels up to its own and the new initials (``-``: none), and the state at the end.

    Labels behind the last row of a conversation are added to the last row's.
    """
    to_go, out = layers(signs, after), []
    for i, sign in enumerate(signs + ("",) * (after is None)):
        labels, initials, inserts, used = "", "", 0, False
        while not used and (sign or to_go[i][inserts][state] > 0):
            there = to_go[i + 1][0] if sign else []
            _, label, initial, used, state = min((cost + (there[to] if used else to_go[i][inserts + 1][to]), label, initial, used, to) for label, initial, cost, used, to in arcs(sign, inserts, state))
            labels, initials, inserts = labels + label, initials + (initial or "-"), inserts + 1
        if sign:
            out.append((labels, initials))
        elif out:
            out[-1] = (out[-1][0] + labels, out[-1][1] + initials)
    return out, state


@lru_cache(maxsize=1 << 15)
def _whole(signs: tuple[str, ...]) -> list[tuple[str, str]]:
    return walk(signs, None, 0)[0]


def matrix(signs: tuple[str, ...]) -> list[int]:
    """Least cost from each state to each other over the rows."""
    size = len(MOVES)
    columns = [layers(signs, [0 if q == r else NEVER for q in range(size)])[0][0] for r in range(size)]
    return [columns[r][q] for q in range(size) for r in range(size)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, conversation, first of the part, last of the part, ats, signs) of rows sorted by part and at."""
    held, key, first = None, None, True
    for b in batches:
        for part, at, conv, sign in zip(*(b[c].to_pylist() for c in ("part", "at", "conv", "sign")), strict=True):
            if (part, conv) != key:
                if held:
                    yield (*key, first, part != key[0], *held)
                    first = part != key[0]
                held, key = ([], []), (part, conv)
            held[0].append(at)
            held[1].append(sign)
    if held:
        yield (*key, first, True, *held)


def in_order(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows as conv, turn, role, text with their number ``at`` and range partition ``part``: by turn (nulls first), role and text.

    Equal turns of a conversation are put by role and text, and equal rows are alike in any order. A null role or text is one space.
    """
    rows = convs.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    keys = ["conv", "turn", "role", "text"]
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "turns-in-order")


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, at, part, sign and fault (blank, duplicate, truncated or null) of rows in order. A row's first fault counts."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank, open_end = end == "", ~F.substring(end, -1, 1).isin(".", "!", "?")
    firsts = rows.where(~blank).groupBy("conv", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated")
    narrow = rows.select("conv", "turn", "at", "part", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), open_end.alias("open"))
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("-")
    return narrow.join(firsts, "at", "left").withColumn("fault", fault).select("conv", "turn", "at", "part", F.concat(mark, "initial").alias("sign"), "fault")


def _bounds(edges: list) -> tuple[dict, dict, set]:
    """By part: costs to go behind its last run where the conversation goes on; the part and sign before its first run; parts of one run."""
    size, after, before = len(MOVES), {}, {}
    heads, tails = [{e.part: e for e in edges if getattr(e, which)} for which in ("first", "last")]
    parts = sorted(heads)
    for p, nxt in reversed(list(zip(parts[:-1], parts[1:], strict=True))):
        if tails[p].conv == heads[nxt].conv:
            m = heads[nxt].costs
            then = after.get(nxt) if heads[nxt].last else None
            ends = layers((), None)[0][0] if then is None else then
            after[p] = [min(min(m[q * size + r] + ends[r] for r in range(size)), NEVER) for q in range(size)]
            before[nxt] = p, tails[p].signs[1]
    return after, before, {p for p in parts if heads[p].last}


def edits(marked: DataFrame) -> DataFrame:
    """at, labels, initials and clash (whether the initials of this row and the one before can't follow each other).

    A conversation over several parts costs the driver one matrix a part, and each part at most two runs.
    """
    spark, conv_type = marked.sparkSession, marked.schema["conv"].dataType.simpleString()
    dealt = marked.select("part", "at", "conv", "sign").repartition("part").sortWithinPartitions("part", "at")

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv, first, last, _, signs in _runs(batches):
            if first or last:
                yield pa.RecordBatch.from_pylist([{"part": part, "conv": conv, "first": first, "last": last, "costs": matrix(tuple(signs)), "signs": [signs[0], signs[-1]]}], edge_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    edge_schema = to_arrow_schema(spark.createDataFrame([], f"part int, conv {conv_type}, first boolean, last boolean, costs array<long>, signs array<string>").schema)
    after, before, single = _bounds(dealt.mapInArrow(edge, f"part int, conv {conv_type}, first boolean, last boolean, costs array<long>, signs array<string>").collect())
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(6)]
        for part, _, first, last, ats, signs in _runs(batches):
            goes_on, came = after.get(part) if last else None, before[part][1] if first and part in before else None
            signs = tuple(signs)
            for start in range(len(MOVES)) if came is not None else (0,):
                found, end = walk(signs, goes_on, start) if goes_on or came is not None or len(signs) > 64 else (_whole(signs), None)
                pairs = zip((came or "", *signs[:-1]), signs, strict=True)
                clash = [k + (came is not None) > 0 and a[1:] + b[1:] not in legal for k, (a, b) in enumerate(pairs)]
                rows = ([part if came is not None else None] * len(ats), [start] * len(ats), ats, *([f[j] for f in found] for j in (0, 1)), clash)
                for column, x in zip(columns, rows, strict=True):
                    column.extend(x)
            if len(columns[0]) > 20_000:
                yield batch(columns)
                columns = [[] for _ in range(6)]
        yield batch(columns)

    def batch(columns: list[list]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["part", "start", "at", "labels", "initials", "clash"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, first, last, _, signs in _runs(batches):
            if last and part in after:
                came = first and part in before
                yield pa.RecordBatch.from_pylist([{"part": part, "ends": [walk(tuple(signs), after[part], q)[1] if came or q == 0 else 0 for q in range(len(MOVES))]}], pa.schema([("part", pa.int32()), ("ends", pa.list_(pa.int32()))]))

    out = dealt.mapInArrow(run, "part int, start int, at long, labels string, initials string, clash boolean")
    if not before:
        return out.drop("part", "start")
    end_of = {r.part: r.ends for r in dealt.where(F.col("part").isin(list(after))).mapInArrow(ends, "part int, ends array<int>").collect()}
    starts: dict[int, int] = {}
    for part, (previous, _) in sorted(before.items()):
        starts[part] = end_of[previous][starts.get(previous, 0) if previous in single else 0]
    chosen = spark.createDataFrame(list(starts.items()), "part int, chosen int")
    return out.join(chosen, "part", "left").where("chosen is null or start = chosen").drop("part", "start", "chosen")


def repair(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of every conversation as rows: conv, at, nth, edit (K, R, D or I), role, text, cost, turn, fault, clash.

    Rows without a D, by (at, nth), are the repaired conversation; those with an I are new, with an empty text.
    A row that has been read has nth 0, its turn and its fault, and clash tells whether its role can't follow the one before.

    Conversations are taken by turn (nulls first), role and text; a null conv is a conversation, a null role or text one
    space, and rows that repeat role and text are duplicates. Other columns of ``convs`` aren't read. A conversation of any number of rows is dealt
    over range partitions; texts never leave the JVM.
    """
    rows = in_order(convs, conv_col, turn_col, role_col, text_col)
    marked = cut(faults(rows), "turn-faults")
    whole = rows.select("conv", "turn", "at", "role", "text").join(marked.select("at", "fault"), "at").join(edits(marked), "at")
    own = F.length(F.regexp_replace("labels", "I+$", ""))  # place of the row's own label; inserts may follow at the end
    each = whole.withColumn("own", own).select("*", F.posexplode(F.split("labels", "")).alias("k", "edit"))
    initial = F.substring("initials", F.col("k") + 1, 1)
    mine = F.col("k") == F.col("own") - 1
    role = F.when(initial == "u", ROLES["u"]).when(initial == "a", ROLES["a"]).otherwise(F.col("role"))
    truncated = F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    cost = F.when(F.col("edit") == "I", INSERT).when(F.col("edit") == "D", DELETE).when(F.col("edit") == "R", truncated + REROLE).otherwise(truncated + KEEP)
    of_row = lambda c: F.when(mine, F.col(c)).alias(c)
    return each.select(
        "conv", "at", (F.col("k") - F.col("own") + 1).alias("nth"), "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), cost.cast("long").alias("cost"),
        of_row("turn"), of_row("fault"), of_row("clash"),
    )


def damage(convs: DataFrame) -> DataFrame:
    """The damage of op12: by ``crc32(conv_id:turn) % 20`` rows are dropped, emptied, stripped of ends, doubled or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    hurt = convs.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation. Its audit and digest are values of the whole conversation, so that its repaired rows meet in one."""
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair(damage(convs))
    n = lambda c: F.count(F.when(c, 1))
    entry = F.struct("at", "nth", "edit", F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text")).alias("said"))
    script = F.sort_array(F.collect_list(entry))
    summary = fixed.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"), *(n(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        n(F.col("clash")).alias("illegal"), F.sum("cost").alias("cost"), script.alias("script"),
    )
    joined = convs.select("conv_id").distinct().join(summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    said = F.filter(F.transform("script", lambda x: x["said"]), lambda x: x.isNotNull())
    return joined.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(F.array_join(F.transform("script", lambda x: x["edit"]), ""), F.lit("")).alias("audit"),
        F.sha2(F.coalesce(F.array_join(said, "\n"), F.lit("")), 256).alias("repaired_sha256"),
    )
