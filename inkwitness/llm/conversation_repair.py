"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Each row may be kept, given the role
the next place needs, or deleted, and empty rows may be inserted anywhere; blank rows and repeats have to go. Among the
cheapest edit sequences the one whose initials are ASCII-least is taken.

The search is a depth-first branch-and-bound with an explicit stack. A node is (rows consumed, role state). Edits are
tried in the order of their initials, so leaves are met in the order of their audits and an incumbent gives way only to a
lower cost. A backward sweep gives the suffix lower bound of every node; a node whose cost plus bound exceeds the
incumbent is cut, and one that was reached before at no higher cost is dominated: prefixes of equal cost never extend one
another, because every insert costs, so the earlier one is the smaller audit.

Only the roles' initials and the faults of the rows (a few bytes each) are gathered by conversation. The texts move once,
in order, through a running hash or out as repaired rows, so that memory does not grow with a conversation. Both the audit
and the hash are values of one conversation as a whole, so one task has to walk through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Role states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
WANTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
COMPLETE = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60

#: Faults of a row, as they stand in the codes of a conversation.
SOUND, BLANK, DUPLICATE, TRUNCATED = "-", "b", "d", "t"
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def suffix_bounds(codes: list[tuple[str, str]]) -> list[list[int]]:
    """Cost of the cheapest completion of the rows from each place on, by role state, whatever its audit."""
    bounds = [[_FAR] * 4 for _ in range(len(codes) + 1)]
    bounds[-1] = [0 if state in COMPLETE else _FAR for state in range(4)]
    for place in range(len(codes), -1, -1):
        here = bounds[place]
        if place < len(codes):
            after = bounds[place + 1]
            initial, fault = codes[place]
            late = CUT_OFF if fault == TRUNCATED else 0
            for state in range(4):
                best = DELETE + after[state]
                if fault not in (BLANK, DUPLICATE):
                    best = min(best, REROLE + late + after[WANTED[state]], late + after[NEXT[state, initial]] if (state, initial) in NEXT else _FAR)
                here[state] = best
        for _ in range(3):  # a run of inserts never passes a state twice
            for state in range(4):
                here[state] = min(here[state], INSERT + here[WANTED[state]])
    return bounds


def cheapest_edits(codes: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of a conversation given as (initial, fault) of its rows in order."""
    bounds = suffix_bounds(codes)
    limit, answer = bounds[0][START], None
    reached: dict[tuple[int, int], int] = {}
    stack = [(0, START, 0, None)]  # rows consumed, state, cost, (edit, trail before)
    while stack:
        place, state, cost, trail = stack.pop()
        if cost + bounds[place][state] > limit or (answer is not None and cost + bounds[place][state] >= limit):
            continue
        if reached.get((place, state), _FAR) <= cost:
            continue
        reached[place, state] = cost
        branches = []
        if place == len(codes):
            if state in COMPLETE:
                limit, answer = cost, trail
        else:
            initial, fault = codes[place]
            late = CUT_OFF if fault == TRUNCATED else 0
            branches.append((place + 1, state, cost + DELETE, ("D", trail)))
            if fault not in (BLANK, DUPLICATE):
                if (state, initial) in NEXT:
                    branches.append((place + 1, NEXT[state, initial], cost + late, ("K", trail)))
                branches.append((place + 1, WANTED[state], cost + REROLE + late, ("R", trail)))
        branches.append((place, WANTED[state], cost + INSERT, ("I", trail)))
        stack.extend(sorted(branches, key=lambda b: b[3][0], reverse=True))
    edits = []
    while answer is not None:
        edits.append(answer[0])
        answer = answer[1]
    return limit, "".join(reversed(edits))


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows with nulls as one space, and the two hashes of the text that settle the order of equal turns and roles."""
    text = F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
                        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def _place():
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def row_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, n, turn, initial, fault, illegal, new_turn) of every row, in the order of its conversation."""
    seen = F.rtrim("text", F.lit(_SPACES))
    rows = _ordered(turns).select(
        "conv_id", "turn", "role", "h1", "h2", F.substring("role", 1, 1).alias("initial"), (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut")).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(*_place())
    same = Window.partitionBy("conv_id", "role", "h1", "h2").orderBy("n")
    rows = rows.select("*", F.row_number().over(order).cast("long").alias("n"), F.lag("initial").over(order).alias("before"),
                       F.lag("turn").over(order).alias("turn_before")).withColumn("copy", F.row_number().over(same))
    fault = F.when(F.col("blank"), BLANK).when(F.col("copy") > 1, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    illegal = F.coalesce(~F.concat("before", "initial").isin("su", "ua", "au"), F.lit(False))
    fresh = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))
    return rows.select("conv_id", "n", "turn", "initial", fault.alias("fault"), illegal.alias("illegal"), fresh.alias("new_turn"))


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _REPORT.split(", ")])
    out: list[tuple] = []
    current, codes, turns, illegal, fresh = None, [], [], 0, 0

    def finish() -> None:
        cost, audit = cheapest_edits(codes)
        count = [sum(1 for _, fault in codes if fault == f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        span = turns[1] - turns[0] + 1 - fresh if turns else 0
        out.append((current[0], span if span < 1 << 63 else None, *count, illegal, cost, audit))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv, turn, initial, fault, bad, new in zip(*columns):
            if current is None or current[0] != conv:
                if current is not None:
                    finish()
                current, codes, turns, illegal, fresh = (conv,), [], [], 0, 0
            codes.append((initial, fault))
            illegal += bad
            fresh += new
            if turn is not None:
                turns = [turns[0] if turns else turn, turn]
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if current is not None:
        finish()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Rows stand in the order of turn (null first),
    rows of one turn in that of role and of a hash of the text. A null role or text is one space; rows with a null
    conv_id are one conversation. ``gaps`` is null where it exceeds a long.
    """
    rows = row_faults(turns).sortWithinPartitions("conv_id", "n")
    return rows.select("conv_id", "turn", "initial", "fault", "illegal", "new_turn").mapInArrow(_searched, _REPORT)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text, edit) of the repaired rows, and (conv_id, None, None, None, None) at each end."""
    current, audit, at, state, place = None, "", 0, START, 0

    def inserts(upto: int | None):
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I" and (upto is None or at < upto):
            state, place, at = WANTED[state], place + 1, at + 1
            yield (current[0], place, NAMES[state], "", "I")

    for batch in batches:
        for conv, head, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if head is not None:
                if current is not None:
                    yield from inserts(None)
                    yield (current[0], None, None, None, None)
                current, audit, at, state, place = (conv,), head, 0, START, 0
                continue
            yield from inserts(None)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            place += 1
            if edit == "K":
                state = NEXT[state, role[:1]]
                yield (conv, place, role, text, edit)
            else:
                state = WANTED[state]
                yield (conv, place, NAMES[state], text, edit)
    if current is not None:
        yield from inserts(None)
        yield (current[0], None, None, None, None)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    out, size = [], 0
    for row in _walked(batches):
        if row[1] is not None:
            out.append(row)
            size += 64 + len(row[3])
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    out, running = [], hashlib.sha256()
    for conv, place, role, text, _ in _walked(batches):
        if place is not None:
            running.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            continue
        out.append((conv, running.hexdigest()))
        running = hashlib.sha256()
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _with_heads(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation behind its audit, in one stream per conversation."""
    rows = _ordered(turns).withColumn("head", F.lit(None).cast("string"))
    heads = found.select("conv_id", F.col("audit").alias("head"))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("head").isNull(), *_place()).select("conv_id", "head", "role", "text")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), role, text, edit (K, R or I). ``found``: ``audits(turns)``."""
    return _with_heads(turns, found).mapInArrow(_repaired, "conv_id long, place long, role string, text string, edit string")


def repair_report(turns: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``, the hash of the repaired ``role:text`` joined by line feeds.

    An empty table gives no row; a conversation of which nothing is left has the hash of the empty string.
    """
    found = materialise(audits(turns), "audits")
    hashes = _with_heads(turns, found).mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    return found.alias("f").join(hashes.alias("h"), F.col("f.conv_id").eqNullSafe(F.col("h.conv_id"))).select("f.*", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults, chosen by a checksum of ``conv_id:turn``: dropped, emptied, without sentence ends, doubled, or of role user."""
    piece = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(piece("conv_id"), F.lit(":"), piece("turn"))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
