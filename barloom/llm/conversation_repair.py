"""Cheapest repair of conversations by a rank-convergence parallel Viterbi.

A repaired conversation has the roles system (or none), then user and assistant in turn, an
assistant last; or it is empty.  Each turn is kept (K), gets another role (R) or is deleted (D),
and empty turns may be inserted (I).  The state is the role last written (nothing, system, user,
assistant); the cost of everything after a turn is a vector over the four states.

* The turns of a conversation are sorted over all tasks, and one byte per turn (role, fault) is
  kept in *chunks* of at most ``CHUNK`` turns.  A long conversation is many chunks in many tasks.
* Backward pass: the last chunk starts from the true end costs, all others from a speculative
  vector of zeros, all at once.
* Fix-up passes: a chunk whose successor's vector differs from the one it used by more than a
  constant is run again from the new vector, beside the old one, and stops where the two differ
  by a constant.  Passes go on until nothing changes.  Deleted turns only add a constant; runs of
  turns that any state deletes could keep vectors apart, so after ``FIXUPS`` passes the chunks of
  what is left are multiplied as min-plus matrices by pointer doubling (exact, logarithmic).
* Tracing: every chunk follows its costs from each of the four states, taking the least letter
  that lies on a cheapest path; the chunks' state maps are composed by pointer doubling.  Given
  a state, the letter decides the next state, so the least letter at each place gives the least
  audit string.

Texts are moved once, at the end, and pass through a task one by one; all else works on hashes of
16 bytes.  Equal turns (same conversation, turn, role and text) are counted before they are
sorted, so a turn that is repeated without end is one row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .words import SPACES

CHUNK = 4096             # turns
FIXUPS = 6               # passes before what is left goes to matrices
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # costs; the last is added if not deleted
NONE, BLANK, DUPLICATE, CUT_OFF = range(4)                # a turn's fault
START, SYSTEM, USER, ASSISTANT = range(4)                 # states; roles are the last three
NEXT = (USER, USER, ASSISTANT, USER)                      # the role that may be written in a state
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
END = (0, 2 * INSERT, INSERT, 0)                          # costs behind the last turn
FAR = 1 << 40
Vector = tuple[int, int, int, int]


def _closed(v: list[int]) -> Vector:
    """Costs when turns may be inserted first."""
    u = min(v[USER], INSERT + v[ASSISTANT])
    return (min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, min(v[ASSISTANT], INSERT + u))


def _kept(state: int, role: int) -> bool:
    return role == SYSTEM and state == START or role == NEXT[state]


def before_turn(v: Vector, code: int) -> Vector:
    """Costs before a turn, given those behind it."""
    role, fault = code & 3, code >> 2
    if fault in (BLANK, DUPLICATE):
        return tuple(x + DELETE for x in v)
    more = TRUNCATED if fault == CUT_OFF else 0
    out = []
    for state in range(4):
        best = min(DELETE + v[state], REROLE + more + v[NEXT[state]])
        if _kept(state, role):
            best = min(best, KEEP + more + v[role])
        out.append(best)
    return _closed(out)


def level(v) -> Vector:
    """The vector less its least value."""
    low = min(v)
    return tuple(int(x - low) for x in v)


def begin_costs(codes: bytes, end: Vector) -> Vector:
    for code in reversed(codes):
        end = before_turn(end, code)
    return level(end)


def fixed_up(codes: bytes, old: Vector, begin: Vector, new: Vector) -> Vector:
    """The begin costs for another end: run until the vectors differ by a constant."""
    for code in reversed(codes):
        if level(old) == level(new):
            return begin
        old, new = before_turn(old, code), before_turn(new, code)
    return level(new)


def matrix(codes: bytes) -> np.ndarray:
    """Costs from each state at the begin (rows) to each state at the end."""
    ends = []
    for state in range(4):
        v: Vector = _closed([0 if s == state else FAR for s in range(4)])
        for code in reversed(codes):
            v = before_turn(v, code)
        ends.append(v)
    return np.array(ends, np.int64).T


def trace(codes: bytes, end: Vector, state: int, last: bool) -> tuple[int, str, int]:
    """(end state, least edits, their cost) of a cheapest path from ``state``."""
    costs = [end]
    for code in reversed(codes):
        costs.append(before_turn(costs[-1], code))
    costs.reverse()
    out, total = [], 0
    for i, code in enumerate(codes):
        role, fault = code & 3, code >> 2
        more = TRUNCATED if fault == CUT_OFF else 0
        here, then = costs[i], costs[i + 1]
        while True:
            if here[state] == DELETE + then[state]:
                out.append("D")
                total += DELETE
            elif here[state] == INSERT + here[NEXT[state]]:
                out.append("I")
                total += INSERT
                state = NEXT[state]
                continue
            elif _kept(state, role) and here[state] == KEEP + more + then[role]:
                out.append("K")
                total += KEEP + more
                state = role
            else:
                out.append("R")
                total += REROLE + more
                state = NEXT[state]
            break
    while last and state not in (START, ASSISTANT):
        out.append("I")
        total += INSERT
        state = NEXT[state]
    return state, "".join(out), total


_short_trace = lru_cache(1 << 16)(trace)


def _traced(codes: bytes, end: Vector, state: int, last: bool):
    return (_short_trace if len(codes) <= 64 else trace)(codes, end, state, last)


# ---------------------------------------------------------------- the turns and their faults

def _hash(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, role, t): null roles and texts are one space."""
    return rows.select(F.col(conv).alias("c"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("t"))


def _faults(turns: DataFrame) -> DataFrame:
    """(c, turn, role, th, blank, cut, n): distinct turns, their hash, and how many there are."""
    shown = F.rtrim(F.col("t"), F.lit(SPACES))
    return (turns.select("c", "turn", "role", _hash("t").alias("th"),
                         (shown == "").alias("blank"),
                         (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"))
            .groupBy("c", "turn", "role", "th", "blank", "cut").agg(F.count(F.lit(1)).alias("n")))


def _chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """Chunks (c, id, turn, role, th of their first turn, codes, counts of faults).

    ``more``: the next chunk of the task belongs to the same conversation.  ``edge``: the first or
    last chunk of a task.  ``before``: role of the turn before in the task, -1 if there is none.
    """
    first = (turns.groupBy("c", "role", "th").agg(F.min(F.struct("turn")).alias("least"),
                                                  F.count(F.lit(1)).alias("k"))
             .where("k > 1").select(F.col("c").alias("fc"), F.col("role").alias("fr"),
                                    F.col("th").alias("fh"), "least"))
    # a struct of a null turn sorts first and is not null itself
    seen = F.col("least").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("least"))
    marked = (turns.join(first, F.col("c").eqNullSafe(F.col("fc")) & (F.col("role") == F.col("fr"))
                         & (F.col("th") == F.col("fh")), "left")
              .select("c", "turn", "role", "th", "blank", "cut", "n", seen.alias("seen")))
    role = sum((F.when(F.substring("role", 1, 1) == x, i + 1).otherwise(0)
                for i, x in enumerate(INITIALS)), F.lit(0))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("seen"), DUPLICATE)
             .when(F.col("cut"), CUT_OFF).otherwise(NONE))
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    keys = ["c", "turn", "role", "th"]
    rows = (marked.select(*keys, (role + 4 * fault).cast("int").alias("code"),
                          (role + 4 * again).cast("int").alias("again"), "n")
            .repartitionByRange(*keys).sortWithinPartitions(*keys))
    kinds = {n: rows.schema[n].dataType.simpleString() for n in keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, types = TaskContext.get().partitionId() << 32, 0, [], None
        now, codes, key, before, came = None, bytearray(), None, -1, -1

        def close(more: bool):
            nonlocal number, codes, before
            held.append((*key, task + number, bytes(codes), more, number == 0, before))
            number += 1
            before, codes = codes[-1] & 3, bytearray()

        def out(last: bool):
            cols = list(zip(*held))
            edge = [a or (last and i == len(held) - 1) for i, a in enumerate(cols[7])]
            faults = [np.bincount(np.frombuffer(x, np.uint8) >> 2, minlength=4) for x in cols[5]]
            batch = pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols[:4], types)), pa.array(cols[4], pa.int64()),
                 pa.array(cols[5], pa.binary()), pa.array(cols[6]), pa.array(edge),
                 pa.array(cols[8], pa.int32()),
                 *(pa.array([int(f[k]) for f in faults]) for k in (BLANK, DUPLICATE, CUT_OFF))],
                [*keys, "id", "codes", "more", "edge", "before", *COUNTED])
            held.clear()
            return batch

        for batch in batches:
            types = types or [batch.column(i).type for i in range(4)]
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if key is None or row[0] != now:
                    if codes:
                        close(False)
                    if len(held) > 4096:
                        yield out(False)
                    now, before = row[0], -1
                left, code = row[6], row[4]
                while left:
                    if len(codes) == chunk:
                        close(True)
                        if len(held) > 4096:
                            yield out(False)
                    if not codes:
                        key = row[:4]
                    codes.append(code)
                    code, left = row[5], left - 1
                    if left and len(codes) < chunk:
                        some = min(left, chunk - len(codes))
                        codes += bytes([code]) * some
                        left -= some
        if codes:
            close(False)
        if held:
            yield out(True)

    return rows.mapInArrow(run, ", ".join(
        [*(f"{n} {k}" for n, k in kinds.items()), "id bigint", "codes binary", "more boolean",
         "edge boolean", "before int", *(f"{n} bigint" for n in COUNTED)]))


COUNTED = ["blank", "duplicate", "truncated"]


def _map_chunks(df: DataFrame, names: list[str], work: Callable, out: str) -> DataFrame:
    """``work`` (row tuple of ``names`` -> row tuple) with the columns of ``out`` appended to ``id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [work(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            cols = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, fields.values()))],
                ["id", *fields])

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
             "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = {n: kinds[k] for n, k in (f.strip().split(" ") for f in out.split(","))}
    return df.select("id", *names).mapInArrow(run, f"id bigint, {out}")


def _doubled(parts: DataFrame, compose: Callable, label: str) -> DataFrame:
    """(id, value) where value is composed with those of all chunks that ``to`` leads to.

    ``parts``: (id, to, value array<bigint>); ``compose(own, other)`` works on lists.  Rounds are
    logarithmic in the longest chain; one number per round reaches the driver.
    """
    now = stage(parts, label)
    while now.where("to IS NOT NULL").limit(1).count():
        other = now.select(F.col("id").alias("to"), F.col("to").alias("then"),
                           F.col("value").alias("theirs"))
        both = now.join(other, "to", "left")
        work = lambda then, own, theirs: (
            then, own if theirs is None else compose(own, theirs))
        now = stage(_map_chunks(both, ["then", "value", "theirs"], work,
                                "to bigint, value array<bigint>"), label)
    return now.select("id", "value")


def _product(own: list[int], other: list[int]) -> list[int]:
    a, b = np.array(own).reshape(4, 4), np.array(other).reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR).ravel().tolist()


def _end_costs(chain: DataFrame, fixups: int) -> DataFrame:
    """(id, end): costs behind each chunk of ``chain`` (id, next, codes), less a constant."""
    def first(codes, then):
        end = END if then is None else (0, 0, 0, 0)
        return list(end), list(begin_costs(codes, end)), False

    def again(codes, end, begin, theirs):
        if theirs is None or level(theirs) == level(end):
            return end, begin, False
        new = fixed_up(codes, tuple(end), tuple(begin), tuple(theirs))
        return theirs, list(new), True

    shape = "end array<bigint>, begin array<bigint>, again boolean"
    names = ["codes", "next"]
    now = stage(chain.join(_map_chunks(chain, names, first, shape), "id"), "repair-costs")
    for _ in range(fixups):
        theirs = now.select(F.col("id").alias("next"), F.col("begin").alias("theirs"))
        moved = _map_chunks(now.join(theirs, "next", "left"), ["codes", "end", "begin", "theirs"],
                            again, shape)
        now = stage(chain.join(moved, "id"), "repair-costs")
        if not now.where("again").limit(1).count():
            return now.select("id", "end")
    parts = chain.select("id", F.col("next").alias("to"), "codes")
    parts = _map_chunks(parts, ["to", "codes"], lambda to, codes: (to, matrix(codes).ravel().tolist()),
                        "to bigint, value array<bigint>")
    whole = _map_chunks(_doubled(parts, _product, "repair-matrices"), ["value"], lambda m: (
        list(level((np.array(m).reshape(4, 4) + np.array(END)).min(axis=1).tolist())),),
        "theirs array<bigint>")
    theirs = whole.select(F.col("id").alias("next"), "theirs")
    return chain.join(theirs, "next", "left").select(
        "id", F.coalesce("theirs", F.array(*map(F.lit, END)).cast("array<bigint>")).alias("end"))


def plan_repairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", chunk: int = CHUNK, fixups: int = FIXUPS) -> DataFrame:
    """The edits of all conversations, a row per chunk of turns (written in the shared folder).

    (c, turn, role, th) of the chunk's first turn, ``id`` (their order), ``edits``, their ``cost``,
    and the numbers ``blank``, ``duplicate``, ``truncated`` and ``illegal``.

    A conversation is all rows of one ``conv`` (null is one like others) by ``turn``, nulls first;
    equal turns go by role and a hash of the text.  Null roles and texts are one space.  A row is
    blank if it shows no character, else a duplicate if its role and text came before in the
    conversation, else truncated if it does not end in ``.``, ``!`` or ``?``.  Blank rows and
    duplicates must go.  A pair of neighbours is illegal unless its roles begin s-u, u-a or a-u.
    An empty table has no edits.  Other columns are not looked at.
    """
    turns = stage(_faults(_turns(rows, conv, turn, role, text)), "repair-turns")
    found = stage(_chunks(turns, chunk), "repair-chunks")
    # a task's last chunk may go on in a later task; two rows a task at most are looked at
    onward = (found.where("edge").select("id", "more", F.lead("id").over(
        Window.partitionBy("c").orderBy("id")).alias("onward")).where("NOT more").drop("more"))
    linked = found.join(onward, "id", "left").withColumn(
        "next", F.when(F.col("more"), F.col("id") + 1).otherwise(F.col("onward"))).drop("onward")
    back = linked.where("next IS NOT NULL").select(
        F.col("next").alias("id"), F.col("id").alias("previous"), F.col("codes").alias("theirs"))
    linked = stage(linked.join(back, "id", "left"), "repair-linked")
    chain = linked.where("next IS NOT NULL OR previous IS NOT NULL")

    def seams(codes, before, theirs):
        roles = np.frombuffer(codes, np.uint8) & 3
        was = before if before >= 0 else -1 if theirs is None else theirs[-1] & 3
        a, b = np.concatenate([[was], roles[:-1]]), roles
        legal = (b == USER) & ((a == SYSTEM) | (a == ASSISTANT)) | (b == ASSISTANT) & (a == USER)
        return int((~legal & (a >= 0)).sum())

    def alone(codes, before, theirs):
        _, edits, cost = _traced(codes, END, START, True)
        return edits, cost, seams(codes, before, theirs)

    def four(codes, before, theirs, end, then):
        ways = [_traced(codes, tuple(end), s, then is None) for s in range(4)]
        return ([w[0] for w in ways], [w[1] for w in ways], [w[2] for w in ways],
                seams(codes, before, theirs))

    shape = "edits string, cost bigint, illegal bigint"
    done = _map_chunks(linked.where("next IS NULL AND previous IS NULL"),
                       ["codes", "before", "theirs"], alone, shape)
    if chain.limit(1).count():
        ends = _end_costs(chain.select("id", "next", "codes"), fixups)
        ways = stage(chain.select("id", "previous").join(_map_chunks(
            chain.join(ends, "id"), ["codes", "before", "theirs", "end", "next"], four,
            "to array<bigint>, edits array<string>, costs array<bigint>, illegal bigint"), "id"),
            "repair-ways")
        reached = _doubled(ways.select("id", F.col("previous").alias("to"), F.col("to").alias("value")),
                           lambda own, theirs: [own[s] for s in theirs], "repair-states")
        came = reached.select(F.col("id").alias("previous"), F.col("value")[START].alias("state"))
        at = F.coalesce(F.col("state"), F.lit(START)).cast("int")
        done = done.union(ways.join(came, "previous", "left").select(
            "id", F.get("edits", at).alias("edits"), F.get("costs", at).alias("cost"), "illegal"))
    return stage(linked.select("c", "turn", "role", "th", "id", *COUNTED).join(done, "id"),
                 "repair-edits")


def _walked(rows: DataFrame, edits: DataFrame, names: tuple[str, ...], work: Callable, out: str):
    """Turns and edits of whole conversations in order, as batches for ``work``."""
    turns = _turns(rows, *names)
    keys = ["c", "turn", "role", "th"]
    both = (turns.select(*keys[:3], _hash("t").alias("th"), F.lit(1).alias("tag"),
                         F.lit(0).cast("bigint").alias("id"), F.col("t"),
                         F.lit(0).cast("bigint").alias("cost"))
            .union(edits.select(*keys, F.lit(0).alias("tag"), "id", F.col("edits").alias("t"), "cost")))
    return (both.repartition("c").sortWithinPartitions(*keys, "tag", "id")
            .select("c", "role", "tag", "t", "cost").mapInArrow(work, out))


def _items(batches: Iterator[pa.RecordBatch]):
    """(conversation, items) where an item is (edit, role, text) or a number to add to the cost."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

    def items(group):
        letters, last = deque(), START
        # written roles follow from the states, so they need no column of their own
        def write(edit, role=None, text=""):
            nonlocal last
            if edit == "K":
                last = INITIALS.index(role[0]) + 1
            else:
                last = NEXT[last]
                role = WRITTEN[last]
            return edit, role, text
        for _, role, tag, text, cost in group:
            if tag == 0:
                letters.extend(text)
                yield cost
                continue
            while letters[0] == "I":
                yield write(letters.popleft())
            edit = letters.popleft()
            yield ("D", role, text) if edit == "D" else write(edit, role, text)
        for edit in letters:
            yield write(edit)

    for c, group in groupby(rows(), key=lambda r: r[0]):
        yield c, items(group)


def repaired_turns(rows: DataFrame, edits: DataFrame, conv: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, edit, role, text): the repaired conversations, deleted turns left out."""
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches):
        held, types = [], None
        def peek():
            nonlocal types
            for batch in batches:
                types = types or batch.column(0).type
                yield batch
        def out():
            cols = list(zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [types, pa.int64(), *[pa.string()] * 3])],
                ["c", "position", "edit", "role", "text"])
        for c, items in _items(peek()):
            at = 0
            for item in items:
                if isinstance(item, tuple) and item[0] != "D":
                    held.append((c, at, *item))
                    at += 1
                    if len(held) >= 1024:
                        yield out()
        if held:
            yield out()

    return _walked(rows, edits, (conv, turn, role, text), run,
                   f"c {kind}, position bigint, edit string, role string, text string"
                   ).withColumnRenamed("c", conv)


def audits(rows: DataFrame, edits: DataFrame, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """(conv, cost, audit, repaired_sha256): all edit letters of a conversation, and the digest of
    its repaired ``role:text`` joined by newlines.  Texts are hashed as they pass."""
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches):
        types = None
        def peek():
            nonlocal types
            for batch in batches:
                types = types or batch.column(0).type
                yield batch
        held = []
        def out():
            cols = list(zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [types, pa.int64(), *[pa.string()] * 2])],
                ["c", "cost", "audit", "repaired_sha256"])
        for c, items in _items(peek()):
            total, letters, digest, any_yet = 0, [], hashlib.sha256(), False
            for item in items:
                if not isinstance(item, tuple):
                    total += item
                    continue
                letters.append(item[0])
                if item[0] != "D":
                    digest.update(f"{chr(10) if any_yet else ''}{item[1]}:{item[2]}".encode())
                    any_yet = True
            held.append((c, total, "".join(letters), digest.hexdigest()))
            if len(held) >= 1024:
                yield out()
        if held:
            yield out()

    return _walked(rows, edits, (conv, turn, role, text), run,
                   f"c {kind}, cost bigint, audit string, repaired_sha256 string"
                   ).withColumnRenamed("c", conv)


def summary(rows: DataFrame, edits: DataFrame, conv: str = "conv_id",
            turn: str = "turn") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal) of conversations that have rows.

    ``gaps``: whole numbers between the least and the greatest turn that no row has; nulls do not
    count.
    """
    gaps = rows.groupBy(F.col(conv).alias("c")).agg(F.coalesce(
        F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).cast("bigint").alias("gaps"))
    sums = edits.groupBy(F.col("c").alias("d")).agg(
        *(F.sum(n).cast("bigint").alias(n) for n in [*COUNTED, "illegal"]))
    return (gaps.join(sums, F.col("c").eqNullSafe(F.col("d")))
            .select(F.col("c").alias(conv), "gaps", *COUNTED, "illegal"))
