"""Repair of conversations whose turns are damaged, by the cheapest edits.

A conversation's turns and the states of its grammar (nothing yet, after system, after user, after
assistant) are a lattice that is never built: Dijkstra's search keeps the cheapest known way to each of
its nodes, by cost and then by the edits' initials, and stops at the first accepting end that it takes.

Rows are sorted over all tasks, a very long conversation too. A task cuts its rows into runs of one
conversation, of bounded length. A run that is a whole conversation is repaired there; of the others the
cheapest ways from each state to each state are found in parallel and joined in order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os.path
from collections.abc import Iterator
from itertools import groupby, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_type, join_to_one, materialize

#: Rows of a run at most.
RUN = 512
#: Costs of edits, and of a truncated turn that stays: fixed values.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar s?(ua)+ or nothing: states, what each takes, where that leads.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING, ROLES = {START, ASSISTANT}, {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"
#: A way through the lattice: its cost and its edits' initials.
Way = tuple[int, str]


class Turn(NamedTuple):
    """A row of a conversation; fault is blank, duplicate, truncated or nothing."""

    turn: int | None
    role: str
    text: str
    fault: str


def edits(turn: Turn, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of what can be done with a turn in a state of the grammar."""
    yield DELETE, "D", state
    if turn.fault in ("blank", "duplicate"):
        return
    more = TRUNCATED if turn.fault == "truncated" else 0
    after = GRAMMAR[state]
    if turn.role[:1] in after:
        yield KEEP + more, "K", after[turn.role[:1]]
    for initial in ROLES:
        if initial in after:
            yield REROLE + more, "R", after[initial]


def cheapest(turns: list[Turn], start: int = START, ends: set[int] | None = None) -> dict[int, Way]:
    """The cheapest way through ``turns`` from a state: to the first accepting end that the search takes, or to each of ``ends``."""
    last, want, found = len(turns), set(ends or ()), {}
    queue, done = [(0, "", 0, start)], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == last:
            if ends is None and state in ACCEPTING:
                return {state: (cost, audit)}
            if state in want:
                found[state] = (cost, audit)
                want.discard(state)
                if not want:
                    break
        else:
            for more, initial, after in edits(turns[at], state):
                if (at + 1, after) not in done:
                    heapq.heappush(queue, (cost + more, audit + initial, at + 1, after))
        for initial in ROLES:
            if initial in GRAMMAR[state] and (at, GRAMMAR[state][initial]) not in done:
                heapq.heappush(queue, (cost + INSERT, audit + "I", at, GRAMMAR[state][initial]))
    return found


def ways(turns: list[Turn]) -> list[dict[int, Way]]:
    """From each state, the cheapest way to each state that can be reached."""
    reachable = ({START, SYSTEM, USER, ASSISTANT}, {SYSTEM, USER, ASSISTANT}, {USER, ASSISTANT}, {USER, ASSISTANT})
    return [cheapest(turns, s, reachable[s]) for s in range(4)]


def repaired(turns: list[Turn], audit: str, state: int = START) -> tuple[list[str], int]:
    """The lines ``role:text`` that the edits leave, and the state after them. Where an edit may give either role, the grammar leaves one."""
    out, at = [], 0
    for edit in audit:
        turn = None
        if edit != "I":
            turn, at = turns[at], at + 1
        if edit == "D":
            continue
        if edit == "K":
            initial, role = turn.role[:1], turn.role
        else:
            initial = next(i for i in ROLES if i in GRAMMAR[state])
            role = ROLES[initial]
        state = GRAMMAR[state][initial]
        out.append(f"{role}:{turn.text if turn else ''}")
    return out, state


class Tally(NamedTuple):
    """Counts over consecutive turns, and what is needed to add those of the next ones."""

    n: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str | None
    last: str | None
    least: int | None
    most: int | None
    distinct: int

    def __add__(self, other: Tally) -> Tally:
        if not self.n or not other.n:
            return other if not self.n else self
        turns = [x for x in (self.least, other.least) if x is not None], [x for x in (self.most, other.most) if x is not None]
        return Tally(
            *(a + b for a, b in zip(self[:4], other[:4], strict=True)), self.illegal + other.illegal + (self.last + other.first not in LEGAL), self.first, other.last,
            min(turns[0], default=None), max(turns[1], default=None), self.distinct + other.distinct - (self.most is not None and self.most == other.least),
        )

    @property
    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.distinct


NOTHING = Tally(0, 0, 0, 0, 0, None, None, None, None, 0)


def tally(turns: list[Turn]) -> Tally:
    """Turns in their order, nulls first."""
    initials, numbers = [t.role[:1] for t in turns], [t.turn for t in turns if t.turn is not None]
    count = lambda f: sum(t.fault == f for t in turns)
    illegal = sum(a + b not in LEGAL for a, b in pairwise(initials))
    return Tally(len(turns), count("blank"), count("duplicate"), count("truncated"), illegal, initials[0], initials[-1], numbers[0] if numbers else None, numbers[-1] if numbers else None, len(set(numbers))) if turns else NOTHING


def joined(before: dict[int, Way], block: list[dict[int, Way]]) -> tuple[dict[int, Way], dict[int, int]]:
    """The cheapest way to each state through one block more, and from which state of the block's begin it comes.

    Two ways of one cost that end at one node are never the begin of one another, so the order of their
    initials stays whatever follows.
    """
    out, origin = {}, {}
    for s, (cost, audit) in sorted(before.items()):
        for t, (more, rest) in block[s].items():
            way = (cost + more, audit + rest)
            if t not in out or way < out[t]:
                out[t], origin[t] = way, s
    return out, origin


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after damage by crc32 of `conv_id:turn`: dropped, emptied, cut short, repeated, or given the role user; n says how often a row stands there.

    Nulls count as one space, but the turn's stays null for the order. Equal rows are one, with their number.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"))
    kind = F.pmod(F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")), F.lit(20))
    equal = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    out = equal.select("conv_id", "turn", "role", "text", role.alias("new_role"), text.alias("new_text"), (F.col("n") * F.when(F.col("kind") == 3, 2).otherwise(1)).alias("n"))
    return out


def place() -> Column:
    """What rows of a conversation are ordered by: turn, nulls first, then the role and text before damage."""
    return F.struct(F.col("turn").isNotNull().alias("z"), "turn", "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, new_role, new_text, copy (from 0) and fault of each damaged row."""
    keyed = rows.withColumn("same", F.sha2(F.to_json(F.struct("conv_id", "new_role", "new_text"), {"ignoreNullFields": "false"}), 256))
    firsts = keyed.groupBy("same").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("m"))
    # a role and text that many rows of a conversation have is dealt to several tasks
    met = join_to_one(keyed, firsts, "same", "m", ["turn", "role"])
    copied = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    visible = F.rtrim("new_text", F.lit(SPACES))
    later = (F.col("copy") > 0) | ~place().eqNullSafe(F.col("first"))
    fault = F.when(visible == "", "blank").when(later, "duplicate").when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return copied.withColumn("fault", fault).drop("same", "first", "n")


RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def result(t: Tally, way: Way, digest: str) -> tuple:
    return t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, way[0], way[1], digest


def batch_of(rows: list[tuple], columns: dict[str, str], conv_type: pa.DataType) -> pa.RecordBatch:
    """``rows`` of a conversation's id and ``columns``."""
    kinds = [conv_type, *[ARROW[k] for k in columns.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", *columns])


def schema(kind: str, columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {k}" for c, k in {"conv_id": kind, **columns}.items())


def runs_of(ordered: DataFrame, kind: str, most: int) -> DataFrame:
    """One row for each run: the result where it is a whole conversation; else its place, tally, ways and turns, as JSON."""
    columns = {"part": "int", "number": "int", **RESULT, "tally": "string", "ways": "string", "turns": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, held = TaskContext.get().partitionId(), 0, [], []

        def close(turns: list[Turn], conv, whole: bool) -> None:
            nonlocal number
            if whole:
                way = next(iter(cheapest(turns).values()))
                out.append((conv, part, number, *result(tally(turns), way, hashlib.sha256("\n".join(repaired(turns, way[1])[0]).encode()).hexdigest()), None, None, None))
            else:
                out.append((conv, part, number, *[None] * len(RESULT), json.dumps(tally(turns)), json.dumps(ways(turns)), json.dumps(turns)))
            number += 1

        # the first conversation of a task may have begun in another, the last may go on in another
        current, conv_type, begins, cut = None, None, True, False
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != current:
                    close(held, current, not begins and not cut)
                    held, cut, begins = [], False, False
                elif len(held) >= most:
                    close(held, current, False)
                    held, cut = [], True
                current = conv
                held.append(Turn(*rest))
            if out:
                yield batch_of(out, columns, conv_type)
                out.clear()
        if held:
            close(held, current, False)
            yield batch_of(out, columns, conv_type)

    return ordered.select("conv_id", "turn", "new_role", "new_text", "fault").mapInArrow(run, schema(kind, columns))


def read_ways(text: str) -> list[dict[int, Way]]:
    return [{int(t): (w[0], w[1]) for t, w in own.items()} for own in json.loads(text)]


def joined_runs(parts: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Of the conversations in several runs: results without the hash, and the initials and first state of each run.

    Tasks read the runs' tallies and ways in order, not their turns. What the ways to all states begin with
    is put aside, so the rest of their initials stays short.
    """
    columns = {"part": "int", "number": "int", "state": "int", "edits": "string", **RESULT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def read() -> Iterator[tuple]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field(0).type
                for conv, part, number, t, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield conv, part, number, Tally(*json.loads(t)), read_ways(w)

        for conv, own in groupby(read(), key=lambda r: r[0]):
            reached, total, steps, aside, size = {START: (0, "")}, NOTHING, [], [], 0
            for _, part, number, t, block in own:
                lengths = {s: size + len(w[1]) for s, w in reached.items()}
                reached, origin = joined(reached, block)
                total = total + t
                steps.append((part, number, origin, lengths))
                aside.append(os.path.commonprefix([w[1] for w in reached.values()]))
                reached = {s: (cost, audit[len(aside[-1]) :]) for s, (cost, audit) in reached.items()}
                size += len(aside[-1])
            (cost, rest), state = min((w, s) for s, w in reached.items() if s in ACCEPTING)
            audit = "".join(aside) + rest
            out, stop = [(conv, None, None, None, None, *result(total, (cost, audit), ""))], len(audit)
            for part, number, origin, lengths in reversed(steps):
                state = origin[state]
                out.append((conv, part, number, state, audit[lengths[state] : stop], *[None] * len(RESULT)))
                stop = lengths[state]
            yield batch_of(out, columns, conv_type)

    ordered = parts.select("conv_id", "part", "number", "tally", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    found = materialize(ordered.mapInArrow(run, schema(kind, columns)), "joined-runs")
    return found.filter("part is null"), found.filter("part is not null")


def hashes(parts: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """conv_id, digest: of the repaired lines of each conversation in several runs.

    Runs are repaired in parallel; one task reads their bytes in order, as a hash needs them, and holds one run.
    """

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [repaired([Turn(*t) for t in json.loads(turns)], done, state)[0] for turns, state, done in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(["".join(f"\n{x}" for x in own).encode() for own in lines], pa.binary())], names=["conv_id", "part", "number", "lines"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, first, conv_type = None, None, True, None
        for batch in batches:
            conv_type, out = batch.schema.field(0).type, []
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != current:
                    out += [(current, state.hexdigest())] if state else []
                    current, state, first = conv, hashlib.sha256(), True
                state.update(lines[1:] if first else lines)
                first = first and not lines
            if out:
                yield batch_of(out, {"digest": "string"}, conv_type)
        if state:
            yield batch_of([(current, state.hexdigest())], {"digest": "string"}, conv_type)

    met = parts.select("conv_id", F.col("part").alias("p"), F.col("number").alias("k"), "turns").join(chosen.select("part", "number", "state", "edits"), (F.col("p") == F.col("part")) & (F.col("k") == F.col("number")))
    lines = met.select("conv_id", "part", "number", "turns", "state", "edits").mapInArrow(repair, f"conv_id {kind}, part int, number int, lines binary")
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(digest, f"conv_id {kind}, digest string")


def repair_conversations(rows: DataFrame, run: int = RUN, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation of ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after damage and repair.

    Turns are whole numbers. A null role, text, turn or id counts as one space, a null turn stands first and
    isn't counted in gaps, and all rows of a null id are one conversation. Rows of one turn are ordered by
    their role and text before damage, those that are equal stand together. A role counts by its first
    character. No rows after damage: zeros, an empty audit, the hash of an empty string. No rows: no rows.
    Conversations and texts of any length are taken whole: one of more than ``run`` rows goes through
    several tasks. Other columns are not read, so their names can't clash.
    """
    kind = id_type(rows, id_col)
    plain = rows.select(*[F.col(f"`{c}`").alias(name) for c, name in ((id_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    faulty = materialize(with_faults(damaged(plain.withColumn("turn", F.col("turn").cast("long")))), "turns")
    ordered = faulty.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    found = materialize(runs_of(ordered, kind, run), "runs")
    parts = found.filter("tally is not null")
    several, chosen = joined_runs(parts, kind)
    digests = hashes(parts, chosen, kind).withColumnRenamed("conv_id", "own")
    whole = several.join(digests, F.col("conv_id").eqNullSafe(F.col("own"))).withColumn("repaired_sha256", F.col("digest")).select("conv_id", *RESULT)
    done = found.filter("tally is null").select("conv_id", *RESULT).unionByName(whole).withColumnRenamed("conv_id", "own")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return plain.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *[F.coalesce(c, F.lit(nothing.get(c, 0))).alias(c) for c in RESULT])
