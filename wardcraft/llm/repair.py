"""Repair of conversations whose turns are blank, repeated, cut off, lost or by the wrong side, at the least cost of edits.

A dynamic program over the retained turns: a turn is kept, or given another role, after the last retained turn of each state (none, s, u,
a). What lies between is deleted, priced by prefix sums of deletions, so that a state needs only its running minimum; how many turns go in
between follows from the two roles. Equal costs are told apart by the edits' initials, the ASCII-least first: two ways that have used the
same turns never are prefixes of each other, so the lesser one stays the lesser.

A block of turns is a table from state to state of (cost, audit), and tables of neighbouring blocks are joined by minima of sums. A
conversation of up to MOST turns and BYTES of text is one group of a task; a longer one is cut into blocks over many tasks, and only its
blocks' tables, and for the digest its texts as a stream, come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, only, slices, table
from wardcraft.plans.shared import materialise

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE, END = " \t\n\x0b\f\r", (".", "!", "?")
STATES, LEGAL, NAMES = ("", "s", "u", "a"), {("s", "u"), ("u", "a"), ("a", "u")}, {"u": "user", "a": "assistant"}
#: Turns to insert between two retained ones, and after the last, so that initials read s?(ua)+ or nothing. Other pairs can't be.
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
MOST, BYTES, BLOCK = 10_000, 8 << 20, 512


class Turn(NamedTuple):
    turn: int | None
    initial: str
    blank: bool
    duplicate: bool
    cut: bool


Way = tuple[int, str]


def transfer(turns: list[Turn], starts: Iterable[str]) -> dict[str, dict[str, Way]]:
    """By the state before the turns: the cheapest (cost, audit) for each state after them."""
    out = {}
    for start in starts:
        best = {start: (0, "", 0)}  # cost less the deletions of all turns before its end, audit, turns used
        for j, t in enumerate(turns):
            if t.blank or t.duplicate:
                continue
            new: dict[str, Way] = {}
            for role in STATES[1:]:
                own = role == t.initial
                if role == "s" and not own:
                    continue
                price = DELETE * j + CUT * t.cut + (0 if own else REROLE)
                for state, (cost, audit, used) in best.items():
                    n = BETWEEN.get((state, role))
                    if n is not None and (role not in new or cost + price + INSERT * n <= new[role][0]):
                        way = (cost + price + INSERT * n, audit + "D" * (j - used) + "I" * n + ("K" if own else "R"))
                        if role not in new or way < new[role]:
                            new[role] = way
            for role, (cost, audit) in new.items():
                cost -= DELETE * (j + 1)
                if role not in best or cost < best[role][0] or (cost == best[role][0] and audit < best[role][1] + "D" * (j + 1 - best[role][2])):
                    best[role] = (cost, audit, j + 1)
        out[start] = {s: (c + DELETE * len(turns), a + "D" * (len(turns) - used)) for s, (c, a, used) in best.items()}
    return out


class Repair:
    """Counts and ways of the turns so far, in order."""

    def __init__(self):
        self.n = self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.ways: dict[str, Way] = {"": (0, "")}

    def add(self, turns: list[Turn], table: dict[str, dict[str, Way]] | None = None) -> None:
        """The next turns; table is their transfer, where that is known."""
        faults = [t.blank or 2 * t.duplicate or 3 * t.cut for t in turns]
        self.count([t.turn for t in turns], [t.initial for t in turns], [faults.count(k) for k in (1, 2, 3)])
        self.join(table or transfer(turns, self.ways))

    def count(self, numbers: list, initials: list[str], faults: list[int]) -> None:
        known = [x for x in numbers if x is not None]
        if known:
            self.distinct += len(set(known)) - (known[0] == self.high)
            self.low, self.high = (known[0] if self.low is None else self.low), known[-1]
        pairs = zip(initials if self.last is None else [self.last, *initials], initials[1:] if self.last is None else initials, strict=False)
        self.illegal += sum(p not in LEGAL for p in pairs)
        self.last = initials[-1] if initials else self.last
        self.blank, self.duplicate, self.truncated, self.n = self.blank + faults[0], self.duplicate + faults[1], self.truncated + faults[2], self.n + len(initials)

    def join(self, table: dict[str, dict[str, Way]]) -> None:
        found: dict[str, Way] = {}
        for start, (cost, audit) in self.ways.items():
            for state, (c, a) in table[start].items():
                if state not in found or cost + c <= found[state][0]:
                    way = (cost + c, audit + a)
                    if state not in found or way < found[state]:
                        found[state] = way
        self.ways = found

    def result(self) -> list:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        cost, audit = min((c + INSERT * AFTER[s], a + "I" * AFTER[s]) for s, (c, a) in self.ways.items())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit]


def repaired(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the edits leave of (role, text)."""
    last, left = "", iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["a" if last == "u" else "u"]
        last = role[:1]
        yield edit, role, text


class Digest:
    """SHA-256 of role:text lines."""

    def __init__(self):
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * self.begun}{role}:{text}".encode())
        self.begun = True


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PLAN = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _plans(rows: list[list]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    return as_batch(["conv_id", *_COUNTS, "audit", "repaired_sha256"], [*[pa.int64()] * 7, pa.string(), pa.string()], columns)


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def _faults(turn, role: str, text: str, duplicate: bool) -> Turn:
    bare = text.strip(SPACE)
    return Turn(turn, role[:1], not bare, duplicate, not bare.endswith(END))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id and turn -> a row per conversation."""
    only(None)
    done: list[list] = []
    now, rows = ..., []

    def close():
        seen, made, digest = set(), Repair(), Digest()
        turns = []
        for turn, role, text in rows:
            turns.append(_faults(turn, role, text, (role, text) in seen))
            seen.add((role, text))
        for k in range(0, len(turns), BLOCK):
            made.add(turns[k : k + BLOCK])
        found = made.result()
        for _, role, text in repaired(found[-1], ((r, x) for _, r, x in rows)):
            digest.add(role, text)
        return [now, *found, digest.sha.hexdigest()]

    for conv, turn, role, text, gone in _runs(batches, "conv_id", "turn", "role", "text", "gone"):
        if conv != now:
            if now is not ...:
                done.append(close())
            now, rows = conv, []
            if len(done) == 1000:
                yield _plans(done)
                done = []
        if not gone:
            rows.append((turn, role, text))
    if now is not ...:
        yield _plans([*done, close()])


_BLOCK = "conv_id long, block long, turns array<long>, initials array<string>, faults array<long>, ways array<struct<start:string,state:string,cost:long,audit:string>>"
_WAYS = pa.list_(pa.struct([("start", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by block and place -> the table of each block of a conversation."""
    only(None)
    now, turns = None, []

    def close():
        found = transfer(turns, STATES)
        ways = [{"start": s, "state": e, "cost": c, "audit": a} for s, by in found.items() for e, (c, a) in by.items()]
        faults = [t.blank or 2 * t.duplicate or 3 * t.cut for t in turns]
        cols = [[now[1]], [now[0]], [[t.turn for t in turns]], [[t.initial for t in turns]], [[faults.count(k) for k in (1, 2, 3)]], [ways]]
        return as_batch(["conv_id", "block", "turns", "initials", "faults", "ways"], [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), _WAYS], cols)

    for block, conv, turn, initial, blank, duplicate, cut in _runs(batches, "block", "conv_id", "turn", "initial", "blank", "duplicate", "cut"):
        if (block, conv) != now:
            if turns:
                yield close()
            now, turns = (block, conv), []
        turns.append(Turn(turn, initial, blank, duplicate, cut))
    if turns:
        yield close()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conv_id and place -> conv_id, the counts and the audit."""
    only(None)
    now, made = ..., Repair()
    out = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([now, *made.result()], [*[pa.int64()] * 7, pa.string()], strict=True)], ["conv_id", *_COUNTS, "audit"])
    for conv, turns, initials, faults, ways in _runs(batches, "conv_id", "turns", "initials", "faults", "ways"):
        if conv != now:
            if now is not ...:
                yield out()
            now, made = conv, Repair()
        made.count(turns, initials, faults)
        by: dict[str, dict[str, Way]] = {s: {} for s in STATES}
        for w in ways:
            by[w["start"]][w["state"]] = (w["cost"], w["audit"])
        made.join(by)
    if now is not ...:
        yield out()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows sorted by conv_id and place, the audit before the turns -> (conv_id, iterator of (edit, role, text)), to be read in turn."""
    rows = _runs(batches, "conv_id", "audit", "role", "text")
    held = next(rows, None)
    while held:
        conv, audit = held[:2]
        held = None

        def turns(conv=conv):
            nonlocal held
            for row in rows:
                if row[1] is not None:
                    held = row
                    return
                yield row[2:]

        left = turns()
        yield conv, repaired(audit, left)
        for _ in left:  # what wasn't read
            pass


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(None)
    for conv, turns in _edited(batches):
        digest = Digest()
        for _, role, text in turns:
            digest.add(role, text)
        yield as_batch(["conv_id", "repaired_sha256"], [pa.int64(), pa.string()], [[conv], [digest.sha.hexdigest()]])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(None)
    names, types = ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for conv, turns in _edited(batches):
        held, size = [], 0
        for place, t in enumerate(turns):
            held.append((conv, place, *t))
            size += len(t[2])
            if len(held) == 1000 or size > BYTES:
                yield as_batch(names, types, [list(c) for c in zip(*held, strict=True)])
                held, size = [], 0
        if held:
            yield as_batch(names, types, [list(c) for c in zip(*held, strict=True)])


def with_audits(rows: DataFrame, plans: DataFrame, *order: str) -> DataFrame:
    """conv_id, audit, role, text: the audit of each conversation, then its turns, in a task's order."""
    both = rows.where("not gone").select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", *[c for c in order if c not in ("role", "text")])
    first = plans.select("conv_id", "audit", *[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in both.columns[2:]])
    both = both.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *order)
    return both.select("conv_id", "audit", "role", "text")


def _long(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """As _short, by blocks over all tasks: turns are numbered in sorted ranges, repeated ones found by groups, blocks' tables joined."""
    sorted_ = rows.repartitionByRange("conv_id", "turn", "role", "sha").sortWithinPartitions("conv_id", "turn", "role", "sha")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    placed = sorted_.select("*", F.monotonically_increasing_id().alias("place"), (F.length(bare) == 0).alias("blank"), (~F.right(bare, F.lit(1)).isin(*END)).alias("cut"))
    placed = materialise(spark, placed, "turns")
    turns = placed.where("not gone")
    again = turns.groupBy("conv_id", "role", "sha").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), "first")
    flat = turns.drop("text").join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
    flat = flat.select(F.expr(f"place div {BLOCK}").alias("block"), "place", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("duplicate"), "cut")
    blocks = materialise(spark, flat.repartition("block").sortWithinPartitions("block", "place").mapInArrow(_blocks, _BLOCK), "blocks")
    empty = placed.groupBy("conv_id").agg(F.bool_and("gone").alias("none")).where("none").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.lit("").alias("audit"))
    found = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_joined, "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")
    found = materialise(spark, found.unionByName(empty), "audits")
    digests = with_audits(placed, found, "place").mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, sha; nulls of role and text are one space."""
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    return rows.withColumn("sha", F.sha2("text", 256))


def repair(spark: SparkSession, conversations: DataFrame, most: int = MOST, bytes_: int = BYTES) -> DataFrame:
    """conversations(conv_id, turn, role, text, gone boolean?) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A row per conv_id, a null one included. Turns stand by number, nulls first, ties by role and then by the SHA-256 of the text; rows that are
    `gone` only name their conversation. A null role or text is one space; a turn whose role is empty or begins with
    another letter than s, u, a can't be kept as it is; other columns are ignored; an empty table gives no rows.
    """
    rows = _rows(conversations)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).where((F.col("n") > most) | (F.col("b") > bytes_))
    long = materialise(spark, sizes.select(F.col("conv_id").alias("c")), "long")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    none = long.isEmpty()
    short = rows if none else rows.join(long, same, "left_anti")
    out = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "sha").select("conv_id", "turn", "role", "text", "gone").mapInArrow(_short, _PLAN)
    return out if none else out.unionByName(_long(spark, rows.join(long, same, "left_semi")))


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """conversations and what repair gives for them -> conv_id, place, edit (K, R or I), role, text of the repaired turns."""
    return with_audits(_rows(conversations), plans, "turn", "role", "sha").mapInArrow(_turns, "conv_id long, place long, edit string, role string, text string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows lost, emptied, without their ends, repeated or given to the user, by crc32 of conv_id:turn modulo 20; lost ones stay as `gone`."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    named = [F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")]
    c = c.withColumn("k", F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = c.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.drop("col")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, damage(table(spark, sf_dir, "conversations")))
