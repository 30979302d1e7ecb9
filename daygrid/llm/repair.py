"""Repair of conversations whose turns are blank, repeated, cut off or out of order, at the least cost.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks, and cut into
segments of bounded size. Tables over blocks of symbols (`edits`) give each segment's costs from state to state; a
conversation's segments are joined by these small matrices, then each segment is expanded backward for its own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm import edits
from daygrid.llm.common import BLANKS, alone, ddl, fields, prepare, record, written

#: Turns and characters of text that a segment holds; a longer text is a segment of its own.
SEGMENT_TURNS, SEGMENT_CHARS = 1024, 1 << 16
_ROLES = {"": edits.NAMELESS, "s": edits.SYSTEM, "u": edits.USER, "a": edits.ASSISTANT}
_LEGAL = {(edits.SYSTEM, edits.USER), (edits.USER, edits.ASSISTANT), (edits.ASSISTANT, edits.USER)}
_LEGAL_CODES = np.array([(a, b) in _LEGAL for a in range(5) for b in range(5)]).reshape(5, 5)
_SEGMENTS = fields(conv_id=pa.int64(), segment=pa.int64(), codes=pa.binary(), matrix=pa.binary(), first_turn=pa.int64(), last_turn=pa.int64(), turns=pa.int64(),
                   roles=pa.list_(pa.string()), texts=pa.list_(pa.string()))
_BORDERS = fields(segment=pa.int64(), before=pa.binary(), live=pa.binary(), cost=pa.int64())
_EDITS = fields(conv_id=pa.int64(), segment=pa.int64(), cost=pa.int64(), ops=pa.list_(pa.binary()), exits=pa.binary())
_REPORT = fields(conv_id=pa.int64(), gaps=pa.int64(), blank=pa.int64(), duplicate=pa.int64(), truncated=pa.int64(), illegal=pa.int64(), cost=pa.int64(),
                 audit=pa.string(), repaired_sha256=pa.string())
_TURNS = fields(conv_id=pa.int64(), position=pa.int64(), role=pa.string(), text=pa.string())
#: Letters of the report for the instructions of `edits`.
_AUDIT = bytes.maketrans(bytes([edits.AS_USER, edits.AS_ASSISTANT, edits.NEW_USER, edits.NEW_ASSISTANT]), b"RRII")


def plain(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Only conversation, turn, role and text under fixed names; a null role or text is one space."""
    prepare(conversations.sparkSession)
    c = lambda name, kind: F.col(f"`{name}`").cast(kind)
    return conversations.select(c(conv_col, "long").alias("conv_id"), c(turn_col, "long").alias("turn"), F.coalesce(c(role_col, "string"), F.lit(" ")).alias("role"),
                                F.coalesce(c(text_col, "string"), F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("n"))


def damaged(rows: DataFrame) -> DataFrame:
    """Known damage, by the crc32 of `conversation:turn` (a null is one space) modulo 20: 0 drops the row, 1 empties the
    text, 2 takes its full stops, exclamation and question marks, 3 repeats the row, 4 gives it to the user. A dropped
    row stays as a row that stands no time, so that its conversation is not lost."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    gone = hit == 0
    text = F.when(gone | (hit == 1), "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(gone, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn in parallel ranges; before each row that is the first with its role and text stands
    a mark of the same key. Equal rows are one with their number, so no key is frequent."""
    once = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("h", F.unhex(F.sha2("text", 256))), "turns")
    some = once.where(F.col("n") > 0)
    none, least = F.max(F.col("turn").isNull()), F.min("turn")
    firsts = some.groupBy("conv_id", "role", "h").agg(F.when(~none, least).alias("turn"))
    marks = firsts.select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "h", F.lit(0).alias("kind"))
    key: list[Column] = [F.col(c) for c in ("conv_id", "turn", "role", "h")]
    return marks.unionByName(once.withColumn("kind", F.lit(1))).repartitionByRange(*key).sortWithinPartitions(*key, "kind")


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    number = TaskContext.get().partitionId() << 36
    here, marked = (), None
    codes, roles, texts, seen, size = bytearray(), [], [], [], 0
    done: list[tuple] = []

    def close():
        nonlocal number, size
        done.append((here[0], number, bytes(codes), seen[0] if seen else None, seen[-1] if seen else None, len(seen), tuple(roles), tuple(texts)))
        codes.clear(), roles.clear(), texts.clear(), seen.clear()
        number, size = number + 1, 0

    def out():
        made = edits.transfer(edits.Segments([d[2] for d in done]), len(done))
        yield record(_SEGMENTS, *([d[k] for d in done] for k in range(3)), [m.astype("<i8").tobytes() for m in made], *([d[k] for d in done] for k in range(3, 8)))
        done.clear()

    for batch in batches:
        faults = np.where(pc.equal(pc.utf8_length(pc.utf8_trim(batch.column("text"), BLANKS)), 0).fill_null(False), edits.BLANK,
                          np.where(pc.match_substring_regex(batch.column("text"), r"[.!?][ \t\n\v\f\r]*\z").fill_null(True), edits.CLEAN, edits.TRUNCATED)).tolist()
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h", "kind", "text", "n")]
        for conv, turn, role, h, kind, text, n, fault in zip(*columns, faults, strict=True):
            if here != (conv,):
                if here and (codes or not kept):
                    close()
                here, kept = (conv,), False
            if kind == 0:
                marked = (conv, turn, role, h)
                continue
            if n == 0:
                continue
            kept = True
            symbol = _ROLES.get(role[:1], edits.OTHER) * 4
            first = fault if fault == edits.BLANK or marked == (conv, turn, role, h) else edits.DUPLICATE
            again = fault if fault == edits.BLANK else edits.DUPLICATE
            if first < edits.BLANK:
                if size and size + len(text) > SEGMENT_CHARS:
                    close()
                roles.append(role)
                texts.append(text)
                size += len(text)
            codes.append(symbol + first)
            if turn is not None and (not seen or seen[-1] != turn):
                seen.append(turn)
            n -= 1
            while n or len(codes) >= SEGMENT_TURNS:
                more = min(n, SEGMENT_TURNS - len(codes))
                codes.extend(bytes([symbol + again]) * more)
                n -= more
                if len(codes) >= SEGMENT_TURNS:
                    close()
                    if turn is not None and n:
                        seen.append(turn)
        if done:
            yield from out()
    if here and (codes or not kept):
        close()
    if done:
        yield from out()


def _borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows by conversation and segment: a vector before and the states worth reaching after each segment."""
    alone()
    here, waiting, numbers = (), [], []
    rows: list[tuple] = []

    def close():
        before, live, cost = edits.borders(waiting)
        rows.extend((n, np.array(b, "<i8").tobytes(), bytes(a), cost) for n, b, a in zip(numbers, before, live, strict=True))
        waiting.clear(), numbers.clear()

    for batch in batches:
        for conv, number, matrix in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "matrix")), strict=True):
            if here != (conv,) and here:
                close()
            here = (conv,)
            waiting.append(np.frombuffer(matrix, "<i8").reshape(edits.STATES, edits.STATES))
            numbers.append(number)
        if rows:
            yield record(_BORDERS, *map(list, zip(*rows, strict=True)))
            rows.clear()
    if here:
        close()
        yield record(_BORDERS, *map(list, zip(*rows, strict=True)))


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's cheapest instructions from every state it may be entered in, and the states they lead to."""
    alone()
    for batch in batches:
        if not batch.num_rows:
            continue
        segments = edits.Segments(batch.column("codes").to_pylist())
        t = edits.tables()
        start = np.array([t.vector(np.frombuffer(b, "<i8")) for b in batch.column("before").to_pylist()], np.int32)
        live = np.array([list(b) for b in batch.column("live").to_pylist()], bool)
        choices = segments.choices(segments.forward(start)[0], live)
        ways = [segments.follow(choices, np.full(batch.num_rows, q, np.int64)) for q in range(edits.STATES)]
        exits = np.stack([e for _, e in ways], axis=1).astype(np.uint8)
        yield record(_EDITS, batch.column("conv_id"), batch.column("segment"), batch.column("cost"), list(map(list, zip(*(ops for ops, _ in ways), strict=True))),
                     [e.tobytes() for e in exits])


def _replayed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Per segment, in order, as (conversation, segment, cost, instructions): the state goes on from one to the next."""
    alone()
    here, state, plan = (), 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if here != (row["conv_id"],):
                here, state = (row["conv_id"],), 0
            if row["kind"] == 0:
                plan = row["cost"], row["ops"][state]
                state = row["exits"][state]
            else:
                yield row["conv_id"], row, *plan


def _turns_of(row: dict, ops: bytes) -> list[tuple[str, str]]:
    """The segment's turns after its instructions."""
    out, left, codes = [], iter(zip(row["roles"], row["texts"], strict=True)), iter(row["codes"])
    for op in ops:
        if op == edits.NEW_USER or op == edits.NEW_ASSISTANT:
            out.append(("user" if op == edits.NEW_USER else "assistant", ""))
            continue
        turn = next(left) if next(codes) % 4 < edits.BLANK else None
        if op != edits.DROP:
            out.append(turn if op == edits.KEEP else ("user" if op == edits.AS_USER else "assistant", turn[1]))
    return out


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    here: tuple = ()

    def close():
        spread = 0 if low is None else last_turn - low + 1 - turns
        rows.append((here[0], spread, *map(int, faults[[edits.BLANK, edits.DUPLICATE, edits.TRUNCATED]]), illegal, total, b"".join(audit).decode(), digest.hexdigest()))

    for conv, row, cost, ops in _replayed(batches):
        if here != (conv,):
            if here:
                close()
                if len(rows) >= 2000:
                    yield record(_REPORT, *map(list, zip(*rows, strict=True)))
                    rows.clear()
            here, low, last_turn, turns, faults, illegal, total, audit, digest, end, some = (conv,), None, None, 0, np.zeros(4, np.int64), 0, 0, [], hashlib.sha256(), None, False
        codes = np.frombuffer(row["codes"], np.uint8)
        faults += np.bincount(codes % 4, minlength=4)
        roles = codes // 4
        illegal += int((~_LEGAL_CODES[roles[:-1], roles[1:]]).sum())
        if len(roles):
            illegal += end is not None and not _LEGAL_CODES[end, roles[0]]
            end = roles[-1]
        if row["first_turn"] is not None:
            turns += row["turns"] - (last_turn == row["first_turn"])
            low, last_turn = row["first_turn"] if low is None else low, row["last_turn"]
        total = cost
        audit.append(ops.translate(_AUDIT))
        made = _turns_of(row, ops)
        if made:
            digest.update(("\n" * some + "\n".join(f"{r}:{t}" for r, t in made)).encode())
            some = True
    if here:
        close()
    if rows:
        yield record(_REPORT, *map(list, zip(*rows, strict=True)))


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, position = (), 0
    for conv, row, _, ops in _replayed(batches):
        if here != (conv,):
            here, position = (conv,), 0
        made = _turns_of(row, ops)
        if made:
            yield record(_TURNS, [conv] * len(made), list(range(position, position + len(made))), [r for r, _ in made], [t for _, t in made])
        position += len(made)


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text, and how often each stands): `report` is a row per
    conversation, `turns` the repaired conversations.

    Turns go by number, nulls first; several of one number by role, then by the hash of their text. A row's fault is the first
    of: blank, duplicate (role and text seen before in the conversation), truncated (the last character that is no blank
    is none of `.!?`). Only a role's first letter counts; an empty role may be kept anywhere, any but s, u and a nowhere.
    Null conversations are one; a null role or text is one space, so such a text is blank. Rows that repeat
    are duplicates. A conversation without rows has zeros and the hash of the empty text; an empty table gives no row.
    A conversation of any length spreads over tasks but for what has to be in order: its edits by segment and the digest of its text
    are streamed by one task that holds a segment at a time (and the audit, one letter a turn). Other columns are not read.
    """

    def __init__(self, rows: DataFrame):
        self.segments = written(in_order(rows).mapInArrow(_segments, ddl(_SEGMENTS)), "segments")
        light = self.segments.select("conv_id", "segment", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
        borders = light.mapInArrow(_borders, ddl(_BORDERS))
        known = self.segments.select("conv_id", "segment", "codes").join(borders, "segment")
        self.edits = known.mapInArrow(_edits, ddl(_EDITS))

    def _streams(self) -> DataFrame:
        plans = self.edits.withColumn("kind", F.lit(0))
        turns = self.segments.drop("matrix").withColumn("kind", F.lit(1))
        both = plans.unionByName(turns, allowMissingColumns=True)
        return both.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "kind")

    def report(self) -> DataFrame:
        return self._streams().mapInArrow(_report, ddl(_REPORT))

    def turns(self) -> DataFrame:
        return self._streams().mapInArrow(_turns, ddl(_TURNS))
