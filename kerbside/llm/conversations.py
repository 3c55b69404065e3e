"""Repair of conversation structure: faults, cheapest edits and repaired turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from kerbside.llm.audit import BLANK, CLOSING, CUT, DUPLICATE, STATES, Audit, apply, chain
from kerbside.llm.store import stash

BLOCK_ROWS = 4096
BLOCK_CHARS = 1_000_000
MOST = (1 << 63) - 1
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
PIECE = (
    "part int, block int, open boolean, size bigint, least bigint, most bigint, turns bigint, first bigint, last bigint, blank bigint,"
    " duplicate bigint, truncated bigint, illegal bigint, initials string, cost bigint, audit string, "
    "edits array<struct<edit:string,role:string,text:string>>"
)
SUMMARY = "costs array<bigint>, ranks array<int>"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, turn, role, text, gone) damaged by the CRC-32 of ``id:turn`` modulo 20; nulls are written as one space.

    0 drops the row (gone), 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it, 4 makes it a user's. Others stay as they are.
    """
    def written(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", written(id_col), written(turn_col)).cast("binary")) % 20
    base = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("bigint").alias("turn"), written(role_col).alias("role"), written(text_col).alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return base.withColumn("copy", F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "id", "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k.isin(0, 1), "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (k == 0).alias("gone"),
    )


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a turn: blank, duplicate or truncated, else 0."""
    last = text.rstrip(SPACE)[-1:]
    if not last:
        return BLANK
    if seen:
        return DUPLICATE
    return 0 if last in ".!?" else CUT


class _Block:
    """Consecutive rows of one conversation in one task."""

    def __init__(self, key):
        self.key, self.turns, self.rows, self.chars = key, [], [], 0

    def add(self, turn, role, text) -> None:
        self.turns.append(turn)
        self.rows.append((role, text))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def figures(self) -> dict:
        known = [t for t in self.turns if t is not None]
        return {
            "size": len(self.rows), "least": known[0] if known else None, "most": known[-1] if known else None,
            "first": known[0] if known else None, "last": known[-1] if known else None, "turns": len(set(known)),
        }


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _gaps(least, most, turns: int) -> int:
    return 0 if least is None else min(most - least + 1 - turns, MOST)


def _solved(block: _Block) -> dict:
    """A whole conversation: its figures, audit and turns."""
    seen: set = set()
    faults = []
    for row in block.rows:
        faults.append(fault_of(row[1], row in seen))
        seen.add(row)
    initials = [role[:1] for role, _ in block.rows]
    found = Audit(initials, faults, 0)
    cost, [(_, out)] = chain([found.costs + [0] * 12], [found.ranks() + [0] * 12])
    audit = found.ends[out].text() + "I" * CLOSING[out]
    return block.figures() | _counts(faults, initials) | {"cost": cost, "audit": audit, "edits": apply(audit, block.rows, 0)}


def _counts(faults: list[int], initials: list[str]) -> dict:
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": _illegal(initials),
        "initials": (initials[0][:1] or "-") + (initials[-1][:1] or "-") if initials else "",
    }


def _batch(records: list[dict], names: list[str], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = []
    for n in names:
        values = [r.get(n) for r in records]
        if n == "edits":
            values = [None if v is None else [dict(zip(("edit", "role", "text"), e)) for e in v] for v in values]
        columns.append(pa.array(values, types[n]))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _arrow(schema: StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return {f.name: f.type for f in to_arrow_schema(schema)}


def _emitting(records: Iterator[dict], names: list[str], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Records as batches of bounded size."""
    held: list[dict] = []
    size = 0
    for r in records:
        held.append(r)
        size += 1 + r.get("size", 0) + r.get("chars", 0) // 64
        if size >= 2 * BLOCK_ROWS:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cheapest edits of conversations: (report, pieces).

    rows are (id, turn, role, text, gone); role and text are not null. A conversation's turns
    are taken by ``turn``, nulls first; rows of one turn by role, then by the first 64 characters
    of the text, then by its hash. Rows that are ``gone`` only say that a conversation exists.
    A turn's first fault counts: blank (nothing but ASCII white space), duplicate (role and text of an earlier turn),
    truncated (its last other character is none of ``.!?``). Kept turns cost 0, reroled ones (to user or assistant) 1,
    deleted ones 2 (blank and duplicate ones must go), inserted empty user or assistant turns 5, and a truncated
    turn that stays 5 more. The cheapest edits whose role initials read ``(s?(ua)+)?`` win, of equal ones the
    first in ASCII order of D, I, K, R.

    report has one row for each id (null is an id): gaps, blank, duplicate, truncated, illegal (neighbours
    whose role initials are not su, ua or au; an empty role has no initial), cost, audit and repaired_sha256 (of ``role:text`` of
    the turns left, joined by line feeds). gaps ends at the largest long. Without turns all are 0 and the audit is empty. pieces holds the edits in order: (id, part, block, open, edits
    as an array of (edit, role, text), null where a turn goes); conversations with ``open`` pieces may have several.
    An empty table gives no rows.

    Rows are dealt by range over id, turn and content, so a conversation of any size is
    spread over tasks; equal rows as well. Whole conversations inside a task are solved there. The others, at the ends of a
    task's range or longer than a block, are blocks: repeated turns are found by one aggregate over role and text, each
    block gives its costs from every state to every other, a chain over the blocks of a conversation picks their states, and each block then
    gives its edits. Only the audit of a conversation, one letter a turn, is ever whole in one place.
    """
    kind = rows.schema["id"].dataType.simpleString()
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_start").asc(), F.col("_hash").asc(), F.col("_salt").asc()]
    salted = rows.withColumns({"_start": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_salt": F.xxhash64(F.monotonically_increasing_id())})
    ordered = salted.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "turn", "role", "text", "gone")
    names = [f.split()[0] for f in re.split(r", (?![a-z]+:)", PIECE)]
    schema = f"id {kind}, {PIECE}"
    struct = StructType.fromDDL(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, types = TaskContext.get().partitionId(), _arrow(struct)

        def raw(block: _Block, number: int) -> dict:
            edits = [(None if t is None else str(t), r, x) for t, (r, x) in zip(block.turns, block.rows)]
            return block.figures() | {"id": block.key, "part": part, "block": number, "open": True, "edits": edits, "chars": block.chars}

        def records() -> Iterator[dict]:
            block, number, first = None, 0, True
            for batch in batches:
                for key, turn, role, text, gone in zip(*[c.to_pylist() for c in batch.columns]):
                    if block is None or key != block.key or block.full():
                        if block is not None:
                            if key == block.key:
                                yield raw(block, number)
                                number += 1
                            elif first or number:
                                yield raw(block, number)
                                first, number = False, 0
                            else:
                                yield _solved(block) | {"id": block.key, "part": part, "block": 0, "open": False, "chars": block.chars}
                        block = _Block(key)
                    if not gone:
                        block.add(turn, role, text)
            if block is not None:
                yield raw(block, number)  # it may go on in the next task

        yield from _emitting(records(), ["id", *names], types)

    pieces = stash(ordered.mapInArrow(split, schema), "conversations")
    whole = pieces.where(~F.col("open"))
    at = ["id", "part", "block"]

    # earlier turns with the same role and text, over all blocks of a conversation
    turns = pieces.where("open").select(*at, F.posexplode("edits").alias("pos", "e"))
    digest = F.sha2(F.concat(F.length("e.role").cast("string"), F.lit(":"), F.col("e.role"), F.col("e.text")).cast("binary"), 256)
    firsts = turns.groupBy("id", digest.alias("digest")).agg(F.min(F.struct("part", "block", "pos")).alias("s"))
    firsts = firsts.groupBy(F.col("id").alias("_id"), F.col("s.part").alias("_part"), F.col("s.block").alias("_block")).agg(F.collect_list("s.pos").alias("firsts"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))
    marked = pieces.where("open").join(firsts, same, "left").select("id", *names, "firsts")
    plan_struct = StructType.fromDDL(f"{schema}, faults array<int>, {SUMMARY}")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _arrow(plan_struct)

        def records() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):  # a block at a time
                    [r] = batch.slice(i, 1).to_pylist()
                    new = set(r["firsts"] or ())
                    rows_ = [(e["role"], e["text"]) for e in r["edits"]]
                    faults = [fault_of(text, k not in new) for k, (_, text) in enumerate(rows_)]
                    initials = [role[:1] for role, _ in rows_]
                    audits = [Audit(initials, faults, p) for p in range(STATES)]
                    r["edits"] = [(e["edit"], e["role"], e["text"]) for e in r["edits"]]
                    yield r | _counts(faults, initials) | {
                        "faults": faults, "costs": [c for a in audits for c in a.costs], "ranks": [k for a in audits for k in a.ranks()],
                    }

        yield from _emitting(records(), ["id", *names, "faults", "costs", "ranks"], types)

    blocks = stash(marked.mapInArrow(summarise, plan_struct), "blocks")
    linked_schema = f"id {kind}, part int, block int, entry int, leave int, closing int, gaps bigint, illegal bigint, cost bigint"

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "block"])
        cost, path = chain(list(frame["costs"]), list(frame["ranks"]))
        initials = [i for i in frame["initials"] if i]
        across = sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = frame[frame["turns"] > 0]
        gaps, ends = 0, [(None if pd.isna(x) else int(x)) for x in known["last"]]
        if len(known):
            shared = sum(a == int(b) for a, b in zip(ends, known["first"].iloc[1:]))
            gaps = _gaps(int(known["least"].iloc[0]), int(known["most"].iloc[-1]), int(known["turns"].sum()) - shared)
        out = frame[["id", "part", "block"]].copy()
        out["entry"], out["leave"] = [p for p, _ in path], [q for _, q in path]
        out["closing"] = [0] * (len(path) - 1) + [CLOSING[path[-1][1]]]
        lead = [True] + [False] * (len(path) - 1)  # totals stand in the first block's row
        out["gaps"], out["cost"] = [gaps * x for x in lead], [cost * x for x in lead]
        out["illegal"] = [int(n) + across * x for n, x in zip(frame["illegal"], lead)]
        return out

    narrow = blocks.select(*at, "least", "most", "turns", "first", "last", "illegal", "initials", "costs", "ranks")
    # longs with nulls would become doubles
    narrow = narrow.withColumns({c: F.col(c).cast("string") for c in ("least", "most", "first", "last")})
    links = narrow.groupBy("id").applyInPandas(link, linked_schema)
    links = links.withColumnsRenamed({c: f"_{c}" for c in links.columns})
    joined = blocks.join(links, same, "inner").select(*[F.col(n) for n in ("id", *names) if n not in ("cost", "illegal")], "faults", F.col("_entry").alias("entry"), F.col("_leave").alias("leave"), F.col("_closing").alias("closing"), F.col("_gaps").alias("gaps"), F.col("_illegal").alias("illegal"), F.col("_cost").alias("cost"))
    done_struct = StructType.fromDDL(f"{schema}, gaps bigint")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _arrow(done_struct)

        def records() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    [r] = batch.slice(i, 1).to_pylist()
                    rows_ = [(e["role"], e["text"]) for e in r["edits"]]
                    found = Audit([role[:1] for role, _ in rows_], r["faults"], r["entry"])
                    r["audit"] = found.ends[r["leave"]].text() + "I" * r["closing"]
                    r["edits"] = apply(r["audit"], rows_, r["entry"])
                    yield r

        yield from _emitting(records(), ["id", *names, "gaps"], types)

    open_pieces = stash(joined.mapInArrow(finish, done_struct), "repaired")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    totals = open_pieces.groupBy("id").agg(
        F.sum("gaps").alias("gaps"), *[F.sum(c).alias(c) for c in counts],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    gap = F.when(F.col("least").isNull(), 0).otherwise(F.least(F.col("most").cast("decimal(38,0)") - F.col("least") + 1 - F.col("turns"), F.lit(MOST).cast("decimal(38,0)")).cast("bigint"))
    left = F.transform(F.filter("edits", lambda e: e["role"].isNotNull()), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    sha = F.sha2(F.array_join(left, "\n").cast("binary"), 256).alias("repaired_sha256")
    hashed = _digests(open_pieces.select("id", left.alias("lines"), "part", "block"))
    totals = totals.join(hashed, F.col("id").eqNullSafe(F.col("_id")))
    report = whole.select("id", gap.alias("gaps"), *counts, "audit", sha).unionByName(totals.drop("_id"))
    columns = [*at, "open", "edits"]
    return report.select("id", *REPORT), whole.select(*columns).unionByName(open_pieces.select(*columns))


def _digests(pieces: DataFrame) -> DataFrame:
    """(_id, repaired_sha256) of conversations in several pieces.

    A task reads the pieces in order and feeds them to the hash one by one: SHA-256 can't be split,
    but it needs no memory.
    """
    struct = StructType.fromDDL(f"_id {pieces.schema['id'].dataType.simpleString()}, repaired_sha256 string")

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _arrow(struct)

        def records() -> Iterator[dict]:
            key, state, more = None, None, False
            for batch in batches:
                for i in range(batch.num_rows):
                    [k], [lines] = (c.slice(i, 1).to_pylist() for c in batch.columns[:2])
                    if state is None or k != key:
                        if state is not None:
                            yield {"_id": key, "repaired_sha256": state.hexdigest()}
                        key, state, more = k, hashlib.sha256(), False
                    for line in lines:
                        state.update((("\n" if more else "") + line).encode())
                        more = True
            if state is not None:
                yield {"_id": key, "repaired_sha256": state.hexdigest()}

        yield from _emitting(records(), list(types), types)

    return pieces.repartition("id").sortWithinPartitions("id", "part", "block").mapInArrow(feed, struct)
