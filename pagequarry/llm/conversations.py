"""Conversation structure repair: weighted CYK over intervals of turns, with a repair grammar in Chomsky normal form.

A repaired conversation reads s?(ua)+ or nothing, in initials of roles. The grammar's nonterminals are the shapes that a part of
such a sequence can have, by first and last initial: e (nothing), uu, ua, aa, au, and s, su, sa, which begin with the system's
turn. A rule joins two shapes where the last initial of the one may stand before the first of the other. The cell of an interval
of turns holds, for each shape, the cheapest edits that give it, as (cost, audit). The shapes are closed under cutting: every part
of an allowed sequence, cut at any turn, falls into two shapes. So one cut of an interval gives the same cell as all cuts do,
and cells are combined bottom-up by span length over intervals of 1, 2, 4, ... turns; the work grows with n log n and cells of parts
that lie on different machines are combined alike. Insertion closure: a turn's cell is multiplied on both sides by that of no
turn, which holds up to two inserted turns (three or more are never cheapest: two of them can go).

Taking the least (cost, audit) of each part is right for the whole: of two audits of one interval with equal cost none begins
with the other, as the longer one would have further insertions and cost more; so what is less stays less with anything behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import keep

# Costs and letters of the edits; what a turn without role or text holds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NOTHING = " "
#: Turns and bytes of text of a chunk, turns of a range of the sort, characters of a text that decide its range.
CHUNK, CHUNK_BYTES, RANGE, LEAD = 1024, 4 << 20, 20_000, 64
BLANK, REPEATED, CUT_OFF, FINE = "blank", "duplicate", "truncated", "fine"

Cell = dict[str, tuple[int, str, tuple]]
SHAPES = ("uu", "ua", "aa", "au")
_AFTER = {"s": "ua", "u": "a", "a": "u"}
#: Rules: left shape, right shape, shape of both. A right part never begins with the system's turn unless the left is empty.
RULES = [("", y, y) for y in ("", *SHAPES, "s", "su", "sa")] + [(x, "", x) for x in (*SHAPES, "s", "su", "sa")]
RULES += [(x, y, ("s" if x[0] == "s" else x[0]) + y[1]) for x in (*SHAPES, "s", "su", "sa") for y in SHAPES if y[0] in (_AFTER[x[-1]] if x != "s" else "u")]
#: Shapes of a whole conversation.
WHOLE = ("", "ua", "sa")


def product(x: Cell, y: Cell) -> Cell:
    """The cell of an interval from those of its two parts."""
    out: Cell = {}
    for a, b, c in RULES:
        if a in x and b in y:
            p, q = x[a], y[b]
            made = (p[0] + q[0], p[1] + q[1], p[2] + q[2])
            if c not in out or made < out[c]:
                out[c] = made
    return out


#: No turn: nothing, or one or two inserted ones.
EMPTY: Cell = {"": (0, "", ())} | {k: (INSERT * n, "I" * n, ()) for k, n in (("uu", 1), ("aa", 1), ("ua", 2), ("au", 2))}


def leaf(initial: str, fault: str) -> Cell:
    """The cell of one turn with its insertion closure."""
    own: Cell = {"": (DELETE, "D", ())}
    if fault not in (BLANK, REPEATED):
        more = TRUNCATED if fault == CUT_OFF else 0
        own |= {r + r: (REROLE + more, "R", ()) for r in "ua"}
        if initial in ("u", "a", "s"):
            own["s" if initial == "s" else initial * 2] = (KEEP + more, "K", ())
    return product(product(EMPTY, own), EMPTY)


_leaves: dict[tuple[str, str], Cell] = {}


def leaf_of(initial: str, fault: str) -> Cell:
    key = (initial if initial in ("u", "a", "s") else "", fault)
    if key not in _leaves:
        _leaves[key] = leaf(*key)
    return _leaves[key]


def combined(cells: list[Cell]) -> Cell:
    """The cell of a row of neighbouring intervals, bottom-up by span length."""
    while len(cells) > 1:
        cells = [product(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def repeated(cell: Cell, n: int) -> Cell:
    """The cell of n like intervals, by squaring."""
    out = None
    while n:
        if n & 1:
            out = cell if out is None else product(out, cell)
        n >>= 1
        cell = product(cell, cell) if n else cell
    return EMPTY if out is None else out


def chosen(cell: Cell) -> tuple[int, str, tuple]:
    """Cheapest edits of a whole conversation: cost, audit, shapes of its parts."""
    return min(cell[k] for k in WHOLE if k in cell)


def apply_edits(turns: Iterator[tuple[str, str]], audit: str, first: str) -> Iterator[tuple[str, str, str]]:
    """Role, text and edit of what the audit leaves of turns; first: the initial that what is left begins with."""
    due = first
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        yield (role if edit == "K" else "user" if due == "u" else "assistant"), text, edit
        due = "a" if due == "u" else "u"


# --- on tables


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of conv_id:turn decides (remainder of 20): 0 drops a row, 1 empties
    its text, 2 removes its marks [.!?], 3 repeats it, 4 makes its role user. Nulls in role, text and the key are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NOTHING))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def _keys(conv: Column, turn: Column) -> list[Column]:
    """Non-null sort keys of a conversation and a turn, nulls first."""
    return [conv.isNotNull().alias("c1"), F.coalesce(conv.cast("string"), F.lit("")).alias("c2"), turn.isNotNull().alias("t1"), F.coalesce(turn.cast("long"), F.lit(0)).alias("t2")]


def different_turns(turns: DataFrame) -> DataFrame:
    """c1, c2, t1, t2 (keys), conv_id, turn, role, text, n (how often the row occurs), first (no row with this role and text
    stands before it in its conversation). Two aggregations; the hashes that stand for texts are SHA-256."""
    h = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.select(*_keys(F.col("conv_id"), F.col("turn")), h.alias("h"), "conv_id", "turn", "role", "text")
    at = ["c1", "c2", "t1", "t2", "h"]
    once = keep(rows.groupBy(*at).agg(*[F.first(c).alias(c) for c in ("conv_id", "turn", "role", "text")], F.count("*").alias("n")))
    first = once.groupBy("c1", "c2", "h").agg(F.min(F.struct("t1", "t2")).alias("t")).select("c1", "c2", "t.t1", "t.t2", "h", F.lit(True).alias("first"))
    return once.join(first, at, "left").withColumn("first", F.coalesce("first", F.lit(False))).drop("h")


def chunks_of(turns: DataFrame) -> DataFrame:
    """Conversations in chunks of neighbouring turns: c1, c2, part, no (their order), conv_id, turns (role, text, n of each), cell,
    and figures: lowest, highest, distinct turns, blank, duplicate, truncated, illegal neighbours, first and last initial.

    Rows are sorted by ranges of conversation, turn, role and text; a conversation of any length spreads over ranges. Rows of
    one turn go by role, then text.
    """
    rows = different_turns(turns)
    ranges = max(1, -(-turns.count() // RANGE))
    order = ["c1", "c2", "t1", "t2", "role"]
    dealt = rows.repartitionByRange(ranges, *order, F.left("text", F.lit(LEAD))).sortWithinPartitions(*order, "text")
    last_mark = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+$", 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, BLANK).when(~F.col("first"), REPEATED).when(~last_mark.rlike("[.!?]"), CUT_OFF).otherwise(FINE)
    told = dealt.select("c1", "c2", "conv_id", "t1", "t2", "role", "text", "n", fault.alias("fault"), F.spark_partition_id().alias("part"))
    conv = told.schema["conv_id"].dataType.simpleString()
    names = ["c1", "c2", "part", "no", "conv_id", "turns", "cell", "low", "high", "n_turns", "low_end", "high_end", BLANK, REPEATED, CUT_OFF, "illegal", "initials"]
    kinds = ["boolean", "string", "int", "bigint", conv, "array<struct<role:string,text:string,n:bigint>>", "array<struct<shape:string,cost:bigint,audit:string>>", *["bigint"] * 9, "array<string>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        done: list[list] = []
        no, size, told_size = 0, 0, 0

        def finish() -> None:
            nonlocal no, size, held
            faults = [f for x in held for f in (x["fault"], *[BLANK if x["fault"] == BLANK else REPEATED] * (x["n"] > 1))]
            counts = [x["n"] if x["fault"] == BLANK else 0 for x in held], [x["n"] if x["fault"] == REPEATED else x["n"] - 1 if x["fault"] != BLANK else 0 for x in held], [x["fault"] == CUT_OFF for x in held]
            many = (x["n"] - 1 for x in held for _ in range(x["n"] > 1))
            initials = [x["role"][:1] for x in held]
            cells, k = [], 0
            for x, i in zip(held, initials):
                cells.append(leaf_of(i, faults[k]))
                k += 1
                if x["n"] > 1:
                    cells.append(repeated(leaf_of(i, faults[k]), next(many)))
                    k += 1
            cell = combined(cells)
            known = [x["t2"] for x in held if x["t1"]]
            wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(x["n"] - 1 for x in held)
            row = [held[0]["c1"], held[0]["c2"], held[0]["part"], no, held[0]["conv_id"], [{k: x[k] for k in ("role", "text", "n")} for x in held], [{"shape": s, "cost": c, "audit": a} for s, (c, a, _) in cell.items()]]
            row += [min(known, default=None), max(known, default=None), len(set(known)), known[0] if known else None, known[-1] if known else None, *map(sum, counts), wrong, [initials[0], initials[-1]]]
            done.append(row)
            no, size, held = no + 1, 0, []

        def told() -> pa.RecordBatch:
            nonlocal told_size
            out = pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
            told_size = 0
            return out

        for b in batches:
            for x in b.to_pylist():
                if held and (len(held) >= CHUNK or size > CHUNK_BYTES or (x["c1"], x["c2"]) != (held[-1]["c1"], held[-1]["c2"])):
                    told_size += size
                    finish()
                    if len(done) >= CHUNK or told_size > CHUNK_BYTES:
                        yield told()
                held.append(x)
                size += len(x["text"])
        if held:
            finish()
        if done:
            yield told()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return keep(told.mapInArrow(run, ddl))


def verdicts(chunks: DataFrame) -> DataFrame:
    """One row per conversation: figures, cost, audit, and edits: part, no, audit and shape of each chunk."""

    def verdict(rows: list[dict]) -> dict:
        cost, audit, shapes = chosen(combined([{e["shape"]: (e["cost"], e["audit"], (e["shape"],)) for e in r["cell"]} for r in rows]))
        cells = [{e["shape"]: e["audit"] for e in r["cell"]} for r in rows]
        edits = [{"part": r["part"], "no": r["no"], "audit": c[s], "shape": s} for r, c, s in zip(rows, cells, shapes)]
        low, high = (f((r[k] for r in rows if r[k] is not None), default=None) for f, k in ((min, "low"), (max, "high")))
        known = [r for r in rows if r["low"] is not None]
        distinct = sum(r["n_turns"] for r in known) - sum(a["high_end"] == b["low_end"] for a, b in zip(known, known[1:]))
        illegal = sum(r["illegal"] for r in rows) + sum(a["initials"][1] + b["initials"][0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        return {"c1": rows[0]["c1"], "c2": rows[0]["c2"], "gaps": high - low + 1 - distinct if known else 0, **{k: sum(r[k] for r in rows) for k in (BLANK, REPEATED, CUT_OFF)}, "illegal": illegal, "cost": cost, "audit": audit, "edits": edits}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            done = []
            for x in b.to_pylist():
                if held and (x["c1"], x["c2"]) != (held[-1]["c1"], held[-1]["c2"]):
                    done.append(verdict(held))
                    held = []
                held.append(x)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([verdict(held)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"c1 boolean, c2 string, gaps bigint, {BLANK} bigint, {REPEATED} bigint, {CUT_OFF} bigint, illegal bigint, cost bigint, audit string, edits array<struct<part:int,no:bigint,audit:string,shape:string>>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = chunks.drop("turns", "conv_id").repartition("c1", "c2").sortWithinPartitions("c1", "c2", "part", "no")
    return keep(rows.mapInArrow(run, ddl))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables from turns (conv_id, turn, role, text; other columns are ignored).

    Verdicts: one row per conversation with gaps, blank, duplicate, truncated, illegal, cost, audit (c1, c2: its key). Repaired
    turns: c1, c2, part, no, i (their order), conv_id, role, text, edit. Null roles and texts are one space, so such turns are blank
    or of an unknown role; a null conv_id is a conversation; null turns stand first. Rows of one turn go by role, then text;
    equal rows are repeats. No rows give none.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NOTHING)).alias(c)
    chunks = chunks_of(turns.select("conv_id", "turn", said("role"), said("text")))
    found = verdicts(chunks)
    edits = found.select("c1", "c2", F.explode("edits").alias("e")).select("c1", "c2", "e.*")
    both = chunks.select("c1", "c2", "part", "no", "conv_id", "turns").join(edits, ["c1", "c2", "part", "no"])
    conv = dict(chunks.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [list(apply_edits(((t["role"], t["text"]) for t in turns for _ in range(t["n"])), audit, shape[:1])) for turns, audit, shape in zip(*(b.column(c).to_pylist() for c in ("turns", "audit", "shape")))]
            of = pa.array([i for i, x in enumerate(left) for _ in x], pa.int32())
            own = [pa.array([i for x in left for i in range(len(x))], pa.int64()), *(pa.array([y[k] for x in left for y in x], pa.string()) for k in range(3))]
            keys = ["c1", "c2", "part", "no", "conv_id"]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in keys), *own], names=[*keys, "i", "role", "text", "edit"])

    return found, both.mapInArrow(run, f"c1 boolean, c2 string, part int, no bigint, conv_id {conv}, i bigint, role string, text string, edit string")


def text_hashes(repaired: DataFrame) -> DataFrame:
    """c1, c2, sha of each conversation's role:text lines. SHA-256 goes over bytes in order, so one task reads a whole
    conversation, sorted, a batch at a time, and holds the state of one hash."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, sha256()
        for b in batches:
            done = []
            for c1, c2, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (c1, c2) != last:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = (c1, c2), sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.bool_(), pa.string(), pa.string()))], names=["c1", "c2", "sha"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, state.hexdigest())], names=["c1", "c2", "sha"])

    rows = repaired.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "part", "no", "i")
    return rows.select("c1", "c2", "role", "text").mapInArrow(run, "c1 boolean, c2 string, sha string")


def repair_digest(turns: DataFrame) -> DataFrame:
    """The contract of op13: every conv_id with what became of its damaged turns."""
    found, repaired = repair(damaged(turns))
    keys = _keys(F.col("conv_id"), F.lit(None))[:2]
    all_ids = turns.select("conv_id").distinct().select("conv_id", *keys)
    out = all_ids.join(found.drop("edits"), ["c1", "c2"], "left").join(text_hashes(repaired), ["c1", "c2"], "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", BLANK, REPEATED, CUT_OFF, "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
