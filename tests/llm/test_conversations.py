"""Conversation repair against a search over all edits, and against a parse that cuts every interval everywhere."""

import itertools
import random
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest

from pagequarry.llm import conversations as c
from pagequarry.llm.base import table
from pagequarry.llm.queries import op13_conversation_repair
from tests.conftest import DATA


def searched(rows):
    """Cheapest (cost, audit) by trying all edits of rows (initial, fault), up to two insertions at each place."""

    def allowed(out):
        return re.fullmatch("(s?(ua)+)?", out)

    best = None
    options = []
    for initial, fault in rows:
        own = [("D", "", 4)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own += [("K", initial, more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        options.append(own)
    gaps = [("", "", 0), ("I", "u", 3), ("I", "a", 3), ("II", "ua", 6), ("II", "au", 6)]
    for picked in itertools.product(*options):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(x[2] for x in (*picked, *put))
            if best and cost > best[0]:
                continue
            out = "".join(p[1] + (picked[i][1] if i < len(rows) else "") for i, p in enumerate(put))
            if allowed(out):
                audit = "".join(p[0] + (picked[i][0] if i < len(rows) else "") for i, p in enumerate(put))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def everywhere(rows):
    """The same by a table over all intervals and all cuts of each, with the textbook grammar: whole: e | ua | s ua."""

    @lru_cache(None)
    def cell(i, j):
        if j - i == 1:
            return c.leaf_of(*rows[i])
        out = {}
        for k in range(i + 1, j):
            for shape, entry in c.product(cell(i, k), cell(k, j)).items():
                out[shape] = min(out.get(shape, entry), entry)
        return out

    return c.chosen(cell(0, len(rows)))[:2] if rows else (0, "")


def some_rows(rng, n):
    return [(rng.choice("usaaux"), rng.choice(["fine", "fine", "fine", "truncated", "blank", "duplicate"])) for _ in range(n)]


def test_cells_against_search():
    rng = random.Random(1)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3):
        for _ in range(3 if n == 3 else 12):
            rows = some_rows(rng, n)
            assert c.chosen(c.combined([c.leaf_of(*r) for r in rows]))[:2] == searched(rows), rows


def test_one_cut_is_as_good_as_all():
    rng = random.Random(2)
    for n in (4, 5, 7, 9, 12, 20):
        for _ in range(4):
            rows = some_rows(rng, n)
            assert c.chosen(c.combined([c.leaf_of(*r) for r in rows]))[:2] == everywhere(tuple(rows))


def plain(rows):
    """The contract of one table in plain Python: conv_id -> values."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        said = lambda v: " " if v is None else str(v)
        role, text = said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, leaves, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "fine": 0}
        for _, role, text in own:
            tail = re.sub("[\x20\x09-\x0d]+$", "", text)
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "fine" if tail[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            leaves.append((role[:1], fault))
        # one state per last initial of what is left, turn by turn
        best = {"": (0, "")}

        def put(new, k, v):
            new[k] = min(new.get(k, v), v)

        def inserted(b):
            for _ in range(2):
                new = dict(b)
                for k, (cost, audit) in b.items():
                    put(new, "a" if k == "u" else "u", (cost + 3, audit + "I"))
                b = new
            return b

        for initial, fault in leaves:
            new = {}
            for k, (cost, audit) in inserted(best).items():
                put(new, k, (cost + 4, audit + "D"))
                if fault in ("fine", "truncated"):
                    more = 3 if fault == "truncated" else 0
                    due = "a" if k == "u" else "u"
                    put(new, due, (cost + 3 + more, audit + "R"))
                    if initial == due or initial == "s" and k == "":
                        put(new, initial, (cost + more, audit + "K"))
            best = new
        best = inserted(best)
        cost, audit = min(best[k] for k in ("", "a") if k in best)
        left, at, due = [], 0, "s" if (len(audit) - audit.count("D")) % 2 else "u"
        for e in audit:
            role, text = ("", "") if e == "I" else own[at][1:]
            at += e != "I"
            if e != "D":
                left.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[due]}:{text}")
                due = "a" if due == "u" else "u"
        turns = [r[0] for r in own if r[0] is not None]
        initials = [i for i, _ in leaves]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(left).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def as_map(df):
    got = {r["conv_id"]: tuple(r[k] for k in COLUMNS) for r in df.collect()}
    return got


def test_query_against_plain_python(spark):
    rows = [tuple(r[k] for k in ("conv_id", "turn", "role", "text")) for r in table(spark, DATA, "conversations").collect()]
    got = op13_conversation_repair(spark, DATA)
    assert dict(got.dtypes) == {"conv_id": "bigint", **dict.fromkeys(COLUMNS, "bigint"), "audit": "string", "repaired_sha256": "string"}
    assert as_map(got) == plain(rows) and got.count() == len({r[0] for r in rows})


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_odd_rows_and_long_conversations(spark, monkeypatch, chunk):
    """Nulls everywhere, ties, repeats, unknown roles, very long texts, one conversation over many chunks and ranges."""
    monkeypatch.setattr(c, "CHUNK", chunk)
    monkeypatch.setattr(c, "RANGE", 40)
    rng = random.Random(chunk)
    rows = [(1, rng.choice([None, rng.randrange(60), k]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "so", "", None, "  \t", "Well, what? ", f"No {k}."])) for k in range(150)]
    rows += [(2, None, "user", "x.")] * 70 + [(3, 4, None, None)] * 5 + [(None, 1, "user", "a?"), (None, None, "assistant", "b!")] + [(4, t, "su"[t > 0] + "ser", "y" * 300_000 + str(t) + ".") for t in range(3)]
    rows += [(9, 0, "user", "gone")] if zlib.crc32(b"9:0") % 20 == 0 else [(k, 0, "user", "gone.") for k in range(100, 160)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS c1", "'x' AS part", "'y' AS cell")
    assert as_map(c.repair_digest(df)) == plain(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes.")]
    found, left = c.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    v = found.first()
    assert (v["cost"], v["audit"], v["duplicate"], v["illegal"], v["gaps"]) == (7, "KKIKKD", 1, 2, 0)
    kept = sorted(left.collect(), key=lambda r: (r["part"], r["no"], r["i"]))
    assert [(r["role"], r["text"], r["edit"]) for r in kept] == [("system", "Be kind.", "K"), ("user", "Hello?", "K"), ("assistant", "", "I"), ("user", "Are you there?", "K"), ("assistant", "Yes.", "K")]


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.repair_digest(none).count() == 0
    assert c.repair(none)[1].count() == 0
