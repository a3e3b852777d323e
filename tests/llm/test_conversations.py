import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from markgrid.llm import conversations as cv

from ..conftest import rows_of

GOOD = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text): b, d, t or nothing."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACES)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """cost, audit and lines by trying every edit of every row with up to two insertions at each place."""
    kinds = faults(rows)
    best = None

    def tries(i, cost, audit, roles, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
        else:
            role, text = rows[i]
            options = [(2, "D", "", None)]
            if kinds[i] not in ("b", "d"):
                more = 5 if kinds[i] == "t" else 0
                options += [(more, "K", role[:1], f"{role}:{text}")] * bool(role) + [(1 + more, "R", r[0], f"{r}:{text}") for r in ("user", "assistant")]
            for c, x, r, line in options:
                step(i + 1, cost + c, audit + x, roles + r, lines if line is None else [*lines, line])

    def step(i, cost, audit, roles, lines):
        for n in range(3):
            for added in itertools.product(("user", "assistant"), repeat=n):
                tries(i, cost + 5 * n, audit + "I" * n, roles + "".join(r[0] for r in added), [*lines, *(f"{r}:" for r in added)])

    step(0, 0, "", "", [])
    return best


def report(conv_id, rows):
    """rows: (turn, role, text) in order."""
    turns = [t for t, *_ in rows if t is not None]
    kinds = faults([r[1:] for r in rows])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = cheapest([r[1:] for r in rows])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv_id, gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [(conv_id, row)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    hurt, out = damaged(rows), []
    low = lambda t: (t is not None, t or 0)
    for conv_id in {r[0] for r in rows}:
        own = sorted((r for c, r in hurt if c == conv_id), key=lambda r: (low(r[0]), r[1], r[2]))
        out.append(report(conv_id, own))
    return sorted(out, key=str)


def some(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(0, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.3 else ("user", "assistant")[t % 2]
            text = r.choice(["Yes.", "No", "yes.", " \t", None, "Why?\n", "Hm ", "ok!", f"number {r.randrange(50)}.", f"part {r.randrange(9)}"])
            rows.append((c, t + r.randint(0, 1), role, text))
    return rows


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cv.digests(cv.repaired(cv.in_order(cv.damaged(df)))).collect()), key=str)


def test_equals_brute_force(spark):
    rows = some(3, 250, 5)
    assert got(spark, rows) == brute(rows)


def test_odd_cases(spark):
    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None), (None, 1, "user", "A."), (None, 1, "user", "A."), (5, None, "user", "x."), (5, None, "assistant", "y."), (6, 10**12, "user", ""), (gone, 0, "user", "z.")]
    want = brute(rows)
    assert got(spark, rows) == want
    assert next(r for r in want if r[0] == gone) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, []) == []
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("kind", "copy", "gone", "h", "nth", "fault", "position", "edit", "cost")})
    assert sorted((tuple(r) for r in cv.digests(cv.repaired(cv.in_order(cv.damaged(wide)))).collect()), key=str) == want


def test_repaired_rows_follow_the_pattern(spark):
    rows = [r for r in some(9, 120, 12) if r[1] is not None]
    edits = cv.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in edits:
        by.setdefault(r.conv_id, []).append(r)
    assert set(by) == {r[0] for r in rows}
    for conv_id, own in by.items():
        assert [r.position for r in own] == list(range(len(own)))
        assert GOOD.fullmatch("".join(r.role[0] for r in own[1:] if r.edit != "D"))
        assert sum(r.edit != "I" for r in own[1:]) == sum(1 for r in rows if r[0] == conv_id)
        undone = sum(cv.COST[r.edit] + (5 if r.edit in "KR" and (r.text or " ").strip(SPACES)[-1:] not in (".", "!", "?") else 0) for r in own[1:])
        assert undone == own[0].cost


def test_giant_conversation_spills_and_gives_the_same(monkeypatch):
    rows = [(t, ("user", "assistant", "system", "user")[t % 4], f"turn {t % 70}" + "." * (t % 3)) for t in range(3000)]
    kind = {"": 0, "b": cv.BLANK, "d": cv.DUPLICATE, "t": cv.CUT}
    found = [kind[k] for k in faults([r[1:] for r in rows])]

    def edits():
        c = cv.Conversation(1)
        for (turn, role, text), fault in zip(reversed(rows), reversed(found)):
            c.add(turn, role, text, fault)
        return c.rows.blocks, list(c.edits())

    none, whole = edits()
    monkeypatch.setattr(cv, "SPILL_BYTES", 2000)
    blocks, spilled = edits()
    assert not none and len(blocks) > 100 and whole == spilled


def test_query_equals_its_sql(spark, duck, sf_dir):
    assert rows_of(cv.op11(spark, sf_dir)) == rows_of(duck.execute(cv.SQL).df())


def test_one_shuffle_and_no_second_one_for_the_digest(spark, sf_dir):
    plan = cv.op11(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1 and plan.count("Exchange") == 1
