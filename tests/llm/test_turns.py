"""Conversation repair against a search over all edits, turn by turn."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postmill.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, gaps int"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    named = [r[1] for r in rows if r[1] is not None]
    gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(WHITE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = lambda state, initial: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for name in ("user", "assistant"):
                    to = after(state, name[0])
                    if to and (to not in ways or (cost + 3, audit + "I") < ways[to][:2]):
                        ways[to] = (cost + 3, audit + "I", [*lines, name + ":"])
        return ways

    ways = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, cost, audit, lines):
            if state is not None and (state not in new or (cost, audit) < new[state][:2]):
                new[state] = (cost, audit, lines)

        for state, (cost, audit, lines) in inserted(ways).items():
            offer(state, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                offer(after(state, role[:1]), cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    offer(after(state, name[0]), cost + more + 3, audit + "R", [*lines, f"{name}:{text}"])
        ways = new
    cost, audit, lines = min(w for s, w in inserted(ways).items() if s in ("", "a"))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines)


def check(spark, rows, df=None):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5) if df is None else df
    done = turns.repair(df)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    want = {c: brute(rs) for c, rs in want.items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in done.summary.collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    digests = done.digests().collect()
    assert len(digests) == len(want)
    assert {r["conv_id"]: r["repaired_sha256"] for r in digests} == {c: hashlib.sha256("\n".join(w[-1]).encode()).hexdigest() for c, w in want.items()}
    lines = {}
    for r in sorted(done.turns().collect(), key=lambda r: (r["part"], r["no"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}
    return done


def made(rng, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "ubuntu", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?  ", None, "é😀.", "x\u00a0"]
    return [(conv, rng.choice([i, i, i, i + 5, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"{i} {rng.choice('.!?,')}") for i in range(n)]


def test_products():
    """Any bracketing gives the same, and the product is the cheapest of all ways through all states."""
    rng = random.Random(1)
    for _ in range(60):
        codes = "".join(rng.choice("DsuaoSUAO") for _ in range(rng.randrange(1, 60)))
        line = turns.IDENTITY
        for c in codes:
            line = turns.times(line, turns.turn_matrix(c))
        assert turns.product(codes) == line
    a, b, c = (turns.turn_matrix(x) for x in "Dua")
    ways = []
    for i, j in itertools.product(range(4), range(4)):
        if a[0][i] and b[i][j] and c[j][3]:
            ways.append((a[0][i][0] + b[i][j][0] + c[j][3][0], a[0][i][1] + b[i][j][1] + c[j][3][1]))
    assert turns.product("Dua")[0][3] == min(ways) == (4, "DKK")


@pytest.mark.parametrize("most, size, fan", [(1 << 14, 4 << 20, 16), (5, 4 << 20, 2), (1 << 14, 40, 3)])
def test_repair_of_odd_rows(spark, monkeypatch, most, size, fan):
    """Nulls anywhere, ties, repeated rows, one conversation with a third of all rows; blocks cut by turns and by bytes."""
    monkeypatch.setattr(turns, "TURNS", most)
    monkeypatch.setattr(turns, "BYTES", size)
    monkeypatch.setattr(turns, "FAN", fan)
    rng = random.Random(most + size)
    rows = [r for c in range(60) for r in made(rng, c, rng.randrange(1, 12))] + made(rng, None, 9) + made(rng, 7, 150)
    rows += [rows[3]] * 40 + [(9, None, None, None)] * 3
    done = check(spark, rows)
    if most == 5:
        assert done.cut.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 20


def test_query_against_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: [] for c, *_ in rows}
    for r in damage(rows):
        want[r[0]].append(r)
    got = {r["conv_id"]: r for r in queries.op13_turns(spark, sf_dir).collect()}
    assert set(got) == set(want)
    for c, rs in want.items():
        *counts, lines = brute(rs)
        assert [got[c][x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")] == counts
        assert got[c]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_empty_and_dropped(spark):
    """An empty table, conversations without turns, a very long text, and texts as numbers of nothing."""
    empty = spark.createDataFrame([], SCHEMA)
    done = turns.repair(empty)
    assert done.summary.count() == 0 and done.digests().count() == 0
    rows = [(1, 0, "user", "Hi."), (2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y" * 3_000_000 + "."), (None, 5, "user", "?")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    done = turns.repair(df, present=F.col("conv_id") == 2)
    got = {r["conv_id"]: tuple(r)[1:] for r in done.summary.collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, ""), None: (0, 0, 0, 0, 0, 0, ""), 2: (0, 0, 0, 0, 0, 0, "KK")}
    digest = {r["conv_id"]: r["repaired_sha256"] for r in done.digests().collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert digest == {1: nothing, None: nothing, 2: hashlib.sha256(f"user:{rows[1][3]}\nassistant:{rows[2][3]}".encode()).hexdigest()}
