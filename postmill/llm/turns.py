"""Conversation structure repair: the cheapest edits that give every conversation its alternating turns.

A conversation's roles must read (s?(ua)+)?. Four states say what may come next: nothing was given out yet, a
system turn, a user's, an assistant's. Each turn is a 4 x 4 matrix of elements (cost, audit): what the cheapest
edits of that turn cost between two states, any inserts before it included (the closure of the insert matrix),
and the edits' initials. Products take the smaller cost, ties the smaller audit, and chain audits. Audits of
equal cost over the same turns are never one the beginning of the other, so the product is associative and any
tree of products gives the same.

Turns are sorted over the whole table by ranges, and runs of them become blocks. A conversation within a block is
finished there. One that is cut by a block's end, however long, is a row of block matrices, which a tree
multiplies group by group; the states at the blocks' borders then give each block its own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

SPACE = " \t\n\x0b\f\r"
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns of a block at most, bytes of text from which another begins, and matrices that a task multiplies.
TURNS, BYTES, FAN = 1 << 14, 4 << 20, 16

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]
#: Inserts between two states, as few as there can be.
_INSERTS = {START: {START: 0, USER: 1, ASSISTANT: 2}, SYSTEM: {SYSTEM: 0, USER: 1, ASSISTANT: 2}, USER: {USER: 0, ASSISTANT: 1}, ASSISTANT: {ASSISTANT: 0, USER: 1}}
CLOSURE: Matrix = tuple(tuple((INSERT * n, "I" * n) if (n := _INSERTS[i].get(k)) is not None else None for k in range(4)) for i in range(4))
IDENTITY: Matrix = tuple(tuple((0, "") if i == k else None for k in range(4)) for i in range(4))


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: of all states between, the cheapest way, ties to the smaller audit."""
    out = []
    for row in a:
        cells = []
        for k in range(4):
            ways = [(x[0] + y[0], x[1], y[1]) for x, y in zip(row, (r[k] for r in b)) if x is not None and y is not None]
            least = min((w[0] for w in ways), default=None)
            cells.append(None if least is None else (least, min(x + y for c, x, y in ways if c == least)))
        out.append(tuple(cells))
    return tuple(out)


def turn_matrix(code: str) -> Matrix:
    """The matrix of a turn: ``D`` must go; else its role's initial (s, u, a, or o for others), upper-case if it is
    truncated."""
    own = [[None] * 4 for _ in range(4)]
    for i in range(4):
        own[i][i] = (DELETE, "D")
    if code != "D":
        more, user_from = TRUNCATED * code.isupper(), (START, SYSTEM, ASSISTANT)
        kept = {"s": [(START, SYSTEM)], "u": [(i, USER) for i in user_from], "a": [(USER, ASSISTANT)], "o": []}[code.lower()]
        for i, k in [*[(i, USER) for i in user_from], (USER, ASSISTANT)]:
            own[i][k] = (REROLE + more, "R")
        for i, k in kept:
            own[i][k] = (more, "K")
    return times(CLOSURE, tuple(map(tuple, own)))


#: Products of short runs, as a task meets them again and again.
_KNOWN: dict[str, Matrix] = {}


def _short(codes: str) -> Matrix:
    known = _KNOWN.get(codes)
    if known is None:
        half = len(codes) // 2
        known = times(_short(codes[:half]), _short(codes[half:])) if half else turn_matrix(codes) if codes else IDENTITY
        if len(_KNOWN) < 4096:
            _KNOWN[codes] = known
    return known


def product(codes: str) -> Matrix:
    """The product of the turns' matrices, as a balanced tree; short runs are known from before."""
    if len(codes) <= 16:
        return _short(codes)
    half = (len(codes) // 2 + 15) // 16 * 16
    half = half if half < len(codes) else len(codes) // 2
    return times(product(codes[:half]), product(codes[half:]))


def best_end(matrix: Matrix) -> tuple[int, str, int, int]:
    """Cost, audit, last state and inserts behind the last turn of the cheapest way to a valid end."""
    ways = []
    for k in range(4):
        for end in (START, ASSISTANT):
            n = _INSERTS[k].get(end)
            if matrix[START][k] is not None and n is not None:
                cost, audit = matrix[START][k]
                ways.append((cost + INSERT * n, audit + "I" * n, k, n))
    return min(ways)


def edited(codes: str, audit: str, state: int, kept: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Turns (edit, role, text) that an audit leaves of a block's, from a state on; ``kept`` are (role, text) of
    the turns that need not go."""
    code, own, out = iter(codes), iter(kept), []
    for edit in audit:
        here = "" if edit == "I" else next(code)
        role, text = next(own) if here not in ("", "D") else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[here.lower()]
        else:
            role, text = ("assistant" if state == USER else "user"), text
            state = ASSISTANT if state == USER else USER
        out.append((edit, role, text))
    return out


# --- what is counted: of a block, and of blocks together ------------------------------------------

_STATS = "struct<low:long,high:long,turns:long,first:string,last:string,illegal:long,blank:long,duplicate:long,truncated:long>"
_NONE = {"low": None, "high": None, "turns": 0, "first": None, "last": None, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0}
_LEGAL = ("su", "ua", "au")


def together(a: dict, b: dict) -> dict:
    """Counts of a block and the one behind it. Turns rise, so one number is counted twice at most."""
    if a["first"] is None or b["first"] is None:
        return b if a["first"] is None else a
    out = {c: a[c] + b[c] for c in ("turns", "illegal", "blank", "duplicate", "truncated")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += a["last"] + b["first"] not in _LEGAL
    low = a["low"] if a["low"] is not None else b["low"]
    high = b["high"] if b["high"] is not None else a["high"]
    return out | {"low": low, "high": high, "first": a["first"], "last": b["last"]}


def _counted(turn, initial: str, fault: str, n: int) -> dict:
    """Counts of a row that stands ``n`` times; those behind the first are blank or duplicate too."""
    named = turn is not None
    again = n - 1 if fault != "blank" else 0
    return {"low": turn, "high": turn, "turns": int(named), "first": initial, "last": initial, "illegal": n - 1, "blank": n if fault == "blank" else 0, "duplicate": again + (fault == "duplicate"), "truncated": int(fault == "truncated")}


@dataclass
class Repaired:
    """``summary``: rows (conversation, gaps, blank, duplicate, truncated, illegal, cost, audit). ``blocks``: rows
    (conversation, part, no, turns array of (edit, role, text)), the repaired turns; a conversation's blocks follow
    each other by (part, no), and most have one. ``whole``: blocks that are a whole conversation."""

    summary: DataFrame
    whole: DataFrame
    cut: DataFrame
    conv: str

    @property
    def blocks(self) -> DataFrame:
        return self.whole.unionByName(self.cut)

    def turns(self) -> DataFrame:
        """Rows (conversation, part, no, place, edit, role, text): the repaired turns, in order by part, no, place."""
        return self.blocks.select(self.conv, "part", "no", F.posexplode("turns").alias("place", "t")).select(self.conv, "part", "no", "place", "t.*")

    def digests(self) -> DataFrame:
        """Rows (conversation, repaired_sha256) of the lines ``role:text`` joined by newlines. A whole block is
        hashed where it stands. SHA-256 has no parts that could be joined, so the blocks of a longer
        conversation, as ready bytes, pass one task one after the other, which holds a hash's state alone."""
        lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        done = self.whole.select(self.conv, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
        rows = self.cut.select(self.conv, "part", "no", F.size("turns").alias("n"), lines.cast("binary").alias("b"))
        kind = rows.schema[self.conv].dataType.simpleString()
        name = self.conv

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, state, began = None, None, False
            give = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]], kind_), pa.array([state.hexdigest()])], [name, "repaired_sha256"])
            kind_ = None
            for batch in batches:
                kind_ = batch.schema.field(0).type
                for i in range(len(batch)):
                    key = (batch.column(0)[i].as_py(),)
                    if key != own:
                        if own is not None:
                            yield give()
                        own, state, began = key, hashlib.sha256(), False
                    if batch.column(3)[i].as_py():
                        if began:
                            state.update(b"\n")
                        state.update(batch.column(4)[i].as_buffer())
                        began = True
            if own is not None:
                yield give()

        return done.union(rows.repartition(name).sortWithinPartitions(name, "part", "no").mapInArrow(hashed, f"`{name}` {kind}, repaired_sha256 string"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> Repaired:
    """Repairs all conversations of ``df``. Turns are taken by ``turn`` (null first), ties by role and text; null
    roles and texts count as one space, a null conversation is one of its own. A turn's first fault counts:
    blank, duplicate (role and text seen before in its conversation), truncated (its last character that is no
    white space is none of ``.!?``). Blank and duplicate turns are deleted; others are kept, given the role user or
    assistant, or deleted; empty turns are inserted. Rows for which ``present`` is not true only name their
    conversation, which without turns has zeros and an empty audit. Other columns are left out. An empty table gives
    empty results.

    Equal rows travel as one with their number, and a conversation's repeated texts meet by their hashes, so
    neither a hot conversation nor a hot turn gathers in one task."""
    space = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    own = lambda c: F.when(there, c)
    rows = df.select(F.col(f"`{conv}`").alias("conv"), own(F.col(f"`{turn}`").cast("long")).alias("turn"), own(space(role)).alias("role"), own(space(text)).alias("text"))
    order = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    said = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)
    solid = F.rtrim("text", F.lit(SPACE)) != ""
    repeated = rows.filter(solid).groupBy(F.col("conv").alias("c"), said.alias("s")).agg(F.min(order).alias("from"), F.max(order).alias("to")).filter(F.col("from") < F.col("to")).drop("to")
    # Written, so that its size is known: broadcast where it is small, else joined by conversation and hash.
    repeated = written(repeated, "turns-repeated")
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("role").alias("n"))
    rows = rows.join(repeated, F.col("conv").eqNullSafe(F.col("c")) & (said == F.col("s")), "left")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(~solid, "blank").when(F.coalesce(order > F.col("from"), F.lit(False)), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("conv", "turn", "role", "text", "n", fault.alias("fault"))
    rows = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    kept = F.when(~F.col("fault").isin("blank", "duplicate"), F.col("text"))
    blocks = written(_blocks(rows.select("conv", "turn", "role", kept.alias("text"), "n", "fault")), "turns-blocks")
    whole, cut = blocks.filter("not open"), blocks.filter("open")
    ends = _multiplied(cut.select("conv", "part", "no", "codes", "stats"))
    ends = written(ends, "turns-ends")
    gaps = F.coalesce(F.col("stats.high") - F.col("stats.low") + 1 - F.col("stats.turns"), F.lit(0)).cast("long")
    columns = [F.col("conv").alias(conv), gaps.alias("gaps"), *[F.col(f"stats.{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], "cost", "audit"]
    summary = whole.select(*columns).union(ends.select(*columns))
    at = ends.select(F.explode("leaves").alias("leaf")).select("leaf.*")
    named = [F.col("conv").alias(conv), "part", "no", "turns"]
    return Repaired(summary, whole.select(*named), _applied(cut.join(at, ["part", "no"])).select(*named), conv)


_TURNS = "array<struct<edit:string,role:string,text:string>>"
_TURN_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_STATS_TYPE = pa.struct([("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated")]])


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of sorted rows. The first and the last of a stretch of rows may go on beyond it: they are ``open`` and
    keep their codes and turns; others are whole conversations and are repaired at once."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for first, some in pieces(batch.column(at["text"]), BYTES):
                piece = batch.slice(first, len(some))
                made: list[dict] = []
                convs, turns, roles, counts, faults = (piece.column(at[c]).to_pylist() for c in ("conv", "turn", "role", "n", "fault"))
                texts = piece.column(at["text"]).to_pylist()
                i = 0
                while i < len(convs):
                    j = i + 1
                    while j < len(convs) and convs[j] == convs[i]:
                        j += 1
                    open_ = i == 0 or j == len(convs)
                    codes, kept, stats = [], [], _NONE
                    size = 0

                    def block(open_: bool) -> dict:
                        joined = "".join(codes)
                        row = {"conv": convs[i], "part": part, "no": no, "open": open_, "stats": stats, "codes": None, "cost": None, "audit": None}
                        if open_:
                            return row | {"codes": joined, "turns": [{"edit": None, "role": r, "text": t} for r, t in kept]}
                        cost, audit, _, _ = best_end(product(joined))
                        return row | {"cost": cost, "audit": audit, "turns": [{"edit": e, "role": r, "text": t} for e, r, t in edited(joined, audit, START, kept)]}

                    for k in range(i, j):
                        left = counts[k]
                        fault, initial = faults[k], (roles[k] or "")[:1]
                        while left:
                            if size >= TURNS:
                                open_ = True
                                made.append(block(True))
                                no, codes, kept, stats, size = no + 1, [], [], _NONE, 0
                            n = min(left, TURNS - size)
                            code = "D" if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
                            codes.append((code.upper() if fault == "truncated" else code) + "D" * (n - 1))
                            if code != "D":
                                kept.append((roles[k], texts[k]))
                            stats = together(stats, _counted(turns[k], initial, fault, n))
                            size, left = size + n, left - n
                            fault = fault if fault == "blank" else "duplicate"
                    made.append(block(open_))
                    no, i = no + 1, j
                names = ["conv", "part", "no", "open", "codes", "cost", "audit", "stats", "turns"]
                types = [batch.schema.field(at["conv"]).type, pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), _STATS_TYPE, _TURN_TYPE]
                yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], t) for c, t in zip(names, types)], names)

    return rows.mapInArrow(run, f"conv {kind}, part int, no long, open boolean, codes string, cost long, audit string, stats {_STATS}, turns {_TURNS}")


_CELLS = "array<struct<cost:long,audit:string,path:string>>"
_CELL_TYPE = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())]))
_LEAVES = "array<struct<part:int,no:long>>"
_LEAF_TYPE = pa.list_(pa.struct([("part", pa.int32()), ("no", pa.int64())]))


def _multiplied(leaves: DataFrame) -> DataFrame:
    """One row for each cut conversation: (conv, cost, audit, stats, leaves with the states at their borders).
    Matrices of at most ``FAN`` neighbours meet in a row, then those of their products, first of one part and
    then of all."""
    kind = leaves.schema["conv"].dataType.simpleString()
    most = leaves.agg(F.max("no").alias("no"), F.max("part").alias("part")).first()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                some = batch.slice(a, 64)
                part, no = some.column(1).to_pylist(), some.column(2).to_pylist()
                cells = [[{"cost": c[0], "audit": c[1], "path": str(k)} if c else None for row in product(codes) for k, c in enumerate(row)] for codes in some.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(cells, _CELL_TYPE), some.column(4), pa.array([[{"part": p, "no": n}] for p, n in zip(part, no)], _LEAF_TYPE)], ["conv", "hi", "i", "cells", "stats", "leaves"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch)):
                some = batch.slice(a, 1)
                rows = sorted(some.column(3)[0].as_py(), key=lambda r: r["i"])
                cells, stats = rows[0]["cells"], rows[0]["stats"]
                for r in rows[1:]:
                    cells, stats = _chained(cells, r["cells"]), together(stats, r["stats"])
                all_leaves = [leaf for r in rows for leaf in r["leaves"]]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array([cells], _CELL_TYPE), pa.array([stats], _STATS_TYPE), pa.array([all_leaves], _LEAF_TYPE)], ["conv", "hi", "i", "cells", "stats", "leaves"])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch)):
                some = batch.slice(a, 1)
                cells = some.column(3)[0].as_py()
                matrix = tuple(tuple((c["cost"], c["audit"]) if c else None for c in cells[4 * i : 4 * i + 4]) for i in range(4))
                cost, audit, last, tail = best_end(matrix)
                path = cells[last]["path"]
                states = [START, *map(int, path)]
                placed = [leaf | {"enter": states[n], "leave": states[n + 1], "tail": tail if n + 1 == len(path) else 0} for n, leaf in enumerate(some.column(5)[0].as_py())]
                kind_ = pa.list_(pa.struct([("part", pa.int32()), ("no", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("tail", pa.int32())]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([cost]), pa.array([audit]), some.column(4), pa.array([placed], kind_)], ["conv", "cost", "audit", "stats", "leaves"])

    schema = f"conv {kind}, hi int, i long, cells {_CELLS}, stats {_STATS}, leaves {_LEAVES}"
    out = leaves.mapInArrow(matrices, schema)
    for low, size in (("i", most["no"]), ("hi", most["part"])):
        if low == "hi":
            out = out.select("conv", F.lit(0).alias("hi"), F.col("hi").cast("long").alias("i"), "cells", "stats", "leaves")
        size = size or 0
        while True:
            met = F.collect_list(F.struct("i", "cells", "stats", "leaves")).alias("rows")
            out = out.groupBy("conv", "hi", F.floor(F.col("i") / FAN).cast("long").alias("j")).agg(met).mapInArrow(multiply, schema)
            size //= FAN
            if not size:
                break
    return out.mapInArrow(end, f"conv {kind}, cost long, audit string, stats {_STATS}, leaves array<struct<part:int,no:long,enter:int,leave:int,tail:int>>")


def _chained(a: list, b: list) -> list:
    """The product of two matrices whose elements keep the states at the ends of their blocks."""
    out = []
    for i in range(4):
        for k in range(4):
            ways = [(x["cost"] + y["cost"], x, y) for x, y in zip(a[4 * i : 4 * i + 4], b[k::4]) if x and y]
            least = min((w[0] for w in ways), default=None)
            best = [(x["audit"] + y["audit"], x["path"] + y["path"]) for c, x, y in ways if c == least]
            out.append({"cost": least, "audit": min(best)[0], "path": min(best)[1]} if best else None)
    return out


def _applied(blocks: DataFrame) -> DataFrame:
    """Open blocks (conv, part, no, codes, turns, enter, leave, tail) with their repaired turns."""
    kind = blocks.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(len(batch)):
                some = batch.slice(a, 1)
                row = {c: some.column(i)[0].as_py() for i, c in enumerate(batch.schema.names) if c != "conv"}
                audit = product(row["codes"])[row["enter"]][row["leave"]][1] + "I" * row["tail"]
                kept = [(t["role"], t["text"]) for t in row["turns"]]
                turns = [{"edit": e, "role": r, "text": t} for e, r, t in edited(row["codes"], audit, row["enter"], kept)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array([turns], _TURN_TYPE)], ["conv", "part", "no", "turns"])

    return blocks.select("conv", "part", "no", "codes", "turns", "enter", "leave", "tail").mapInArrow(run, f"conv {kind}, part int, no long, turns {_TURNS}")
