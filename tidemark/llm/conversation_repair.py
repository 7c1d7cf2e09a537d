"""Conversation structure repair: the cheapest edits that make a conversation alternate, by bidirectional Dijkstra over the edit lattice.

The rows of a conversation are taken by turn (nulls first; ties by role, text). A row's first fault counts: blank (nothing but
ASCII blanks), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no blank is none
of ``.!?``). Edits: keep a row (0), give it the role user or assistant (3), delete it (4, a must for blank rows and duplicates), insert
an empty user or assistant row (3). A truncated row that is not deleted adds 3. The initials of the roles that are left must be nothing,
or user and assistant in turn after at most one system row in front. Of the cheapest edits those count whose initials (K, R, D, I)
come first in ASCII order.

Null roles, texts, ids and turns count as one blank in comparisons; a null turn stays null in the order and in the gaps. A role
whose initial is none of s, u, a, or that is empty, cannot be kept. Rows without a conversation id are one conversation.

A conversation of any length is cut into blocks of ``BLOCK`` rows. Blocks are solved apart; what passes between them is the
state at a cut (nothing yet, system, user, assistant) and the cost from there to the end, so no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.windows import numbered
from tidemark.session import stored

#: Rows of a conversation that are solved at once.
BLOCK = 256
#: Rows of a conversation that one window may order.
MAX_ROWS = 1_000_000
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INF = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost to the end once all rows are read.
ENDS = (0, INF, INF, 0)


def _next(state: int) -> int:
    """The state after the only role that may be written next by an insertion or a new role."""
    return ASSISTANT if state == USER else USER


def _edges(codes: str, i: int, state: int, last: bool) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, row, state) of every edit at a node of the lattice. Codes: d must go; s, u, a, x by initial, upper case if truncated."""
    if i < len(codes):
        code = codes[i]
        yield DELETE, "D", i + 1, state
        if code != "d":
            extra = TRUNCATED if code.isupper() else 0
            kept = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None,
                    "a": ASSISTANT if state == USER else None}.get(code.lower())
            if kept is not None:
                yield KEEP + extra, "K", i + 1, kept
            yield REROLE + extra, "R", i + 1, _next(state)
    if i < len(codes) or last:
        yield INSERT, "I", i, _next(state)


def _edges_into(codes: str, i: int, state: int, last: bool) -> Iterator[tuple[int, str, int, int]]:
    """The edges of ``_edges`` that end at (i, state), by where they begin."""
    for before in range(4):
        for row in (i - 1, i):
            if row >= 0:
                for cost, letter, at, to in _edges(codes, row, before, last):
                    if (at, to) == (i, state):
                        yield cost, letter, row, before


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str, entry: int = START, ends: tuple[int, ...] = ENDS, last: bool = True) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the best edits of a block that is entered in a state and goes on at the given costs.

    A forward and a reverse heap meet; both go on until no path of the least cost can cross elsewhere, then the least
    concatenation of a forward and a reverse audit is chosen. Only the last block may insert behind its rows.
    """
    n = len(codes)
    ahead: list = [(0, "", 0, entry)]
    back: list = [(cost, 0, "", n, state, state) for state, cost in enumerate(ends) if cost < INF]
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    left: dict[tuple[int, int], tuple[int, str, int]] = {}
    best = INF
    while ahead or back:
        near, far = ahead[0][0] if ahead else 0, back[0][0] if back else 0
        if near + far > best:
            break
        if ahead and (not back or near <= far):
            cost, audit, i, state = heappop(ahead)
            if (i, state) in seen:
                continue
            seen[i, state] = cost, audit
            best = min(best, cost + left.get((i, state), (INF,))[0])
            for step, letter, row, to in _edges(codes, i, state, last):
                best = min(best, cost + step + left.get((row, to), (INF,))[0])
                if (row, to) not in seen:
                    heappush(ahead, (cost + step, audit + letter, row, to))
        else:  # free edges lead to earlier rows, so later rows are settled first among equal costs
            cost, behind, audit, i, state, end = heappop(back)
            if (i, state) in left:
                continue
            left[i, state] = cost, audit, end
            best = min(best, cost + seen.get((i, state), (INF,))[0])
            for step, letter, row, before in _edges_into(codes, i, state, last):
                best = min(best, cost + step + seen.get((row, before), (INF,))[0])
                if (row, before) not in left:
                    heappush(back, (cost + step, n - row, letter + audit, row, before, end))
    if best >= INF:
        return INF, "", -1
    found = []
    for (i, state), (cost, audit) in seen.items():
        if (i, state) in left and cost + left[i, state][0] == best:
            found.append((audit + left[i, state][1], left[i, state][2]))
        for step, letter, row, to in _edges(codes, i, state, last):
            if (row, to) in left and cost + step + left[row, to][0] == best:
                found.append((audit + letter + left[row, to][1], left[row, to][2]))
    audit, end = min(found)
    return best, audit, end


def written(codes: str, entry: int, audit: str) -> list[dict[str, str]]:
    """A block's edits by row: the initials of a row's insertions and its own edit, and what they write: = the row, - nothing, u or a."""
    state, at, parts, letters, roles = entry, 0, [], "", ""
    for letter in audit:
        if letter == "D":
            role = "-"
        elif letter == "K":
            role, state = "=", {"s": SYSTEM, "u": USER, "a": ASSISTANT}[codes[at].lower()]
        else:
            state = _next(state)
            role = "u" if state == USER else "a"
        letters, roles = letters + letter, roles + role
        if letter != "I":
            parts.append({"edits": letters, "roles": roles})
            at, letters, roles = at + 1, "", ""
    return parts + ([{"edits": letters, "roles": roles}] if letters else [])


def damaged(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that their crc32 of ``conv_id:turn`` asks for; nulls count as one blank.

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _conversation(conv: str) -> Column:
    return F.coalesce(F.col(conv).cast("string"), F.lit(" "))


def judged(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           max_rows: int = MAX_ROWS) -> DataFrame:
    """(c, turn, role, text, pos, initial, fault) per row: its conversation as text, its place from 1 and its first fault."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = messages.select(_conversation(conv).alias("c"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    rows = numbered(rows, order=[F.col("turn").asc_nulls_first(), "role", "text"], keys=["c"], name="pos", max_group_rows=max_rows)
    rows = stored(rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}))
    same = ["c", "role", "h1", "h2"]
    first = rows.groupBy(*same).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(end == "", "blank").when(F.col("first") < F.col("pos"), "duplicate")
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated"))
    return rows.join(first, same, "left").select("c", "turn", "role", "text", "pos", F.substring("role", 1, 1).alias("initial"),
                                                 fault.alias("fault"))


def _each(step, names: list[str]):
    """A function for ``mapInArrow`` that turns rows, as dictionaries, into rows, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = step()
        for batch in batches:
            rows = [r for r in map(act, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMAS[tuple(names)])
    return run


_LONGS = pa.list_(pa.int64())
_SCHEMAS = {
    ("c", "block", "costs"): pa.schema([("c", pa.string()), ("block", pa.int64()), ("costs", _LONGS)]),
    ("c", "block", "ends"): pa.schema([("c", pa.string()), ("block", pa.int64()), ("ends", _LONGS)]),
    ("c", "block", "codes", "initials", "choices"): pa.schema([
        ("c", pa.string()), ("block", pa.int64()), ("codes", pa.string()), ("initials", pa.list_(pa.string())), ("choices", pa.list_(pa.struct(
            [("cost", pa.int64()), ("audit", pa.string()), ("end", pa.int64())])))]),
    ("c", "block", "audit", "parts", "cost", "illegal"): pa.schema([
        ("c", pa.string()), ("block", pa.int64()), ("audit", pa.string()), ("parts", pa.list_(pa.struct(
            [("edits", pa.string()), ("roles", pa.string())]))), ("cost", pa.int64()), ("illegal", pa.int64())]),
}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _block_costs():
    """Least costs of a block from each state to each state; of a last block, to the end."""
    def act(r: dict) -> dict:
        if r["last"]:
            costs = [cheapest(r["codes"], entry)[0] for entry in range(4)]
        else:
            costs = [cheapest(r["codes"], entry, tuple(0 if s == end else INF for s in range(4)), False)[0]
                     for entry in range(4) for end in range(4)]
        return {"c": r["c"], "block": r["block"], "costs": costs}
    return act


def _costs_to_end():
    """From the last block of a conversation to the first: the costs that its end states go on at. Rows come in that order."""
    at, ends = None, ENDS

    def act(r: dict) -> dict:
        nonlocal at, ends
        costs = r["costs"]
        if r["c"] != at:
            at, out, ends = r["c"], list(ENDS), tuple(costs)
        else:
            out = list(ends)
            ends = tuple(min(INF, *(costs[4 * e + s] + out[s] for s in range(4))) for e in range(4))
        return {"c": r["c"], "block": r["block"], "ends": out}
    return act


def _choices():
    """The best edits of a block for each state that it may be entered in; a first block has one."""
    def act(r: dict) -> dict:
        ends = tuple(r["ends"]) if r["ends"] else ENDS
        found = [cheapest(r["codes"], entry, ends, r["last"]) for entry in ((START,) if r["block"] == 0 else range(4))]
        return {"c": r["c"], "block": r["block"], "codes": r["codes"], "initials": r["initials"],
                "choices": [{"cost": c, "audit": a, "end": e} for c, a, e in found]}
    return act


def _walk():
    """From the first block of a conversation to the last: each block's edits, given where the one before ended. Rows come in that order."""
    at, state, before = None, START, None

    def act(r: dict) -> dict:
        nonlocal at, state, before
        if r["c"] != at:
            at, state, before = r["c"], START, None
        chosen = r["choices"][state]
        initials = ([before] if before is not None else []) + r["initials"]
        illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
        out = {"c": r["c"], "block": r["block"], "audit": chosen["audit"], "parts": written(r["codes"], state, chosen["audit"]),
               "cost": chosen["cost"], "illegal": illegal}
        state, before = chosen["end"], initials[-1]
        return out
    return act


def solved(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, block, audit, parts, cost, illegal) per block of judged rows; the cost is that from the block to the end."""
    dead = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(dead, "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    blocks = rows.groupBy("c", F.floor((F.col("pos") - 1) / block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", code.alias("code"), "initial"))).alias("r"))
    blocks = blocks.select("c", "block", F.array_join("r.code", "").alias("codes"), F.col("r.initial").alias("initials"))
    n = blocks.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    blocks = stored(blocks.join(n, "c").withColumn("last", F.col("block") == F.col("n") - 1))
    many = blocks.where("n > 1").select("c", "block", "codes", "last")
    costs = many.mapInArrow(_each(_block_costs, ["c", "block", "costs"]), "c string, block long, costs array<long>")
    ends = costs.repartition("c").sortWithinPartitions("c", F.desc("block")).mapInArrow(
        _each(_costs_to_end, ["c", "block", "ends"]), "c string, block long, ends array<long>")
    choices = blocks.join(ends, ["c", "block"], "left").select("c", "block", "codes", "initials", "ends", "last").mapInArrow(
        _each(_choices, ["c", "block", "codes", "initials", "choices"]),
        "c string, block long, codes string, initials array<string>, choices array<struct<cost:long,audit:string,end:long>>")
    return choices.repartition("c").sortWithinPartitions("c", "block").mapInArrow(
        _each(_walk, ["c", "block", "audit", "parts", "cost", "illegal"]),
        "c string, block long, audit string, parts array<struct<edits:string,roles:string>>, cost long, illegal long")


def repaired(rows: DataFrame, edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, pos, part, role, text): the rows of the repaired conversations, in the order of pos and part.

    Insertions stand in front of the row at their ``pos``; those at the end of a conversation have one more than its last row.
    """
    parts = edits.select("c", "block", F.posexplode("parts").alias("nth", "p")).select(
        "c", (F.col("block") * block + F.col("nth") + 1).alias("pos"), "p.edits", "p.roles")
    letters = F.transform(F.sequence(F.lit(1), F.length("roles")), lambda i: F.substr("roles", i, F.lit(1)))
    lines = parts.join(rows.select("c", "pos", "role", "text"), ["c", "pos"], "left").select(
        "c", "pos", "edits", "role", "text", F.posexplode(letters).alias("part", "letter")).where("letter != '-'")
    role = F.when(F.col("letter") == "=", F.col("role")).when(F.col("letter") == "u", "user").otherwise("assistant")
    is_row = (F.col("part") == F.length("edits") - 1) & ~F.col("edits").endswith("I")
    return lines.select("c", "pos", "part", role.alias("role"), F.when(is_row, F.col("text")).otherwise("").alias("text"))


def text_digests(lines: DataFrame) -> DataFrame:
    """(c, sha256) of each conversation's ``role:text`` lines; a conversation streams through its task, only the hash is kept."""
    schema = pa.schema([("c", pa.string()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist()):
                if c != at:
                    if at is not None:
                        done.append({"c": at, "sha256": state.hexdigest()})
                    at, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"c": at, "sha256": state.hexdigest()}], schema=schema)

    ordered = lines.select("c", "pos", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    return ordered.repartition("c").sortWithinPartitions("c", "pos", "part").select("c", "line").mapInArrow(run, "c string, sha256 string")


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = BLOCK, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per conversation that has rows: its faults, the cost and audit of its repair, and the digest of the repaired rows."""
    rows = stored(judged(messages, conv, turn, role, text, max_rows))
    edits = stored(solved(rows, block))
    of = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("c").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    faults = rows.groupBy("c").agg(of("blank"), of("duplicate"), of("truncated"))
    whole = edits.groupBy("c").agg(
        F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit"))
    digests = text_digests(repaired(rows, edits, block))
    nothing = F.sha2(F.lit(""), 256)
    return counts.join(faults, "c").join(whole, "c").join(digests, "c", "left").select(
        "c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", nothing).alias("repaired_sha256"))


def repair_all(original: DataFrame, messages: DataFrame, conv: str = "conv_id", **more) -> DataFrame:
    """``repair`` of ``messages``, with a row for every conversation of ``original``: one without messages has zeros."""
    found = repair(messages, conv, **more)
    every = original.select(F.col(conv), _conversation(conv).alias("c")).distinct()
    zero = {n: F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(found, "c", "left").select(
        conv, *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
