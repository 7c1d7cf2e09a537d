import hashlib
import re
import zlib
from itertools import product

from hypothesis import given, settings, strategies as st

from tidemark.llm import conversation_repair as R

SF = "/root/testdata/sf0.01"
GOOD = re.compile("(s?(ua)+)?")


def plain_best(codes):
    """Least (cost, audit) by a walk over all rows and states, one row after the other."""
    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                better(table, 3 if state == 2 else 2, (cost + 3, audit + "I"))
        return table

    table = inserted({0: (0, "")})
    for code in codes:
        new = {}
        for state, (cost, audit) in table.items():
            better(new, state, (cost + 4, audit + "D"))
            if code != "d":
                cost += 3 if code.isupper() else 0
                turn = 3 if state == 2 else 2
                better(new, turn, (cost + 3, audit + "R"))
                if code.lower() == "ua"[turn - 2]:
                    better(new, turn, (cost, audit + "K"))
                if code.lower() == "s" and state == 0:
                    better(new, 1, (cost, audit + "K"))
        table = inserted(new)
    return min(table[s] for s in (0, 3) if s in table)


def every_audit(codes, most):
    """The least edits by trying all audits up to a length: roles written out and matched with the pattern."""
    best = None
    for length in range(most + 1):
        for audit in product("DIKR", repeat=length):
            if sum(x != "I" for x in audit) != len(codes):
                continue
            options, cost, at = [""], 0, 0
            for x in audit:
                code = codes[at] if x != "I" else ""
                if x == "D":
                    cost += 4
                elif code == "d":
                    options = []
                else:
                    options = [o + r for o in options for r in (code.lower() if x == "K" else "ua")]
                    cost += (0 if x == "K" else 3) + (3 if code.isupper() else 0)
                at += x != "I"
            if any(GOOD.fullmatch(o) for o in options):
                best = min(best, (cost, "".join(audit))) if best else (cost, "".join(audit))
    return best


@given(st.text("suaxSUAXd", max_size=40))
@settings(max_examples=300, deadline=None)
def test_heaps_that_meet_equal_a_walk(codes):
    assert R.cheapest(codes)[:2] == plain_best(codes)


def test_edits_equal_all_edits():
    for n in range(4):
        for codes in product("suaUd", repeat=n):
            assert R.cheapest("".join(codes))[:2] == every_audit("".join(codes), 2 * n)


def plain_repair(rows, original):
    out = {c: [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()] for c, *_ in original}
    chats = {}
    for c, turn, role, text in rows:
        chats.setdefault(c, []).append((turn is not None, turn or 0, role, text))
    for c, chat in chats.items():
        chat.sort()
        seen, codes, o = set(), "", out[c]
        for _, _, role, text in chat:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            letter = role[:1] if role[:1] in tuple("sua") else "x"
            if not end:
                o[1] += 1
                codes += "d"
            elif (role, text) in seen:
                o[2] += 1
                codes += "d"
            elif end[-1] not in ".!?":
                o[3] += 1
                codes += letter.upper()
            else:
                codes += letter
            seen.add((role, text))
        turns = [t for known, t, *_ in chat if known]
        o[0] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        o[4] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(chat, chat[1:]))
        o[5], o[6] = plain_best(codes)
        lines, at, last = [], 0, ""
        for x in o[6]:
            turn = "assistant" if last == "u" else "user"
            if x == "I":
                lines.append(f"{turn}:")
            elif x != "D":
                lines.append(f"{chat[at][2] if x == 'K' else turn}:{chat[at][3]}")
            at += x != "I"
            last = lines[-1][0] if lines else ""
        o[7] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return {c: tuple(o) for c, o in out.items()}


def plain_damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, pos string"
FIELDS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_whole_table_and_odd_rows_equal_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (-1, None, "user", "b?"), (-1, None, "assistant", "a!"), (-2, 5, "tool", "x."),
             (-2, 9, "", "y."), (-3, 1, "user", "same."), (-3, 1, "user", "same."), (-3, 1, "user", "Same."), (-4, 7, "system", "only."),
             (-5, 0, "user", "w " * 100_000), (-5, 1, "assistant", " \x0b\x0c")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = {r.conv_id: tuple(r[f] for f in FIELDS[1:]) for r in R.repair_all(frame, R.damaged(frame)).select(*FIELDS).collect()}
    assert got == plain_repair(plain_damage(rows), rows)
    assert R.repair_all(frame.limit(0), R.damaged(frame.limit(0))).collect() == []


def test_a_long_conversation_is_solved_in_blocks(spark):
    """One conversation of a third of all rows: blocks of five rows and no window over it give what one pass gives."""
    rows = []
    for i in range(3000):
        kind = (i * 7919) % 11
        rows.append((0 if i % 3 == 0 else i, i, "user" if kind < 5 else "assistant" if kind < 9 else "system" if kind == 9 else "tool",
                     "" if kind == 3 else f"text {i % 400}" + ("" if i % 13 == 0 else ".")))
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r[f] for f in FIELDS[1:]) for r in R.repair_all(frame, frame, block=5, max_rows=100).select(*FIELDS).collect()}
    assert got == plain_repair(rows, rows)
