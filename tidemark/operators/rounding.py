"""Rounding to integers that keeps running totals within one of the exact ones."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import fraction
from tidemark.plans.ordered import BLOCK, EXACT, fits_window, ordered_blocks, running_sums
from tidemark.session import stored

# fixed values: tolerance, units of a deviation and their weight
TOL = 1e-4
SCALE = 10_000
DEV_WEIGHT = 10
MAX_GROUP_ROWS = 200_000
BUCKET_ROWS = 50_000
NEVER = math.inf


# one column -----------------------------------------------------------------------------------

def _steps(frac: np.ndarray, cum: np.ndarray, tol: float):
    """Per row: lowest and highest running count, and the cost of a 1 (never where not allowed)."""
    low = np.floor(cum - tol).astype(int).tolist()
    high = np.ceil(cum + tol).astype(int).tolist()
    cost = [int(c) if f > tol else NEVER for c, f in zip(np.rint((1 - 2 * frac) * SCALE), frac)]
    return low, high, cost


def _best(low, high, cost, end: dict[int, float]) -> list[dict[int, float]]:
    """Smallest cost from each running count before row i to the end, for every i."""
    ahead = {s: v for s, v in end.items() if low[-1] <= s <= high[-1]}
    table = [ahead]
    for i in range(len(cost) - 1, -1, -1):
        before = {}
        for s, v in ahead.items():
            before[s] = min(before.get(s, NEVER), v)
            if cost[i] != NEVER:
                before[s - 1] = min(before.get(s - 1, NEVER), v + cost[i])
        # a count before row i must be allowed after row i - 1; the block's start is checked by its caller
        ahead = before if i == 0 else {s: v for s, v in before.items() if low[i - 1] <= s <= high[i - 1]}
        table.append(ahead)
    table.reverse()
    return table


def _walk(cost, table, at: int) -> tuple[list[int], int]:
    """The first of the cheapest choices in lexicographic order, and the count it ends at."""
    chosen = []
    for i in range(len(cost)):
        ahead = table[i + 1]
        stay = ahead.get(at, NEVER)
        rise = ahead.get(at + 1, NEVER) + cost[i] if cost[i] != NEVER else NEVER
        if stay <= rise:
            chosen.append(0)
        else:
            chosen.append(1)
            at += 1
    return chosen, at


def feasible_round_1col(
    df: DataFrame, keys: list[str], order: list[str], value: str, tol: float = TOL, max_group_rows: int | None = None
) -> DataFrame:
    """A rounding from running totals alone: meets the total and the bands, not the least cost.

    Adds frac, cum and x; x may be 1 on a row whose fraction is below ``tol``.
    """
    base = df.withColumn("frac", fraction(F.col(value)))
    windowed = fits_window(df, keys, max_group_rows)
    summed = running_sums(base, keys, order, {"cum": F.col("frac")}, windowed).drop(BLOCK)
    reach, before = F.ceil(F.col("cum") - tol), F.ceil(F.col("cum") - F.col("frac") - tol)
    return summed.withColumn("x", (reach - F.greatest(before, F.lit(0))).cast("int"))


def controlled_round_1col(
    df: DataFrame, keys: list[str], order: list[str], value: str, tol: float = TOL,
    max_group_rows: int | None = None, partitions: int | None = None,
) -> DataFrame:
    """Add x in {0, 1} and rounded = floor(value) + x per group in the given order.

    The x add up to ceil(sum of fractions - tol), each running sum of x stays between the floor and
    the ceiling of the running sum of fractions, x is 0 where the fraction is at most ``tol``, and
    the sum of x * (1 - 2 * fraction) is the least possible; of equal ones the lexicographically
    smallest. A group without a solution fails the job.

    A running sum has at most three values per row, so the least cost is a shortest path through
    three states. Only the groups above ``max_group_rows`` are cut into blocks, which are solved for
    every entry state at once; the entry states are then fixed along each group's blocks.
    """
    limit = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
    base = df.withColumn("_f", fraction(F.col(value)))
    shape = T.StructType([*df.schema.fields, T.StructField("x", T.IntegerType())])
    small, large, small_rows, large_rows = _by_size(base, keys, limit)
    solved = []
    if small is not None:
        summed = running_sums(small, keys, order, {"_cum": F.col("_f")}, True)
        solved.append(_solve_whole(_bucketed(summed, keys, small_rows), keys, order, tol, shape))
    if large is not None:
        blocks = partitions or (-(-large_rows // limit) if limit else None)
        parts = ordered_blocks(large, keys, order, blocks)
        summed = running_sums(parts, keys, order, {"_cum": F.col("_f")}, False)
        solved.append(_solve_blocks(summed, keys, order, tol, shape))
    both = solved[0] if len(solved) == 1 else solved[0].unionByName(solved[1])
    return both.withColumn("rounded", (F.floor(F.col(value)) + F.col("x")).cast("bigint"))


def _by_size(df: DataFrame, keys: list[str], limit: int):
    """Rows of groups up to ``limit`` rows, rows of larger groups (either None), and their counts."""
    sizes = df.groupBy(*[F.col(k).alias(f"_h_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    is_large = F.col("_n") > limit
    rows, of_large = sizes.agg(F.sum("_n"), F.sum(F.when(is_large, F.col("_n")))).first()
    if not of_large:
        return df, None, rows or 0, 0
    if of_large == rows:
        return None, df, 0, rows
    hot = stored(sizes.filter(is_large))
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    return df.join(hot, match, "left_anti"), df.join(hot, match, "left_semi"), rows - of_large, of_large


def _bucketed(df: DataFrame, keys: list[str], rows: int):
    """Whole groups hashed together, so that one Python call serves many small ones."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"))


def _group_rows(pdf: pd.DataFrame, keys: list[str]):
    """Row positions of each group, in the order of ``pdf``."""
    codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    by_group = np.argsort(codes, kind="stable")
    return np.split(by_group, np.flatnonzero(np.diff(codes[by_group])) + 1) if len(pdf) else []


def _solve_whole(grouped, keys: list[str], order: list[str], tol: float, shape: T.StructType) -> DataFrame:
    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        fracs, cums = pdf["_f"].to_numpy(), pdf["_cum"].to_numpy()
        x = np.zeros(len(pdf), dtype=np.int32)
        for at in _group_rows(pdf, keys):
            low, high, cost = _steps(fracs[at], cums[at], tol)
            table = _best(low, high, cost, {math.ceil(cums[at[-1]] - tol): 0})
            if table[0].get(0, NEVER) == NEVER:
                raise ValueError("no rounding meets the running totals")
            x[at] = _walk(cost, table, 0)[0]
        return pdf.assign(x=x)[shape.names]

    return grouped.applyInPandas(whole, shape)


def _solve_blocks(summed: DataFrame, keys: list[str], order: list[str], tol: float, shape: T.StructType) -> DataFrame:
    by_block = [*keys, BLOCK]
    key_fields = [summed.schema[c] for c in by_block]
    whole_number = lambda n: T.StructField(n, T.LongType())
    real = lambda n: T.StructField(n, T.DoubleType())

    def named(args, pdf: pd.DataFrame) -> pd.DataFrame:
        for at, name in enumerate(by_block):
            pdf.insert(at, name, args[at])
        return pdf

    def key_of(pdf: pd.DataFrame) -> list:
        return [pdf[c].iloc[0] for c in by_block]

    # 1. the cost of every way through a block: counts before and after it
    paths_shape = T.StructType([*key_fields, whole_number("s_in"), whole_number("s_out"), real("cost"), real("cum")])

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        cum = pdf["_cum"].to_numpy()
        low, high, cost = _steps(pdf["_f"].to_numpy(), cum, tol)
        lines = [
            (s_in, s_out, float(v), float(cum[-1]))
            for s_out in range(low[-1], high[-1] + 1)
            for s_in, v in _best(low, high, cost, {s_out: 0})[0].items()
        ]
        return named(key_of(pdf), pd.DataFrame(lines, columns=["s_in", "s_out", "cost", "cum"]))

    ways = summed.groupBy(*by_block).applyInPandas(paths, paths_shape)

    # 2. from the last block back: the cost from each count after a block to the end of the group;
    # at most three lines per block, stored as two later steps read them
    ends_shape = T.StructType([*key_fields, whole_number("s_out"), real("ahead")])

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = sorted(pdf[BLOCK].unique(), reverse=True)
        total = pdf.loc[pdf[BLOCK] == blocks[0], "cum"].iloc[0]
        ahead, lines = {math.ceil(total - tol): 0.0}, []
        for block in blocks:
            lines += [(block, s, v) for s, v in ahead.items()]
            before: dict[int, float] = {}
            for way in pdf[pdf[BLOCK] == block].itertuples():
                if way.s_out in ahead:
                    before[way.s_in] = min(before.get(way.s_in, NEVER), way.cost + ahead[way.s_out])
            ahead = before
        if 0 not in ahead:
            raise ValueError("no rounding meets the running totals")
        out = pd.DataFrame(lines, columns=[BLOCK, "s_out", "ahead"])
        for at, name in enumerate(keys):
            out.insert(at, name, pdf[name].iloc[0])
        return out

    goals = stored(ways.groupBy(*keys).applyInPandas(ends, ends_shape))

    # 3. where each count before a block leads when the choices in it are the first cheapest ones
    leads_shape = T.StructType([*key_fields, whole_number("s_in"), whole_number("s_out")])

    def table_of(pdf: pd.DataFrame, goal: pd.DataFrame):
        low, high, cost = _steps(pdf["_f"].to_numpy(), pdf["_cum"].to_numpy(), tol)
        end = dict(zip(goal["s_out"].tolist(), (int(v) for v in goal["ahead"])))
        return cost, _best(low, high, cost, end)

    def leads(pdf: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        cost, table = table_of(pdf, goal)
        lines = [(s, _walk(cost, table, s)[1]) for s in table[0]]
        return named(key_of(pdf), pd.DataFrame(lines, columns=["s_in", "s_out"]))

    grouped = lambda frame: frame.groupBy(*by_block)
    turns = grouped(summed).cogroup(grouped(goals)).applyInPandas(leads, leads_shape)

    # 4. along the blocks of a group: the count each of them starts from
    start_shape = T.StructType([*key_fields, whole_number("start")])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        lines, at = [], 0
        for block, part in pdf.groupby(BLOCK, sort=True):
            lines.append((block, at))
            at = dict(zip(part["s_in"].tolist(), part["s_out"].tolist()))[at]
        out = pd.DataFrame(lines, columns=[BLOCK, "start"])
        for i, name in enumerate(keys):
            out.insert(i, name, pdf[name].iloc[0])
        return out

    entries = turns.groupBy(*keys).applyInPandas(starts, start_shape)

    # 5. the choices
    both = goals.withColumn("start", F.lit(None).cast("bigint")).unionByName(
        entries.select(*by_block, F.lit(None).cast("bigint").alias("s_out"), F.lit(None).cast("double").alias("ahead"),
                       "start"))

    def choose(pdf: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        cost, table = table_of(pdf, goal[goal["s_out"].notna()].astype({"s_out": int}))
        start = int(goal["start"].dropna().iloc[0])
        return pdf.assign(x=_walk(cost, table, start)[0])[shape.names]

    return grouped(summed).cogroup(grouped(both)).applyInPandas(choose, shape)


# rows and columns -----------------------------------------------------------------------------

#: Fractions are added up in whole numbers of this many parts, as the audit adds decimals of 12 places.
PLACES = 10**12


def _exact(frac: np.ndarray) -> np.ndarray:
    return np.rint(frac * PLACES).astype(np.int64)


def _units(parts: np.ndarray) -> np.ndarray:
    """Sums of such parts in units of a deviation, halves to even."""
    return np.rint(np.asarray(parts) / PLACES * SCALE).astype(np.int64)


def _changes(frac: np.ndarray, tol: float, col_w: float, row_w: float, elem_w: float, elem_penalty: bool):
    """The matrix as a net whose flow is the number of ones, and the cost of the next one on every arc.

    Ones run from the start along the rows' chain (what is left after a row), through a row to a cell and on down the column's
    chain (its sum so far). Each cost is convex in the flow on its arc, so the cheapest changes lead to the optimum. Costs are
    whole numbers; the last bits of a cell's cost make the lexicographically smallest of equal choices the cheapest.
    """
    n, m = frac.shape
    weights = [Fraction(w) for w in (col_w, row_w, elem_w)]
    unit = math.lcm(*(w.denominator for w in weights))
    col_w, row_w, elem_w = (int(w * unit) << (n * m) for w in weights)
    exact = _exact(frac)
    whole = lambda a: [int(x) for x in _units(a)]
    row_goal, col_goal, col_run = whole(exact.sum(axis=1)), whole(exact.sum(axis=0)), [whole(r) for r in np.cumsum(exact, axis=0)]
    need = -(-int(exact.sum()) // PLACES)
    reach = np.cumsum(exact.sum(axis=1)) / PLACES
    low, high = np.floor(reach - tol).astype(int), np.ceil(reach + tol).astype(int)
    gain = [whole(PLACES - 2 * r) for r in exact]
    never = (1 << (n * m + 8)) * unit * (int(sum(weights)) + 1) * SCALE * (n * m + 2) ** 2  # outweighs all other costs

    def step(weight: int, goal: int):
        return lambda k: weight * (abs((k + 1) * SCALE - goal) - abs(k * SCALE - goal))

    def bounded(least: int, most: int):
        return lambda k: never if k >= most else -never if k < least else 0

    arcs = []  # (from, to, most, cost of the next one)
    row, cell, end = (lambda i: 2 * i + 1), (lambda i, j: 2 * n + i * m + j), 2 * n + n * m
    for i in range(n):
        # what goes on to later rows is what the rows so far have not taken
        if i + 1 < n:
            arcs.append((2 * i, 2 * i + 2, need, bounded(need - high[i], need - low[i])))
        arcs.append((2 * i, row(i), m, step(row_w, row_goal[i])))
        for j in range(m):
            if frac[i, j] > tol:
                tie = 1 << (n * m - 1 - i * m - j)
                cost = tie + elem_w * gain[i][j] if elem_penalty else tie
                arcs.append((row(i), cell(i, j), 1, lambda k, cost=cost: cost))
            last = i + 1 == n
            down = step(0 if elem_penalty else elem_w, col_run[i][j])
            final = step(col_w, col_goal[j])
            arcs.append((cell(i, j), end if last else cell(i + 1, j), n, (lambda k, a=down, b=final: a(k) + b(k)) if last else down))
    return arcs, end, need


def _cheapest(arcs: list, end: int, need: int) -> list[int]:
    """Flow on every arc after ``need`` cheapest changes from node 0 to ``end``, found with reduced costs."""
    flow = [0] * len(arcs)
    out: list[list[tuple[int, int]]] = [[] for _ in range(end + 1)]
    for number, (a, b, _, _) in enumerate(arcs):
        out[a].append((number, 1))
        out[b].append((number, -1))

    def price(number: int, sign: int) -> int | None:
        _, _, most, cost = arcs[number]
        if sign > 0:
            return cost(flow[number]) if flow[number] < most else None
        return -cost(flow[number] - 1) if flow[number] > 0 else None

    potential: list = [None] * (end + 1)
    potential[0] = 0
    for _ in range(end + 1):  # the empty net has no circle, so this settles
        changed = False
        for number, (a, b, most, cost) in enumerate(arcs):
            if potential[a] is not None and (potential[b] is None or potential[a] + cost(0) < potential[b]):
                potential[b], changed = potential[a] + cost(0), True
        if not changed:
            break
    for _ in range(need):
        best: list = [None] * (end + 1)
        via: list = [None] * (end + 1)
        best[0], heap, done = 0, [(0, 0)], set()
        while heap:
            spent, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            for number, sign in out[node]:
                other = arcs[number][1] if sign > 0 else arcs[number][0]
                value = price(number, sign)
                if value is None or other in done or potential[other] is None:
                    continue
                total = spent + value + potential[node] - potential[other]
                if best[other] is None or total < best[other]:
                    best[other], via[other] = total, (number, sign)
                    heapq.heappush(heap, (total, other))
        if best[end] is None:
            raise ValueError("no rounding meets the running totals")
        most = max(b for b in best if b is not None)
        potential = [p if p is None else p + (most if b is None else b) for p, b in zip(potential, best)]
        node = end
        while node != 0:
            number, sign = via[node]
            flow[number] += sign
            node = arcs[number][0] if sign > 0 else arcs[number][1]
    return flow


def _objective(x: np.ndarray, frac: np.ndarray, tol: float, col_w: float, row_w: float, elem_w: float,
               col_step_penalty: bool, elem_penalty: bool) -> int | None:
    """Cost of a 0/1 matrix; null if it misses the total or a band."""
    exact, whole = _exact(frac), _units
    reach, taken = np.cumsum(exact.sum(axis=1)) / PLACES, np.cumsum(x.sum(axis=1))
    if x.sum() != -(-int(exact.sum()) // PLACES) or (taken < np.floor(reach - tol)).any() or (taken > np.ceil(reach + tol)).any() or (x[frac <= tol] != 0).any():
        return None
    off = np.abs(x.sum(axis=0) * SCALE - whole(exact.sum(axis=0)))
    cost = col_w * float(off[off >= SCALE].sum() if col_step_penalty else off.sum())
    cost += row_w * float(np.abs(x.sum(axis=1) * SCALE - whole(exact.sum(axis=1))).sum())
    last = (whole(PLACES - 2 * exact) * x).sum() if elem_penalty else np.abs(np.cumsum(x, axis=0) * SCALE - whole(np.cumsum(exact, axis=0))).sum()
    return int(round(cost + elem_w * float(last)))


def _solve_steps(frac: np.ndarray, tol: float, col_w: float, row_w: float, elem_w: float, elem_penalty: bool) -> np.ndarray:
    """Least-cost matrix where a column's cost jumps at one: cell by cell over the states (column sums, ones of the row)."""
    n, m = frac.shape
    exact = _exact(frac)
    whole = lambda a: _units(a).tolist()
    row_goal, col_goal, col_run = whole(exact.sum(axis=1)), whole(exact.sum(axis=0)), whole(np.cumsum(exact, axis=0))
    gain, need = whole(PLACES - 2 * exact), -(-int(exact.sum()) // PLACES)
    reach = np.cumsum(exact.sum(axis=1)) / PLACES
    low, high = np.floor(reach - tol).astype(int), np.ceil(reach + tol).astype(int)
    states: dict[tuple, tuple] = {((0,) * m, 0): (0.0, 0)}
    for i in range(n):
        for j in range(m):
            reached: dict[tuple, tuple] = {}
            for (sums, ones), (spent, path) in states.items():
                for bit in (0, 1) if frac[i, j] > tol else (0,):
                    after = sums if not bit else (*sums[:j], sums[j] + 1, *sums[j + 1:])
                    if sum(after) > high[i]:
                        continue
                    cost = spent + elem_w * (gain[i][j] * bit if elem_penalty else abs(after[j] * SCALE - col_run[i][j]))
                    key, entry = (after, ones + bit), (cost, path << 1 | bit)
                    if key not in reached or entry < reached[key]:
                        reached[key] = entry
            states = reached
        ended: dict[tuple, tuple] = {}
        for (sums, ones), (spent, path) in states.items():
            if sum(sums) >= low[i]:
                entry = (spent + row_w * abs(ones * SCALE - row_goal[i]), path)
                if (sums, 0) not in ended or entry < ended[sums, 0]:
                    ended[sums, 0] = entry
        states = ended
    final = []
    for (sums, _), (spent, path) in states.items():
        if sum(sums) == need:
            off = [abs(s * SCALE - g) for s, g in zip(sums, col_goal)]
            final.append((spent + col_w * sum(o for o in off if o >= SCALE), path))
    if not final:
        raise ValueError("no rounding meets the running totals")
    path = min(final)[1]
    return np.array([path >> k & 1 for k in range(n * m - 1, -1, -1)]).reshape(n, m)


def _solve_matrix(values: np.ndarray, tol: float, col_w: float, row_w: float, elem_w: float,
                  col_step_penalty: bool, elem_penalty: bool) -> tuple[np.ndarray, int]:
    """Least-cost 0/1 matrix and its cost."""
    frac = values - np.floor(values)
    if col_step_penalty:
        x = _solve_steps(frac, tol, col_w, row_w, elem_w, elem_penalty)
    else:
        arcs, end, need = _changes(frac, tol, col_w, row_w, elem_w, elem_penalty)
        x = np.zeros(frac.shape, dtype=int)
        n, m = frac.shape
        for (start, to, _, _), ones in zip(arcs, _cheapest(arcs, end, need)):
            if ones and start < 2 * n and start % 2 and to >= 2 * n:
                x[divmod(to - 2 * n, m)] = 1
    cost = _objective(x, frac, tol, col_w, row_w, elem_w, col_step_penalty, elem_penalty)
    if cost is None:
        raise ValueError("no rounding meets the running totals")
    return x, cost


def controlled_round(
    df: DataFrame, keys: list[str], row: str, col: str, value: str, tol: float = TOL,
    col_w: float = 1e4, row_w: float = 1e3, elem_w: float = 10,
    col_step_penalty: bool = False, elem_penalty: bool = False,
) -> DataFrame:
    """Add x, rounded and the objective to every cell of each group's (row, col) matrix.

    The x add up to ceil(sum of fractions); running row totals stay within the floor and ceiling of
    the exact ones; deviations of column and row totals are penalised, plus those of the cells
    (``elem_penalty``) or of the running column totals. ``col_step_penalty`` ignores a column that
    is off by less than one. Cells that are absent count as 0.

    The answer is exact: the cheapest changes, one per 1 of the result, in time about (cells x ones). Only ``col_step_penalty`` has no
    such order; it is solved over the states of the column sums, whose number grows with the power of the number of columns.
    Of equal choices the lexicographically smallest one, row by row, is taken. A matrix is solved in one task; two rows for one cell
    are an error.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shape = T.StructType([*df.schema.fields, T.StructField("x", T.IntegerType()),
                          T.StructField("objective", T.LongType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, values = pdf[row].to_numpy(), pdf[col].to_numpy(), pdf[value].to_numpy(float)
        x, objective = np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf), dtype=np.int64)
        for at in _group_rows(pdf, keys):
            at_row = np.unique(rows[at], return_inverse=True)[1]
            at_col = np.unique(cols[at], return_inverse=True)[1]
            grid = np.zeros((at_row.max() + 1, at_col.max() + 1))
            if len(np.unique(at_row * (at_col.max() + 1) + at_col)) < len(at_row):
                raise ValueError("two rows for one cell of a matrix")
            grid[at_row, at_col] = values[at]
            chosen, cost = _solve_matrix(grid, tol, col_w, row_w, elem_w, col_step_penalty, elem_penalty)
            x[at], objective[at] = chosen[at_row, at_col], cost
        return pdf.assign(x=x, objective=objective)[shape.names]

    solved = _bucketed(df, keys, total).applyInPandas(solve, shape)
    return solved.withColumn("rounded", (F.floor(F.col(value)) + F.col("x")).cast("bigint"))


def rounding_audit(
    df: DataFrame, keys: list[str], row: str, col: str, value: str, x: str, tol: float = TOL,
    col_w: float = 1e4, row_w: float = 1e3, elem_w: float = 10,
    col_step_penalty: bool = False, elem_penalty: bool = False, max_group_rows: int | None = None,
) -> DataFrame:
    """Whether a rounding meets its total and bands, its deviations and objective, per group.

    Deviations are in units of 1/10,000. Any group size: cells are added up per row and per column
    first, and running totals are taken with ``running_sums``.
    """
    def off(total: str, exact: str):
        return F.abs(F.col(total) * SCALE - F.rint(F.col(exact).cast("double") * SCALE))

    cells = df.select(*keys, F.col(row).alias("_r"), F.col(col).alias("_c"),
                      fraction(F.col(value)).cast(EXACT).alias("_f"), F.col(x).cast("bigint").alias("_x"))
    sums = [F.sum("_f").alias("_f"), F.sum("_x").alias("_x")]
    by_row = cells.groupBy(*keys, "_r").agg(*sums)
    windowed = fits_window(by_row, keys, max_group_rows)
    run = running_sums(by_row, keys, ["_r"], {"_cf": F.col("_f"), "_cx": F.col("_x")}, windowed)
    bands = F.col("_cx").between(F.floor(F.col("_cf").cast("double") - tol), F.ceil(F.col("_cf").cast("double") + tol))
    rows = run.groupBy(*keys).agg(
        (F.sum("_x") == F.ceil(F.sum("_f"))).alias("total_met"), F.min(bands).alias("bands_met"),
        F.sum(off("_x", "_f")).alias("row_dev"),
    )
    step = off("_x", "_f")
    step = F.when(step < SCALE, 0.0).otherwise(step) if col_step_penalty else step
    cols = cells.groupBy(*keys, "_c").agg(*sums).groupBy(*keys).agg(F.sum(step).alias("col_dev"))
    if elem_penalty:
        gain = F.when((F.col("_x") == 1) & (F.col("_f") > tol), F.rint((1 - 2 * F.col("_f")).cast("double") * SCALE)).otherwise(0.0)
        last = cells.groupBy(*keys).agg(F.sum(gain).alias("elem_dev"))
    else:
        by_cell = cells.groupBy(*keys, "_c", "_r").agg(*sums)
        small = fits_window(by_cell, [*keys, "_c"], max_group_rows)
        along = running_sums(by_cell, [*keys, "_c"], ["_r"], {"_cf": F.col("_f"), "_cx": F.col("_x")}, small)
        last = along.groupBy(*keys).agg(F.sum(off("_cx", "_cf")).alias("elem_dev"))
    # each part has one line per group, so lining them up is one more small aggregate
    parts = rows.unionByName(cols, allowMissingColumns=True).unionByName(last, allowMissingColumns=True)
    names = ["total_met", "bands_met", "row_dev", "col_dev", "elem_dev"]
    return parts.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names]).withColumn(
        "objective", F.col("col_dev") * col_w + F.col("row_dev") * row_w + F.col("elem_dev") * elem_w)
