"""Sharding by balanced label propagation, with DataFrame functions only.

Linked rows (members of one group) should share a shard, and shards should hold equally many rows. Rows begin in the shard of a
hash of their id. In every round each group names the open shard that holds most of it, and members elsewhere move there as far
as quotas allow; those that no open shard attracts name the full one that holds most and move there in exchange for as many; unlinked rows fill the shards up at the end, as moving them cuts nothing. The unit that moves is an atom: the
rows of a group with one hash chunk, so a small group's rows move one by one, a group of a third of all rows in parts of a
shard's hundredth, and neither is ever gathered. The result follows from ids, groups and counts, not from partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import stored

#: Hash chunks of a group's rows; a multiple of no shard count is needed.
CHUNKS = 1024
ROUNDS = 10
#: Quotas fill a shard up to the first share of its capacity, as they are met on average only; beyond the second it takes swaps only.
FILL, OPEN = 0.98, 0.95
#: Rows of one window partition while rows are numbered, about.
RUN = 50_000


def _share(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def quotas(flow: dict[tuple[int, int], int], load: list[int], capacity: list[int], closed: frozenset[int] = frozenset()) -> dict[tuple[int, int], float]:
    """The share of each wanted (from, to) flow that may move: swaps between two shards, then what is left of a shard's room, unless it is closed."""
    granted = {pair: min(n, flow.get(pair[::-1], 0)) for pair, n in flow.items()}
    for to in range(len(load)):
        room = 0 if to in closed else max(0, int(FILL * capacity[to]) - load[to])
        rest = sum(flow[p] - granted[p] for p in flow if p[1] == to)
        for p in flow:
            if p[1] == to and rest:
                granted[p] += (flow[p] - granted[p]) * min(1.0, room / rest)
    return {p: granted[p] / n for p, n in flow.items() if n}


def propagate(atoms: DataFrame, shards: int, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``atoms`` (g1, g2, chunk, n, shard) after the rounds. Only tables of shards x shards numbers come to the driver."""
    spark = atoms.sparkSession
    key = ["g1", "g2"]
    for r in range(rounds):
        held = atoms.groupBy(*key, "shard").agg(F.sum("n").alias("here"))
        if r == 0:
            loads = atoms.groupBy("shard").agg(F.sum("n").alias("n")).collect()
            load = [0] * shards
            for row in loads:
                load[row.shard] = row.n
        open_ = [t for t in range(shards) if load[t] < OPEN * capacity[t]]
        liked = F.struct(F.col("here").alias("n"), F.xxhash64(*key, "shard").alias("o"), F.col("shard").alias("s"))
        is_open = F.col("shard").isin(open_) if open_ else F.lit(False)
        best = held.groupBy(*key).agg(F.max(F.when(is_open, liked)).alias("top"), F.max(F.when(~is_open, liked)).alias("full"))
        named = (atoms.join(held, [*key, "shard"]).join(best, key, "left")
                 .withColumn("rank", F.struct(F.col("here").alias("n"), F.xxhash64(*key, "shard").alias("o"), F.col("shard").alias("s")))
                 .withColumn("want", F.when(F.col("top") > F.col("rank"), F.col("top.s"))
                             .when(F.col("full") > F.col("rank"), F.col("full.s")))
                 .select(*key, "chunk", "n", "shard", "want"))
        named = stored(named)
        counts = named.groupBy("shard", "want").agg(F.sum("n").alias("n")).collect()  # at most shards x (shards + 1) rows
        load = [sum(row.n for row in counts if row.shard == t) for t in range(shards)]
        flow = {(row.shard, row.want): row.n for row in counts if row.want is not None}
        if not flow:
            return named.drop("want")
        shares = quotas(flow, load, capacity, frozenset(range(shards)) - frozenset(open_))
        allowed = [(a, b, share) for (a, b), share in shares.items() if share > 0]
        if not allowed:
            return named.drop("want")
        values = ", ".join(f"({a}, {b}, {share!r}D)" for a, b, share in allowed)
        grant = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(shard, want, share)"))  # at most shards x shards rows
        moved = (F.col("share").isNotNull()) & (_share(r, *key, "chunk") < F.col("share"))
        atoms = named.join(grant, ["shard", "want"], "left").select(
            *key, "chunk", "n", F.when(moved, F.col("want")).otherwise(F.col("shard")).alias("shard"))
        for (a, b), share in shares.items():
            load[a] -= int(flow[a, b] * share)
            load[b] += int(flow[a, b] * share)
    return atoms


def chunked(rows: DataFrame, chunks: int) -> DataFrame:
    """``rows`` with ``chunk``, below ``chunks``, and ``salt``: the place of a row that its id and group do not tell from all others, else null."""
    key = ["g1", "g2"]
    base = rows.drop("shard", "slot", "chunk", "n", "linked", "bucket", "salt", "many").withColumns({
        "g1": F.coalesce("g1", F.lit(0)), "g2": F.coalesce("g2", F.lit(0)), "salt": F.monotonically_increasing_id()})
    repeats = stored(base.where("id is not null").groupBy("id", *key).agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    if repeats.isEmpty():
        base = base.withColumn("salt", F.when(F.col("id").isNull(), F.col("salt")))
    else:
        base = stored(base.join(repeats, ["id", *key], "left").withColumn(
            "salt", F.when(F.col("id").isNull() | F.col("many").isNotNull(), F.col("salt"))).drop("many"))
    return base.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(17), "salt"), F.lit(chunks)).cast("int"))


def balanced_shards(rows: DataFrame, shards: int = 16, rounds: int = ROUNDS, chunks: int = CHUNKS) -> DataFrame:
    """``rows`` (id, g1, g2 and more) with ``shard`` and a gapless ``slot`` from 0; row counts differ by one at most.

    g1 and g2 name a row's group; null is a group like any other. Equal rows take neighbouring slots. ``rows`` is read several
    times: store it first. Columns named shard, slot, chunk, n, linked, bucket, salt or many are replaced.

    Chunks go by the hash of the id. Rows without an id, and those that share id and group with another, are told apart by their
    place in the stored ``rows``, so they fall into as many chunks as other rows do.
    """
    key = ["g1", "g2"]
    base = chunked(rows, chunks)
    total = base.count()
    capacity = [total // shards + (t < total % shards) for t in range(shards)]
    per_chunk = base.groupBy(*key, "chunk").agg(F.count(F.lit(1)).alias("n"))
    per_group = per_chunk.groupBy(*key).agg(F.sum("n").alias("all")).where("all > 1")
    linked = per_chunk.join(per_group, key, "left_semi").withColumn("shard", F.pmod("chunk", F.lit(shards)))
    placed = stored(propagate(linked, shards, capacity, rounds))
    joined = base.join(placed.drop("n"), [*key, "chunk"], "left").withColumn("linked", F.col("shard").isNotNull()).withColumn(
        "shard", F.coalesce("shard", F.pmod("chunk", F.lit(shards))).cast("int"))

    # number the rows of each shard: buckets by hash, the linked ones first, with the rows of earlier buckets before them
    runs = max(1, total // (shards * RUN))
    joined = joined.withColumn("bucket", F.when(F.col("linked"), 0).otherwise(runs) + F.pmod(F.xxhash64("id", "g1", "salt"), F.lit(runs)).cast("int"))
    joined = stored(joined)
    sizes = joined.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = Window.partitionBy("shard", "bucket").orderBy("id", "g1", "g2")
    numbered = joined.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.row_number().over(at) - 1)

    # rows beyond a shard's capacity fill the free slots of the others, in order
    held = [0] * shards
    for row in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        held[row.shard] = row.n
    over, free, n_over, n_free = F.lit(None).cast("long"), [], 0, 0
    cases = None
    for t in range(shards):
        if held[t] > capacity[t]:
            here = (F.col("shard") == t) & (F.col("slot") >= capacity[t])
            value = F.col("slot") - capacity[t] + n_over
            cases = F.when(here, value) if cases is None else cases.when(here, value)
            n_over += held[t] - capacity[t]
        elif held[t] < capacity[t]:
            free.append((n_free, n_free + capacity[t] - held[t], t, held[t]))
            n_free += capacity[t] - held[t]
    numbered = numbered.withColumn("over", over if cases is None else cases)
    shard, slot = F.col("shard"), F.col("slot")
    for low, high, t, first in free:
        inside = (F.col("over") >= low) & (F.col("over") < high)
        shard, slot = F.when(inside, F.lit(t)).otherwise(shard), F.when(inside, F.col("over") - low + first).otherwise(slot)
    return numbered.withColumns({"shard": shard, "slot": slot}).drop("first", "over", "bucket", "chunk", "salt")
