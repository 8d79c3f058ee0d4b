"""Mixing sources to target weights.

Sources may overlap: a document can belong to several. Documents are aggregated by membership pattern; a min-cost
flow routes each pattern's token capacity to the quotas of its sources, where every repetition of a document costs
more than the one before; then seeded documents fill what a pattern gives. Only sums per source, per pattern and
per hash range pass through the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import materialize

MAX_REPEATS = 3
SEED = 20_240_501
#: Rows per range of the seeded order, about; ranges are hash prefixes of 12 to 24 bits.
RANGE_ROWS = 100_000
#: The flow is solved on the driver and its plan is broadcast: more membership patterns than this are an error.
MAX_PATTERNS = 10_000
FILL_ROUNDS = 4


def targets(sizes: dict, weights: Sequence[float], most: float = MAX_REPEATS) -> dict:
    """A target per source. Sources in order of code points, null last, take the weights in turn and share all
    tokens by them; no target exceeds most times its source's size, and what is over goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(n: int, arcs: Sequence[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a maximal flow of least cost, by successive shortest paths
    with potentials. Costs must not be negative."""
    graph: list[list[_Arc]] = [[] for _ in range(n)]
    at = []
    for a, b, room, cost in arcs:
        at.append((a, len(graph[a])))
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))
    height = [0] * n
    while True:
        far: list[float] = [float("inf")] * n
        came: list[tuple[int, int] | None] = [None] * n
        far[source] = 0
        heap: list[tuple[float, int]] = [(0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            for k, arc in enumerate(graph[v]):
                if arc.room and (e := d + arc.cost + height[v] - height[arc.to]) < far[arc.to]:
                    far[arc.to], came[arc.to] = e, (v, k)
                    heapq.heappush(heap, (e, arc.to))
        if far[sink] == float("inf"):
            return [arcs[i][2] - graph[a][k].room for i, (a, k) in enumerate(at)]
        height = [h + int(d) if d < float("inf") else h for h, d in zip(height, far)]
        push, v = float("inf"), sink
        while v != source:
            u, k = came[v]
            push, v = min(push, graph[u][k].room), u
        v = sink
        while v != source:
            u, k = came[v]
            graph[u][k].room -= push
            graph[v][graph[u][k].back].room += push
            v = u


def route(patterns: dict[tuple, int], quota: dict, most: int = MAX_REPEATS) -> dict[tuple, int]:
    """Tokens that each membership pattern gives in all. patterns: its size. The n-th repetition costs (n - 1)^2, so
    that documents are repeated only when all fitting ones are used, and the least repeated first."""
    sources, names = list(quota), list(patterns)
    first_source, first_pattern = 2, 2 + len(sources)
    where = {s: first_source + i for i, s in enumerate(sources)}
    arcs = [(0, where[s], round(quota[s]), 0) for s in sources]
    for i, p in enumerate(names):
        arcs += [(where[s], first_pattern + i, most * patterns[p], 0) for s in p]
    tiers = len(arcs)
    for i, p in enumerate(names):
        arcs += [(first_pattern + i, 1, patterns[p], n * n) for n in range(most)]
    flow = min_cost_flow(first_pattern + len(names), arcs, 0, 1)
    return {p: sum(flow[tiers + i * most : tiers + (i + 1) * most]) for i, p in enumerate(names)}


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), key: str = "doc_id", size: str = "size", members: str = "members", most: int = MAX_REPEATS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """How many tokens of each document the mix takes.

    docs: key, size (tokens, long) and members (array of sources; a null inside is a source of its own, a null or
    empty array is the null source alone). Returns key, size, members, pattern_target (what the flow takes of the
    document's pattern), taken (a multiple of size, at most most times it) and quotas (map from source, null as
    the key of its own column null_quota). An empty table gives no rows; documents of size 0 take 0. Repeated rows
    are rows of their own, each taken at most most times; equal rows are interchangeable, so which of them is repeated
    once more is left open. row: a column that names each row (unique longs of a written table), returned as row, for
    callers that go back to their rows. Other columns are not read. More than MAX_PATTERNS patterns raise ValueError.
    """
    spark = docs.sparkSession
    alone = F.array(F.lit(None).cast("string"))
    pattern = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(members), F.lit(0)) < 1, alone).otherwise(F.col(members))))
    # a row's name is fixed once it is written; only equal rows are told apart by it
    named = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), pattern.alias("members"), named.alias("row"))
    rows = materialize(rows.withColumn("rank", F.xxhash64(F.lit(seed), "key", "size")), "mix-rows")
    sums = rows.groupBy("members").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = {tuple(r.members): r.s for r in sums}
    bits = min(24, max(12, math.ceil(math.log2(max(1, sum(r.n for r in sums)) / RANGE_ROWS))))
    rows = rows.withColumn("range", F.shiftrightunsigned("rank", 64 - bits).cast("int"))
    sources: dict = {}
    for p, s in found.items():
        for x in p:
            sources[x] = sources.get(x, 0) + s
    total = sum(found.values())
    quota = targets(sources, weights, most)
    if sum(quota.values()) > total and any(len(p) > 1 for p in found):
        quota = {s: q * total / sum(quota.values()) for s, q in quota.items()}
    given = route(found, quota, most)
    plan = [(list(p), given[p], given[p] // s if s else 0, given[p] % s if s else 0) for p, s in found.items()]
    plan_type = T.StructType.fromDDL("members array<string>, pattern_target long, whole long, rest long")
    planned = spark.createDataFrame(plan, plan_type)  # one row per membership pattern
    same = lambda a, b: a["members"].eqNullSafe(b["members"])
    # where the seeded order of a pattern reaches its rest: sums per range of the order first, then inside one range
    sums = rows.groupBy("members", "range").agg(F.sum("size").alias("s"))
    below = F.coalesce(F.sum("s").over(Window.partitionBy("members").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("below", below)
    cuts = sums.join(F.broadcast(planned), same(sums, planned)).where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("s") > F.col("rest"))).select(sums["members"], "range", "below", "rest")
    cut = {tuple(r.members): (r.range, r.below) for r in cuts.collect()}
    bound_type = T.StructType.fromDDL("m array<string>, pattern_target long, whole long, rest long, cut int, below long")
    bounds = spark.createDataFrame([(p, given, whole, rest, *cut.get(tuple(p), (0, 0))) for p, given, whole, rest in plan], bound_type)
    rows = rows.join(F.broadcast(bounds), rows["members"].eqNullSafe(bounds["m"])).drop("m")
    inside = rows.where(F.col("range") == F.col("cut"))
    # in the range of the cut, equal rows are one class with a count, however many they are
    classes = inside.groupBy("members", "rank", "key", "size").agg(F.count("*").alias("n"), F.first("below").alias("below"), F.first("rest").alias("rest"))
    before = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("members").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("rest") - F.col("below") - F.coalesce(before, F.lit(0))
    fit = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.floor(room / F.col("size")))).otherwise(0)
    classes = classes.select(*[F.col(c).alias(f"c_{c}") for c in ("members", "rank", "key", "size", "n")], F.least("n", fit).cast("long").alias("fit"))
    own = (F.col("members").eqNullSafe(F.col("c_members"))) & (F.col("rank") == F.col("c_rank")) & F.col("key").eqNullSafe(F.col("c_key")) & (F.col("size") == F.col("c_size"))
    classes = materialize(classes, "mix-classes")  # read anew, so that the rows of a class of very many can be split
    inside = inside.join(classes, own).withColumn("part", F.shiftright("row", 20))
    # where a class is cut, its rows are counted by the leading bits of their names, then inside one such part
    split = inside.where("fit > 0 and fit < c_n")
    parts = split.groupBy("members", "rank", "key", "size", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("members", "rank", "key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.select(*[F.col(c).alias(f"p_{c}") for c in ("members", "rank", "key", "size", "part")], F.coalesce(earlier, F.lit(0)).alias("earlier")), "mix-parts")
    mine = (F.col("members").eqNullSafe(F.col("p_members"))) & (F.col("rank") == F.col("p_rank")) & F.col("key").eqNullSafe(F.col("p_key")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part"))
    nth = F.col("earlier") + F.row_number().over(Window.partitionBy("members", "rank", "key", "size", "part").orderBy("row"))
    split = split.join(parts, mine).withColumn("extra", (nth <= F.col("fit")).cast("int"))
    even = inside.where("fit = 0 or fit = c_n").withColumn("extra", (F.col("fit") > 0).cast("int"))
    outside = rows.where(F.col("range") != F.col("cut")).withColumn("extra", (F.col("range") < F.col("cut")).cast("int"))
    chosen = materialize(outside.unionByName(even.select(outside.columns)).unionByName(split.select(outside.columns)), "mix-chosen")
    # in each round, each pattern takes in or gives back the one row that brings it nearest to its rest
    step = F.when(F.col("extra") == 1, -F.col("size")).otherwise(F.col("size"))
    swapped: list[tuple] = []
    gap = F.max("rest") - F.sum(F.col("size") * F.col("extra"))
    gaps = {tuple(r.members): r.gap for r in chosen.groupBy("members").agg(gap.alias("gap")).collect()}
    for _ in range(FILL_ROUNDS):
        need = spark.createDataFrame([(list(m), g - sum(x for p, _, x in swapped if p == m)) for m, g in gaps.items()], T.StructType.fromDDL("m array<string>, gap long"))
        done = [k for _, k, _ in swapped]
        fits = chosen.join(F.broadcast(need), chosen["members"].eqNullSafe(need["m"])).where(F.abs(F.col("gap") - step) < F.abs("gap"))
        fits = fits.where(~F.col("row").isin(done)) if done else fits
        best = fits.groupBy("members").agg(F.min_by(F.struct("row", step.alias("step")), F.struct(F.abs(F.col("gap") - step), "rank", "key", "row")).alias("best")).collect()
        if not best:
            break
        swapped += [(tuple(r.members), r.best.row, r.best.step) for r in best]
    extra = F.when(F.col("row").isin([k for _, k, _ in swapped]), 1 - F.col("extra")).otherwise(F.col("extra")) if swapped else F.col("extra")
    named = {s: float(q) for s, q in quota.items() if s is not None}
    quotas = F.create_map(*[x for s, q in named.items() for x in (F.lit(s), F.lit(q))]) if named else F.create_map().cast("map<string,double>")
    return chosen.select(
        *([] if row is None else ["row"]),
        "key",
        "size",
        "members",
        F.col("pattern_target").cast("double").alias("pattern_target"),
        (F.col("size") * (F.col("whole") + extra)).cast("long").alias("taken"),
        quotas.alias("quotas"),
        F.lit(float(quota.get(None, 0.0))).alias("null_quota"),
    )
