"""Filling fixed-capacity containers with items.

Bulk-synchronous best fit.  Documents and gaps are kept sorted as runs: documents of one size, and neighbouring
containers of one gap, are interchangeable, so a capacity of C tokens gives at most C runs of documents and a few times as
many of gaps, however many documents there are.  Supersteps go down the sizes; each takes the documents of one span of
sizes (``RATIO``), and in it

1. documents and gaps are cut into ranges by size, and every range is swept on its own: going up, each gap takes the
   largest waiting document (the gap is its successor);
2. what waits at the end of a range is carry-over.  From the ranges' totals alone each carry-over gets ranks of gaps in
   higher ranges, nearest first; where several ranges want one, ranks decide, larger documents first.  Gaps above the
   span have a place for every document of the span they surely hold.  Documents beyond the last gap open containers;
3. the ranges with gaps take in what was sent to them, place by place, and gaps are updated,

and so on until no sizes are left.  No task sees a whole plan: a range has a bounded number of sizes (``RANGE_SIZES``).
Documents only meet this twice, both times distributed: once to be counted by size, once to look up their container by
their rank within their size.  Ranks are taken within slices of each size, so a size that a third of all documents share
is spread out.

Documents of size 0 or null are left out.  A document above the capacity is cut into full pieces and a rest, which is
packed like any other; nothing else is cut.  Repeated document ids each count as an item of their own.  Plans with a null
id or without a positive capacity are left out; of a plan listed twice the smaller capacity holds.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import cut

#: The largest size of a superstep's span against its smallest: for sizes above an eighth of the capacity, which decide how
#: many containers are opened, and for the others, which fill gaps.
RATIO, LOW_RATIO = 1.25, 2.0
#: Sizes of one range; a span has ``MOST_RANGES`` ranges at most on either side of its largest size.
RANGE_SIZES, MOST_RANGES = 32, 1024
#: Documents of one size whose ranks one task takes, on average.
SLICE_ROWS = 100_000
#: Ranks of one size that share a join key when documents look up their container.
RANKS = 16

ROWS = "kind string, plan_id int, part int, at long, size int, start long, n long, each long, slots long, container long"
TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
SCHEMA = pa.schema(list(zip([c.split()[0] for c in ROWS.split(", ")], TYPES)))


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], schema=SCHEMA) if rows else SCHEMA.empty_table()


def placed(plan: int, size: int, start: int, n: int, each: int, container: int) -> tuple:
    """Documents of ranks ``start`` to ``start + n - 1`` of a size; ``each`` of them in a container, from ``container`` on."""
    return ("placed", plan, 0, 0, size, start, n, each, 0, container)


def gap_row(kind: str, plan: int, part: int, at: int, gap: int, first: int, n: int, slots: int) -> tuple:
    """``n`` containers from ``first`` on with ``gap`` free tokens and ``slots`` places each."""
    return (kind, plan, part, at, gap, first, n, 0, slots, first)


def sweep(range_rows: pa.Table) -> pa.Table:
    """One range: pair its documents with its gaps, going up; what is left over comes out with its rank in the range."""
    rows = range_rows.to_pylist()
    plan, part = rows[0]["plan_id"], rows[0]["part"]
    rows.sort(key=lambda r: (r["size"], r["kind"] == "gap", r["start"]))
    if part < 0:
        return range_rows
    out, waiting, gap_at = [], [], 0
    for r in rows:
        if r["kind"] == "doc":
            waiting.append([r["size"], r["start"], r["n"]])
            continue
        gap, first, left = r["size"], r["start"], r["n"]
        while left and waiting:
            size, start, n = waiting[-1]
            take = min(left, n)
            out.append(placed(plan, size, start, take, 1, first))
            if gap > size:
                out.append(gap_row("gap", plan, 0, 0, gap - size, first, take, 0))
            first, left = first + take, left - take
            if take == n:
                waiting.pop()
            else:
                waiting[-1] = [size, start + take, n - take]
        if left and r["slots"]:
            out.append(gap_row("gap_left", plan, part, gap_at, gap, first, left, r["slots"]))
            gap_at += left * r["slots"]
        elif left:
            out.append(gap_row("gap", plan, 0, 0, gap, first, left, 0))
    at = 0
    for size, start, n in reversed(waiting):
        out.append(("doc_left", plan, part, at, size, start, n, 0, 0, 0))
        at += n
    # What the driver sees of a range: documents and places left over, and the largest of the documents.
    out.append(("total", plan, part, 0, waiting[-1][0] if waiting else 0, 0, at, 0, gap_at, 0))
    return table_of(out)


def take_in(range_rows: pa.Table) -> pa.Table:
    """One range of gaps and the documents sent to it, both by rank: fill place after place."""
    rows = range_rows.to_pylist()
    plan = rows[0]["plan_id"]
    gaps = sorted((r for r in rows if r["kind"] == "gap_left"), key=lambda r: r["at"])
    docs = sorted((r for r in rows if r["kind"] == "doc_left"), key=lambda r: r["at"])
    out: list[tuple] = []

    def free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            out.append(gap_row("gap", plan, 0, 0, gap, first, n, 0))

    stack = [[r["size"], r["start"], r["n"], r["slots"]] for r in reversed(gaps)]
    for d in docs:
        size, start, left = d["size"], d["start"], d["n"]
        while left:
            gap, first, n, slots = stack.pop()
            full = min(n, left // slots)
            if full:
                out.append(placed(plan, size, start, full * slots, slots, first))
                free(gap - slots * size, first, full)
                start, left = start + full * slots, left - full * slots
            if full < n:
                if left:
                    out.append(placed(plan, size, start, left, left, first + full))
                    if full + 1 < n:
                        stack.append([gap, first + full + 1, n - full - 1, slots])
                    stack.append([gap - left * size, first + full, 1, slots - left])
                    left = 0
                else:
                    stack.append([gap, first + full, n - full, slots])
    for gap, first, n, _ in stack:
        free(gap, first, n)
    return table_of(out)


#: Ranges from this number down only wait: gaps below the span, and placements on their way out.
WAITING = -1
#: Ranges from this number on are of the containers a superstep opens.
OPENED = 1 << 20


def carry(totals: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Of ``(range, documents, places)`` left over: flows ``(from, rank, to, rank, n)`` into higher ranges, and what finds none.

    Going up, the places of a range take the nearest carry-over below, largest documents first.
    """
    flows, waiting = [], []
    for part, docs, places in sorted(totals):
        at = 0
        while places and waiting:
            source, rank, n = waiting.pop()
            take = min(places, n)
            flows.append((source, rank, part, at, take))
            at, places = at + take, places - take
            if take < n:
                waiting.append((source, rank + take, n - take))
        if docs:
            waiting.append((part, 0, docs))
    return flows, waiting[::-1]


def best_fit_rounds(sizes: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Pack ``sizes`` (plan_id, capacity, size, n): placements (plan_id, size, start, n, each, container), and containers a plan.

    The item of rank r of a size is in container ``container + (r - start) // each``.  The driver holds the spans of
    sizes and the totals of ranges, whose number the plans bound.
    """
    spark = sizes.sparkSession
    part_of = F.col("capacity") / F.col("size")
    # No two sizes above half the capacity fit together, nor into gaps of such: one span, whatever its width.
    wave = F.when(part_of < 2, 0).when(part_of < 8, F.floor(F.log(part_of) / F.log(F.lit(RATIO)))).otherwise(F.lit(100) + F.floor(F.log(part_of / 8) / F.log(F.lit(LOW_RATIO)))).cast("int")
    runs = cut(sizes.withColumn("wave", wave))
    spans: dict[int, list] = defaultdict(list)
    for r in runs.groupBy("wave", "plan_id", "capacity").agg(F.min("size").alias("lo"), F.max("size").alias("hi")).collect():
        spans[r.wave].append((r.plan_id, r.capacity, r.lo, r.hi))
    opened: dict[int, int] = defaultdict(int)
    kept, filled, done = None, None, []
    for number in sorted(spans):
        limits = {plan: (capacity, lo, hi) for plan, capacity, lo, hi in spans[number]}
        given = F.broadcast(local_rows(spark, [(p, *x) for p, x in limits.items()], "of int, capacity long, lo int, hi int"))
        now = runs.where(F.col("wave") == number).select(F.lit("doc").alias("kind"), "plan_id", "size", F.lit(0).cast("long").alias("start"), "n", *[F.lit(0).cast("long").alias(c) for c in ("each", "container")])
        if filled is not None:
            now = now.unionByName(kept.unionByName(filled).select(*now.columns))
        swept = cut(in_ranges(now.join(given, F.col("plan_id") == F.col("of"), "left")).groupBy("plan_id", "part").applyInArrow(sweep, ROWS))
        done.append(swept.where("kind = 'placed'"))
        left, largest = defaultdict(list), {}
        for r in swept.where("kind = 'total'").select("plan_id", "part", "n", "slots", "size").collect():
            left[r.plan_id].append((r.part, r.n, r.slots))
            largest[r.plan_id, r.part] = r.size
        flows, fresh = [], []
        for plan, totals in left.items():
            capacity = limits[plan][0]
            found, beyond = carry(totals)
            for k, (source, rank, n) in enumerate(beyond):
                each = capacity // largest[plan, source]
                found.append((source, rank, OPENED + k, 0, n))
                fresh.append(gap_row("gap_left", plan, OPENED + k, 0, capacity, opened[plan], -(-n // each), each))
                opened[plan] += -(-n // each)
            flows += [(plan, *f) for f in found]
        kept = swept.where("kind = 'gap'")
        if not flows:
            filled = swept.where("kind = 'gap_left'").withColumn("kind", F.lit("gap"))
            continue
        sent = F.broadcast(local_rows(spark, flows, "p int, source int, rank long, target int, place long, amount long"))
        begin, end = F.greatest("at", "rank"), F.least(F.col("at") + F.col("n"), F.col("rank") + F.col("amount"))
        waiting = swept.where("kind = 'doc_left'").join(sent, (F.col("plan_id") == F.col("p")) & (F.col("part") == F.col("source")) & (F.col("at") < F.col("rank") + F.col("amount")) & (F.col("at") + F.col("n") > F.col("rank")))
        moved = waiting.select("kind", "plan_id", F.col("target").alias("part"), (F.col("place") + begin - F.col("rank")).alias("at"), "size", (F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("n"), "each", "slots", "container")
        room = swept.where("kind = 'gap_left'")
        room = room.unionByName(local_rows(spark, fresh, ROWS)) if fresh else room
        filled = moved.unionByName(room).groupBy("plan_id", "part").applyInArrow(take_in, ROWS)
    if not done:
        return local_rows(spark, [(0,) * 6], "plan_id int, size int, start long, n long, each long, container long").limit(0), {}
    placements = reduce(DataFrame.union, done, filled.where("kind = 'placed'")).select("plan_id", "size", "start", "n", "each", "container")
    return placements, dict(opened)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as literals of the plan, so that no job reads it."""
    columns = [c.split() for c in schema.split(", ")]
    text = ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in columns)} FROM VALUES {text} AS t({', '.join(c for c, _ in columns)})")


def in_ranges(rows: DataFrame) -> DataFrame:
    """Documents of a span, gaps and placements with the range each belongs to."""
    size, lo, hi = F.col("size"), F.col("lo"), F.col("hi")
    below = F.least(F.lit(MOST_RANGES), F.expr(f"1 + (hi - lo) div {RANGE_SIZES}"))
    above = F.least(F.lit(MOST_RANGES), F.expr(f"1 + (capacity - hi) div {RANGE_SIZES}"))
    active = F.col("of").isNotNull() & (size >= lo) & F.col("kind").isin("doc", "gap")
    roomy = (F.col("kind") == "gap") & (size >= hi)
    part = (
        F.when(~active, F.lit(WAITING) - F.expr(f"size div {RANGE_SIZES}"))
        .when(roomy, F.lit(MOST_RANGES) + F.floor((size - hi) * above / (F.col("capacity") - hi + 1)))
        .otherwise(F.floor((size - lo) * below / (hi - lo + 1)))
    )
    slots = F.when(~active | (F.col("kind") == "doc"), 0).when(roomy, F.expr("size div hi")).otherwise(1)
    zero = F.lit(0).cast("long")
    return rows.select("kind", "plan_id", part.cast("int").alias("part"), zero.alias("at"), "size", "start", "n", "each", slots.cast("long").alias("slots"), "container")


def items_of(sizes: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` (a row a document and plan, with its slice), ``counted`` (documents to place by plan, size and slice), and slices."""
    docs = cut(sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n")))
    slices = 64 + docs.count() // SLICE_ROWS
    plans = plan.where("plan_id is not null and capacity_tokens > 0").groupBy("plan_id").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    rows = docs.crossJoin(plans).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))
    rest = F.when(F.col("n") <= F.col("capacity"), F.col("n")).otherwise(F.col("n") % F.col("capacity"))
    rows = rows.withColumn("size", rest.cast("int")).withColumn("full", F.expr("case when n <= capacity then 0 else n div capacity end"))
    counted = cut(rows.where("size > 0").groupBy("plan_id", "capacity", "size", "slice").agg(F.count("*").alias("n")))
    return rows, counted, slices


def packing(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan_id, container, doc_id, piece, from_token, n_tokens``: every document of ``sizes`` (doc_id, n_tokens) in each plan.

    Containers of full pieces have negative numbers, the others count from 0.
    """
    rows, counted, slices = items_of(sizes, plan)
    runs, _ = best_fit_rounds(counted.groupBy("plan_id", "capacity", "size").agg(F.sum("n").alias("n")))
    by_slice = W.partitionBy("plan_id", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = counted.select("plan_id", "size", "slice", F.coalesce(F.sum("n").over(by_slice), F.lit(0)).alias("before"))
    within = W.partitionBy("plan_id", "size", "slice").orderBy("doc_id")
    items = rows.where("size > 0").select("plan_id", "capacity", "doc_id", "size", F.col("full").cast("int").alias("piece"), "slice")
    ranked = items.withColumn("place", F.row_number().over(within) - 1).join(before, ["plan_id", "size", "slice"]).withColumn("rank", F.col("place") + F.col("before"))
    # A key of a few ranks, so that a document meets the runs around it, not all of its size.
    keyed = runs.withColumn("step", F.explode(F.sequence(F.expr(f"start div {RANKS}"), F.expr(f"(start + n - 1) div {RANKS}"))))
    met = ranked.withColumn("step", F.expr(f"rank div {RANKS}")).join(keyed, ["plan_id", "size", "step"])
    placed_rows = met.where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
    packed = placed_rows.select("plan_id", F.expr("container + (rank - start) div each").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("from_token"), F.col("size").alias("n_tokens"))
    offset = W.partitionBy("plan_id", "slice").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.where("full > 0").withColumn("before", F.coalesce(F.sum("full").over(offset), F.lit(0)))
    pieces = numbered.select("plan_id", "doc_id", "capacity", "slice", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    # A full piece fills its container; interleaving the slices keeps the numbers apart without counting all.
    full = pieces.select("plan_id", (-(((F.col("before") + F.col("k")) * slices) + F.col("slice") + 1)).alias("container"), "doc_id", F.col("k").cast("int").alias("piece"), (F.col("k") * F.col("capacity")).alias("from_token"), F.col("capacity").cast("int").alias("n_tokens"))
    return packed.unionByName(full)


def packing_report(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Per plan: containers, tokens, the least number of containers any packing needs, and the share of space used.

    From the runs alone; no document is placed.
    """
    rows, counted, _ = items_of(sizes, plan)
    _, opened = best_fit_rounds(counted.groupBy("plan_id", "capacity", "size").agg(F.sum("n").alias("n")))
    used = local_rows(sizes.sparkSession, sorted(opened.items()) or [(0, 0)], "plan_id int, opened long")
    totals = rows.groupBy("plan_id", "capacity").agg(F.sum("n").alias("tokens"), F.sum("full").alias("full")).join(used, "plan_id", "left")
    totals = totals.withColumn("containers", F.col("full") + F.coalesce("opened", F.lit(0)))
    return totals.select("plan_id", F.col("capacity").cast("int").alias("capacity"), "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))
