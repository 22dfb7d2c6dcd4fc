"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Every source is cut into blocks by a hash of ``doc_id``; a source's word
target is a number of whole passes over its blocks plus a last pass over a
random prefix of its permuted blocks.  All these block quotas are split over
the output shards by a binary tree: at each node the units are ranked by a
seeded hash and halved, so the quotas of the two children are one exact
multivariate-hypergeometric draw.  Each shard then draws a disjoint range of
each source's permuted blocks; a document is taken as often as shards draw it.
The block at the target's edge is cut inside, and a few single documents
bring the source's words as near to the target as they can.  Only DataFrame
operations are used; ranks are found from counts of hash ranges, so no task
sorts all units or a whole block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges (2**16) in which units and documents are counted before ranking.
_RANGE = 44
#: Single documents added or dropped to come nearer to a source's target.
ROUNDS = 2


def _code(*parts) -> F.Column:
    """A 60-bit number from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def plan_blocks(sized: DataFrame, weights, share: float, max_epochs: int, blocks: int, seed: int) -> DataFrame:
    """One row per (source, block): target, whole passes and partial quota."""
    table = written(
        sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_docs")), "mix-blocks"
    )
    totals = table.groupBy("source").agg(F.sum("block_size").alias("source_size"), F.sum("block_docs").alias("source_docs"))
    # One row per source: the order of sources is global by contract.
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    # Water filling: sources sorted by cap/weight stop at their caps one after
    # another; the first level that fits below the next cap is the level of all.
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.floor(F.sum("source_size").over(everything) * F.lit(share)).cast("long")
    ranked = ranked.select(
        "*",
        total.alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    ranked = ranked.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("final", F.min_by("level", F.when(fits, F.col("place"))).over(everything))
    ranked = ranked.withColumn(
        "target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    )
    ranked = ranked.select(F.col("source").alias("_source"), "source_size", "target").withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    )
    out = table.join(bounded_broadcast(ranked), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    out = out.withColumn("perm", _code(F.lit(f"perm{seed}"), F.coalesce(F.col("source"), F.lit("\x00")), F.col("block")))
    run = Window.partitionBy("source").orderBy("perm", "block")
    out = out.withColumn("unit", F.row_number().over(run)).withColumn("upto", F.sum("block_size").over(run))
    quota = F.col("target") - F.col("whole") * F.col("source_size") - (F.col("upto") - F.col("block_size"))
    return out.withColumn("quota", quota).select(
        "source", "block", "unit", "source_size", "target",
        "whole", (F.col("whole") + (F.col("quota") >= F.col("block_size")).cast("int")).alias("passes"),
        F.when((F.col("quota") > 0) & (F.col("quota") < F.col("block_size")), F.col("quota")).alias("partial"),
    )


def _halved(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: the units of each node in hash order, cut in half.

    Counts of 2**16 hash ranges per node show in which range the middle lies;
    only that range's units are ranked.
    """
    key = _code(F.lit(f"tree{seed}.{level}"), F.coalesce("source", F.lit("\x00")), F.col("unit"), F.col("pass"))
    units = units.withColumn("key", key).withColumn("range", F.shiftright("key", _RANGE))
    counts = units.groupBy(F.col("node").alias("_node"), F.col("range").alias("_range")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("_node").orderBy("_range")
    counts = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("_node")))
    counts = counts.withColumn("half", F.floor((F.col("all") + F.col("_node") % 2) / 2))
    # One row for each node: fewer than 2 ** levels rows.
    middle = counts.where("upto >= half AND upto - n < half").select("_node", F.col("_range").alias("_middle"), (F.col("half") - (F.col("upto") - F.col("n"))).alias("_left"))
    met = units.join(F.broadcast(middle), F.col("node") == F.col("_node"), "left")
    inside = F.col("range").eqNullSafe(F.col("_middle"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("key", "source", "unit", "pass"))
    ranked = met.where(inside).withColumn("right", (place > F.col("_left")).cast("int"))
    rest = met.where(~inside).withColumn("right", F.coalesce(F.col("range") > F.col("_middle"), F.lit(True)).cast("int"))
    out = ranked.unionByName(rest)
    return out.select("source", "unit", "block", "pass", (F.col("node") * 2 + F.col("right")).alias("node"))


def split_tree(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """Give each (source, block, pass) its shard; the last pass may be partial."""
    units = plan.withColumn("n", F.col("passes") + F.col("partial").isNotNull().cast("int")).where("n > 0")
    units = units.select("source", "unit", "block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pass"), F.lit(0).alias("node"))
    for level in range(levels):
        units = written(_halved(units, level, seed), "mix-tree")
    # At most blocks x passes rows for each source.
    source = Window.partitionBy("source")
    blocks = units.select("source", "block", "pass", F.row_number().over(source.orderBy("pass", "unit")).alias("i"))
    shards = units.select(
        F.col("source").alias("_source"), F.col("node").alias("shard"),
        F.row_number().over(source.orderBy("node", "pass", "unit")).alias("_i"),
    )
    met = blocks.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("i") == F.col("_i")))
    return met.select("source", "block", "pass", "shard")


def _edge_cuts(sized: DataFrame, plan: DataFrame, number: int) -> DataFrame:
    """(source, cut, gap): the order key up to which the edge block is drawn, and
    the words that the target then still lacks (below 0: has too many)."""
    edge = plan.where("partial IS NOT NULL").select(F.col("source").alias("_source"), F.col("block").alias("_block"), "partial")
    inside = sized.join(bounded_broadcast(edge, rows=number), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    inside = inside.withColumn("range", F.shiftright("order_key", _RANGE))
    sums = inside.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("partial").alias("partial"))
    sums = sums.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words"))
    last = sums.where("start <= partial").groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("range", "start", "partial")).alias("x"))
    last = last.select("_s", F.col("x.range").alias("_range"), F.col("x.start").alias("_start"), F.col("x.partial").alias("_partial"))
    # The edge lies in one range of one block: only its documents are ranked.
    rows = inside.join(bounded_broadcast(last, rows=number), F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_range")))
    run = Window.partitionBy("source").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("_start") + F.sum("size").over(run)).withColumn("near", F.col("upto") - F.col("size") / 2)
    fits = F.col("near") <= F.col("_partial")
    cut = F.coalesce(F.max(F.when(fits, F.col("order_key"))), F.shiftleft(F.first("_range"), _RANGE) - 1)
    got = rows.groupBy("source").agg(cut.alias("cut"), F.first("_start").alias("start"), F.first("_partial").alias("partial"))
    # Ties of the order key are drawn together.
    taken = rows.join(bounded_broadcast(got.select(F.col("source").alias("_t"), "cut"), rows=number), F.col("source").eqNullSafe(F.col("_t")))
    taken = taken.where("order_key <= cut").groupBy(F.col("source").alias("_t")).agg(F.sum("size").alias("words"))
    got = got.join(taken, F.col("source").eqNullSafe(F.col("_t")), "left")
    return got.select("source", "cut", (F.col("partial") - (F.col("start") + F.coalesce("words", F.lit(0)))).alias("gap"))


def _nearer(sized: DataFrame, plan: DataFrame, cuts: DataFrame, rounds: int, number: int) -> DataFrame:
    """(source, block, passes, whole, cut, flips): ``flips`` are single documents
    whose last copy is added (1) or dropped (-1)."""
    flip = "array<struct<order_key:bigint,size:bigint,sign:int>>"
    by = cuts.withColumn("flips", F.array().cast(flip))
    blocks = plan.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "passes", "whole", F.col("partial").isNotNull().alias("edge"), "source_size", "target")

    def state() -> DataFrame:
        mine = by.withColumnRenamed("source", "_t")
        return blocks.join(bounded_broadcast(mine, rows=number), F.col("_source").eqNullSafe(F.col("_t")), "left").drop("_t")

    for _ in range(rounds):
        rows = sized.join(bounded_broadcast(state(), rows=number), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
        last = (F.col("passes") > F.col("whole")) | (F.col("edge") & (F.col("order_key") <= F.col("cut")))
        sign = F.when((F.col("gap") > 0) & ~last, 1).when((F.col("gap") < 0) & last, -1)
        rows = rows.withColumn("sign", sign).withColumn("left", F.col("gap") - F.col("size") * F.col("sign"))
        known = F.exists("flips", lambda x: (x.order_key == F.col("order_key")) & (x.size == F.col("size")))
        better = rows.where((F.abs("left") < F.abs("gap")) & ~known)
        best = better.groupBy(F.col("source").alias("_b")).agg(F.min(F.struct(F.abs("left").alias("miss"), "order_key", "size", "sign", "left")).alias("x"))
        by = by.join(best, F.col("source").eqNullSafe(F.col("_b")), "left")
        found = F.array(F.struct("x.order_key", "x.size", "x.sign")).cast(flip)
        by = by.select("source", "cut", F.coalesce("x.left", "gap").alias("gap"), F.when(F.col("x").isNull(), F.col("flips")).otherwise(F.concat("flips", found)).alias("flips"))
        by = written(by, "mix-nearer")
    return state()


def mix_sources(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_epochs: int = 3, blocks: int = 256, levels: int = 4, seed: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """Draw documents so that each source reaches its word target.

    Adds to every document: ``size`` (words), ``source_size``, ``target``,
    ``copies`` (times it is drawn, at most ``max_epochs``), ``shards`` (the
    output shard of each copy, as the splitting tree dealt them) and
    ``order_key`` (local shuffle order).  ``drawn`` turns this into one row per
    copy.

    A null text has size 0; a null source is one source, last in order;
    sources of size 0 get target 0; repeated rows and ties in ``doc_id`` are
    drawn alike; an empty table stays empty.  Input columns named like an
    added one (or like ``passes``, ``whole``, ``edge``, ``cut``, ``gap`` and
    ``flips``) are replaced, names beginning with an underscore are reserved.
    No source is capped or sampled beyond its target.
    """
    added = ["size", "source_size", "target", "copies", "shards", "order_key", "passes", "whole", "edge", "cut", "gap", "flips"]
    kept = docs.drop(*added)
    names = kept.columns
    key = _code(F.lit(f"doc{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    keyed = kept.withColumn("order_key", key).withColumn("_in", (F.col("order_key") % blocks).cast("int"))
    # The narrow table of all sizes is made once; all plans read it.
    sized = written(keyed.select("source", F.col("_in").alias("block"), "order_key", size.alias("size")), "mix-sizes")
    plan = written(plan_blocks(sized, weights, share, max_epochs, blocks, seed), "mix-plan")
    number = plan.count()  # rows of all the plan's tables, at most
    lists = split_tree(plan, levels, seed).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b"))
    lists = lists.agg(F.expr("transform(array_sort(collect_list(struct(pass, shard))), x -> x.shard)").alias("_all"))
    cuts = written(_edge_cuts(sized, plan, number), "mix-cuts")
    full = _nearer(sized, plan, cuts, rounds, number)
    full = full.join(lists, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left").drop("_s", "_b")
    # What is added beyond the edge block comes to that block's last shard.
    edge = Window.partitionBy("_source")
    full = full.withColumn("_edge", F.max(F.when(F.col("edge"), F.element_at("_all", -1))).over(edge))
    full = written(full, "mix-draw")
    out = keyed.join(bounded_broadcast(full, rows=number), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_in") == F.col("_block")))
    out = out.withColumn("size", size)
    base = F.col("passes") + F.coalesce((F.col("edge") & (F.col("order_key") <= F.col("cut"))).cast("int"), F.lit(0))
    sign = F.expr("coalesce(get(filter(flips, x -> x.order_key = order_key AND x.size = size), 0).sign, 0)")
    out = out.withColumn("_base", base).withColumn("_sign", sign)
    none = F.array().cast("array<int>")
    shards = F.concat(
        F.when(F.col("_base") + F.least("_sign", F.lit(0)) > 0, F.slice("_all", F.lit(1), F.col("_base") + F.least("_sign", F.lit(0)))).otherwise(none),
        F.when(F.col("_sign") > 0, F.array("_edge")).otherwise(none),
    )
    return out.withColumn("shards", shards).select(*names, "size", "source_size", "target", F.size("shards").alias("copies"), "shards", "order_key")


def drawn(mixed: DataFrame, levels: int = 4) -> DataFrame:
    """One row per drawn copy, dealt to its shard and shuffled there."""
    rows = mixed.withColumn("shard", F.explode("shards")).drop("shards")
    return rows.repartition(1 << levels, "shard").sortWithinPartitions("shard", "order_key")
