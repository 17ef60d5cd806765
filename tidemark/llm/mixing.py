"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions alone.

1. The documents of a source are put in the order of a seeded hash of id and text and cut into blocks of equal hash
   range; the words before each document follow from block totals and a window inside its block. No window spans a
   source. Words are counted once; what follows reads the counts.
2. A source's target is its share of all words by weight, at most max_repeat times its size; what is over goes to the
   others by weight. The mix takes a source's documents in hash order, again from the start after each pass, and stops
   at the target: the last document's copy is cut there, so that a source is exact to a word.
3. A source's quota is the number of block draws that this takes. A binary tree deals the quotas to shards: at each
   node the left half draws half of the node's blocks without replacement, so its counts by source are multivariate
   hypergeometric (drawn source by source, by inverting the distribution function at a seeded uniform).
4. The draws of a source are numbered in a permuted order, and each shard takes the range that its quotas give it.
   Inside a shard rows are ordered by a seeded hash. What the mix takes of a document is what the shards drew of it.

The tree handles one row per node with a count for each source, and blocks_per_source bounds the counts; documents meet
it through an equi-join. It suits up to thousands of sources; group smaller ones before.

Defined cases: null text is empty (size 0, taken 0); the null source is a source, the last; null ids are kept; rows
that are equal in id and text follow one another in hash order; an empty table gives no rows; all sizes 0 give targets of
0; other columns pass through untouched, whatever their names, but mix()'s own three replace those named like them; with
places=False it adds none and all pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions_for, stored


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """source, source_size, target: one row per source of `sizes` (source, size). Weights repeat along the sources."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    # The level: sources fill up in order of cap / weight. With the first k full, the level of the rest is
    # (total - their caps) / their weights. That rises with k while the next source has to be full, and falls after.
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_first())
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("level_here", (F.col("total") - F.coalesce(F.sum(cap).over(full), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.max("level_here").over(everything))
    return per.select("source", "source_size", F.least(cap, F.col("level") * F.col("weight")).alias("target"))


def _log_choose(n: Column, k: Column) -> Column:
    """log C(n, k): factorials up to 15 from a list, larger ones by Stirling's series (error under 1e-9)."""
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))

    def log_factorial(x: Column) -> Column:
        z = x.cast("double") + 1
        r = 1 / (z * z)
        series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / z
        return F.when(x < 16, F.get(small, x.cast("int"))).otherwise(series)

    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` draws without replacement from `total` things are among the `marked`: the inverse of the
    distribution function at u, summed from 15 standard deviations below the mean to 15 above (the rest weighs
    less than 1e-40)."""
    mean = draws * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (1 - marked / F.greatest(total, F.lit(1))) + 1) * 15 + 2
    low = F.greatest(F.lit(0), draws + marked - total, F.floor(mean - spread)).cast("long")
    high = F.greatest(low, F.least(marked, draws, F.ceil(mean + spread))).cast("long")
    base = _log_choose(total, draws)

    def step(state: Column, x: Column) -> Column:
        p = F.exp(_log_choose(marked, x) + _log_choose(total - marked, draws - x) - base)
        done = state["sum"] >= u
        return F.struct(F.when(done, state["sum"]).otherwise(state["sum"] + p).alias("sum"), F.when(done, state["x"]).otherwise(x).alias("x"))

    return F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("sum"), low.alias("x")), step, lambda s: s["x"])


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) from the hash of columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """shard, source, first, quota: the splitting tree over `quotas` (source, quota). 2 ** levels shards; `first` is
    the number of the source's draws in earlier shards. The nodes are rows that hold one count for each source."""
    items = F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), F.col("source").alias("source"), F.col("quota"))))
    nodes = quotas.groupBy().agg(items.alias("items")).select(F.lit(0).cast("long").alias("node"), F.col("items")["source"].alias("sources"), F.col("items")["quota"].alias("counts"))
    for level in range(levels):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
        start = F.struct(total.alias("total"), F.floor((total + 1) / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("left"))

        def draw(state: Column, k: Column) -> Column:
            u = uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(state["left"]))
            x = hypergeometric(state["total"], k, state["draws"], u)
            return F.struct((state["total"] - k).alias("total"), (state["draws"] - x).alias("draws"), F.concat(state["left"], F.array(x)).alias("left"))

        left = F.aggregate("counts", start, draw, lambda s: s["left"])
        halves = nodes.withColumn("left", left).withColumn("right", F.zip_with("counts", "left", lambda a, b: a - b))
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("counts"))))
        nodes = halves.select("sources", child.alias("c")).select("c.node", "sources", "c.counts")
        if level == 3 and levels > 6:  # the lower levels in several tasks
            nodes = nodes.repartition(16, "node")
    flat = nodes.select(F.col("node").alias("shard"), F.posexplode("counts").alias("i", "quota"), "sources").select("shard", F.get("sources", F.col("i")).alias("source"), "quota")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)).cast("long"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, blocks_per_source: int | None = None, shard_levels: int | None = None, seed: int = 7, keep_columns: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and draws, an array of (copy, words,
    shard, place) for each copy the mix takes; words below size mark the copy that is cut. blocks_per_source: by
    default 16 for each of the session's shuffle partitions, 1024 at least, so that a block's documents fit a task; what
    is taken doesn't depend on it. shard_levels: 2 to this power is the number of shards; by default at least the
    session's shuffle partitions. keep_columns: the input row comes along as the struct `row`."""
    if blocks_per_source is None:
        blocks_per_source = max(1024, 16 * partitions_for(docs.sparkSession))
    if shard_levels is None:
        shard_levels = max(1, math.ceil(math.log2(partitions_for(docs.sparkSession))))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_columns else []
    text = F.col(f"`{text_col}`")
    ident = F.concat_ws(":", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string"), F.md5(text.cast("binary")))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words_of(text).alias("size"), F.md5(ident.cast("binary")).alias("h"), *row)
    counted = stored(base.drop("row"), "sizes")
    if not keep_columns:
        base = counted
    # Blocks: equal ranges of the hash's first 24 bits.
    block = F.shiftright(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * blocks_per_source, 24).cast("int")
    totals = stored(counted.groupBy("source", block.alias("block")).agg(F.sum("size").cast("long").alias("words")), "block-sizes")
    targets = source_targets(totals.select("source", F.col("words").alias("size")), weights, max_repeat)
    so_far = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.withColumn("block_start", F.coalesce(F.sum("words").over(so_far), F.lit(0)).cast("long"))
    # Passes over the whole source, and words of the last, partial pass.
    ends = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
    ends = ends.withColumn("part", (F.round("target").cast("long") - F.col("passes") * F.col("source_size")))
    blocks = blocks.join(ends, blocks["source"].eqNullSafe(ends["source"])).select(blocks["source"], "block", "block_start", "source_size", "target", "passes", "part")
    blocks = blocks.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("block")) - 1)
    blocks = blocks.withColumn("copies", F.col("passes") + (F.col("block_start") < F.col("part")).cast("long"))
    count = Window.partitionBy("source")
    # At most blocks_per_source rows a source, and one row per source and shard: both small, and written, so that no plan holds them twice.
    blocks = stored(blocks.withColumn("n", F.count("*").over(count)).withColumn("quota", F.sum("copies").over(count).cast("long")), "blocks")
    shards = stored(split_quotas(blocks.groupBy("source").agg(F.first("quota").alias("quota")), shard_levels, seed), "quotas")
    # Draw number of (block, copy), permuted by a step that shares no factor with the quota (a prime far above it).
    drawn = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1)))
    number = F.col("copy") * F.col("n") + F.col("rank")
    drawn = drawn.withColumn("draw", F.when(F.col("copies") > 0, (number * F.lit((1 << 31) - 1) + F.lit(seed)) % F.col("quota")))
    dealt = drawn.join(shards, drawn["source"].eqNullSafe(shards["source"]) & (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + shards["quota"]), "left")
    plan = dealt.groupBy(drawn["source"], "block", "block_start", "source_size", "target", "passes", "part").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("at"))
    plan = plan.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("block", block).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (F.col("block") == F.col("b")))
    begin = F.col("block_start") + F.col("inside")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - begin)).cast("long")
    copies = F.transform("at", lambda a: F.struct(a["copy"].cast("int").alias("copy"), F.when(a["copy"] < F.col("passes"), F.col("size")).otherwise(cut).alias("words"), a["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.col("h"), a["copy"]).alias("place")))
    draws = F.filter(copies, lambda c: (c["words"] > 0) & c["shard"].isNotNull())
    rows = rows.withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *(["row"] if keep_columns else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, places: bool = True, **how) -> DataFrame:
    """The mixed documents: each copy is a row with docs' columns (the cut copy's text ends after its last word) and, with
    places, mix_copy, mix_shard, mix_place. Partitioned by shard, in the shard's shuffled order."""
    own = {"mix_copy": "copy", "mix_shard": "shard", "mix_place": "place"} if places else {}
    keep = [c for c in docs.columns if c.lower() not in own]
    # The draw travels under a name that no column has.
    draw = "mix_draw" + "_" * max(map(len, docs.columns))
    plan = plan_mix(docs, id_col, text_col, source_col, keep_columns=True, **how)
    rows = plan.withColumn("d", F.explode("draws"))
    # The text splits behind each word; the first k parts are k words with the white space before them.
    parts = F.split(F.col(f"row.`{text_col}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(parts, 1, F.col("d.words").cast("int")), "")
    text = F.when(F.col("d.words") < F.col("size"), head).otherwise(F.col(f"row.`{text_col}`"))
    out = rows.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in keep), F.col("d").alias(draw))
    out = out.repartition(F.col(f"{draw}.shard")).sortWithinPartitions(f"{draw}.shard", f"{draw}.place")
    return out.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"{draw}.{part}").alias(c) for c, part in own.items()))
