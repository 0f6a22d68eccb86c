"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut to blocks. With weight e/D, its i-th block (from 0) has the release time floor(i D / e) and
the deadline ceil((i + 1) D / e); slots go to the released block with the earliest deadline. The schedule repeats every
D slots, so one period is folded by a SQL expression and every block finds its slot by arithmetic. Any first t slots
hold less than one block more or less than t e / D of each source.

The mix ends when each source was used up once; a source that ends sooner begins again, in a further epoch, so that no
row is left out and the weights hold throughout. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED = ("mix_slot", "mix_epoch", "mix_position")


def source_shares(sizes: DataFrame, resolution: int, power: float, weights: dict[str, float] | None) -> DataFrame:
    """(mix_key, rows, e): slots of each source in a period; they add up to `resolution`, each has one at least.

    There must be no more sources than `resolution`.
    Weights are given by source (a missing one counts as 0 and gets the one slot), or grow with rows ** power.
    """
    if weights is None:
        raw = F.pow(F.col("rows").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for name, weight in weights.items() for x in ("s" + name, float(weight))])
        raw = F.coalesce(given[F.col("mix_key")], F.lit(0.0)) if weights else F.lit(1.0)
    everything = Window.partitionBy()  # one row per source
    exact = F.col("raw") / F.sum("raw").over(everything) * resolution
    shares = sizes.withColumn("raw", raw).withColumn("exact", exact)
    shares = shares.withColumn("e", F.greatest(F.lit(1), F.floor("exact")).cast("long"))
    shares = shares.withColumn("left", F.lit(resolution) - F.sum("e").over(everything))
    shares = shares.withColumn("by_rest", F.row_number().over(
        Window.orderBy(F.desc(F.when(F.col("exact") >= 1, F.col("exact") - F.floor("exact")).otherwise(-1)), "mix_key")))
    # slots beyond the period are taken from sources with more than one, in proportion to what they have beyond it
    spare, beyond = F.col("e") - 1, -F.col("left") * (F.col("e") - 1)
    shares = shares.withColumn("spare", F.greatest(F.lit(1), F.sum(spare).over(everything))).withColumn(
        "taken", F.floor(beyond / F.col("spare"))).withColumn("part", F.pmod(beyond, F.col("spare")))
    shares = shares.withColumn("by_part", F.row_number().over(Window.orderBy(F.desc("part"), "mix_key")))
    odd = -F.col("left") - F.sum("taken").over(everything)
    count = F.count(F.lit(1)).over(everything)
    more = (F.when(F.col("left") >= 0, F.floor(F.col("left") / count) + (
        F.col("by_rest") <= F.pmod("left", count)).cast("long"))
        .otherwise(-F.col("taken") - (F.col("by_part") <= odd).cast("long")))
    return shares.select("mix_key", "rows", (F.col("e") + more).cast("long").alias("e"))


def one_period(shares: DataFrame, resolution: int) -> DataFrame:
    """(mix_key, e, turn, slot): the slot of each of a source's blocks in a period, by earliest deadline first.

    Sources of one e have the same release times and deadlines and take turns by name, so a step looks at each e once.
    """
    classes = shares.groupBy("e").agg(F.sort_array(F.collect_list("mix_key")).alias("keys")).agg(
        F.sort_array(F.collect_list(F.struct("e", "keys"))).alias("classes"))

    def pick(used: Column, at: Column) -> Column:
        def due(own: Column, i: Column) -> Column:
            m = F.size(own["keys"])
            n, key = F.floor(F.get(used, i) / m), F.get(own["keys"], F.pmod(F.get(used, i), m).cast("int"))
            deadline = F.ceil((n + 1) * resolution / own["e"])
            return F.when(F.floor(n * resolution / own["e"]) <= at,
                          F.struct(deadline.alias("d"), key.alias("key"), i.alias("i")))

        return F.array_min(F.transform("classes", due))["i"]

    def fill(state: Column, at: Column) -> Column:
        def with_one(chosen: Column) -> Column:
            return F.struct(F.transform(state["used"], lambda n, i: n + (i == chosen).cast("long")).alias("used"),
                            F.concat(state["picks"], F.array(chosen)).alias("picks"))

        return F.get(F.transform(F.array(pick(state["used"], at)), with_one), F.lit(0))  # the pick is found once

    start = F.struct(F.transform("classes", lambda x: F.lit(0).cast("long")).alias("used"),
                     F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(resolution - 1)), start, fill)["picks"]
    slots = classes.select("classes", picks.alias("picks")).select("classes", F.posexplode("picks").alias("slot", "i"))
    slots = slots.select(F.get("classes", F.col("i")).alias("own"), "slot").select("own.keys", "own.e", "slot")
    nth = slots.withColumn("nth", F.row_number().over(Window.partitionBy("e").orderBy("slot")) - 1)
    return nth.select(F.get("keys", F.pmod("nth", F.size("keys"))).alias("mix_key"), "e",
                      F.floor(F.col("nth") / F.size("keys")).alias("turn"), "slot")


def mix(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.85,
        block_rows: int = 64, resolution: int = 1000, bucket_rows: int = 2000, source_slots: int = 10) -> DataFrame:
    """All columns of `docs` with mix_slot, mix_epoch and mix_position; each row once for every epoch it is used in.

    `mix_position` orders the mix: slot times block_rows plus the row's place in its block. Within a source, rows are
    ordered by a hash of their columns; equal rows are told apart arbitrarily, which no column shows. A null source is
    a source of its own, as is the empty one. A period has `resolution` slots, or `source_slots` for each source where
    that is more: the one slot that every source has then distorts the weights by 1 / source_slots at most. Existing
    columns of the three names are refused; an empty table gives no rows.

    Ranks come from counts per source and hash bucket, so that a source of any size is ranked by many tasks.
    """
    if clash := set(ADDED) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    names = docs.columns
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))
    total, sources = docs.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    buckets = max(1, min(1 << 16, total // bucket_rows))
    resolution = max(resolution, source_slots * sources)
    keyed = docs.withColumn("mix_key", key).withColumn("mix_hash", F.xxhash64(*names)).withColumn(
        "mix_bucket", F.pmod(F.shiftrightunsigned("mix_hash", 20), F.lit(buckets)))
    counts = keyed.select("mix_key", "mix_bucket").groupBy("mix_key", "mix_bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("mix_key").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_key", "mix_bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))

    shares = source_shares(counts.groupBy("mix_key").agg(F.sum("rows").alias("rows")), resolution, power, weights)
    slots = one_period(shares, resolution)
    # the mix ends with the last slot that holds a block of some source's first epoch
    blocks = F.ceil(F.col("rows") / block_rows)
    sized = shares.select("mix_key", "e", blocks.alias("blocks"), F.pmod(blocks - 1, F.col("e")).alias("turn"))
    first_ends = F.floor((F.col("blocks") - 1) / F.col("e")) * resolution + F.col("slot") + 1
    facts = sized.join(slots.select("mix_key", "turn", "slot"), ["mix_key", "turn"]).select(
        "mix_key", "e", "blocks", F.max(first_ends).over(Window.partitionBy()).alias("horizon"))

    place = F.row_number().over(Window.partitionBy("mix_key", "mix_bucket").orderBy("mix_hash")) - 1
    ranked = keyed.withColumn("place", place).join(offsets, ["mix_key", "mix_bucket"])
    ranked = ranked.withColumn("rank", F.col("place") + F.col("offset")).join(facts, "mix_key")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows))
    last = F.floor((F.col("horizon") * F.col("e") / resolution + 1) / F.col("blocks"))
    used = ranked.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
        "nth", F.col("block") + F.col("mix_epoch") * F.col("blocks"))
    used = used.withColumn("turn", F.pmod("nth", F.col("e"))).withColumn("period", F.floor(F.col("nth") / F.col("e")))
    placed = used.join(slots.select("mix_key", "turn", "slot"), ["mix_key", "turn"]).withColumn(
        "mix_slot", F.col("period") * resolution + F.col("slot")).where(F.col("mix_slot") < F.col("horizon"))
    position = F.col("mix_slot") * block_rows + F.pmod("rank", F.lit(block_rows))
    return placed.select(*names, "mix_slot", F.col("mix_epoch").cast("int"), position.alias("mix_position"))
