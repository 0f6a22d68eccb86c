"""Interpolated modified Kneser-Ney model over character n-grams, and a quality filter by its perplexity.

The n-grams of all trusted texts are counted in tasks and summed by key. An n-gram is one long of 12 bits for each
character (code points modulo 4096), so suffixes and contexts are shifts, and the lower orders' continuation counts,
the three discounts of each order and the interpolated probabilities are joins and groupings of count tables.

For scoring, a probability table of a few shards is cut by the two characters before the last one; what the two lowest
orders hold is in every shard. A shard is broadcast and every text meets it in place: the positions whose context falls
into the shard add to the text's sums, and no text is shuffled. A larger table stays where it is: the distinct n-grams
of the texts are joined with it by key, and the costs go back to the blocks of texts that hold those n-grams. So neither
the driver nor a task ever holds more than a few shards, and the model may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import cut, join_small, labelled_side, send, stored

ORDER, BITS = 5, 12
ONE = (1 << BITS) - 1


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ending at each character, number of characters of each text); texts begin with null characters."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    pad = np.zeros(ORDER - 1, "<u4")
    symbols = (np.concatenate([part for r in raw for part in (pad, r)] or [pad]) & ONE).astype(np.int64)
    grams = np.zeros(len(symbols), np.int64)
    for i in range(ORDER):
        grams[i:] |= symbols[: len(symbols) - i] << (BITS * i)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    keep = np.ones(len(symbols), dtype=bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    for i in range(ORDER - 1):
        keep[starts + i] = False
    return (grams[keep] if len(texts) else grams[:0]), sizes


def counted(texts: DataFrame, text: str = "text", held: int = 1 << 20) -> DataFrame:
    """(key, n) of the highest order over all texts; a task holds about `held` keys before it passes them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new, times = np.unique(windows([t or "" for t in batch.column(0).to_pylist()])[0], return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times]), len(keys)).astype(np.int64)
            if len(keys) > held:
                yield rows(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield rows(keys, counts)

    return texts.select(text).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def tail(key: str | Column, n: int) -> Column:
    """The last n characters of an n-gram."""
    key = F.col(key) if isinstance(key, str) else key
    return key.bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def discounts(table: DataFrame) -> list[float]:
    """Of n-grams counted once, twice, and more often, from the counts of counts."""
    sizes = {r["n"]: r["count"] for r in table.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (float(sizes.get(i, 0)) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(value, 0.05), i + 0.95) for i, value in enumerate(raw)]


def model(counts: DataFrame) -> DataFrame:
    """(order, kind, key, value): kind 0 has the probability of an n-gram, kind 1 what a context leaves to lower orders."""
    tables = {ORDER: cut(counts)}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = cut(tables[n + 1].groupBy(tail("key", n).alias("key")).agg(F.count("*").alias("n")))
    symbols = tables[1].count() + 1
    parts, lower = [], None
    for n in range(1, ORDER + 1):
        d = discounts(tables[n])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        grams = tables[n].withColumn("off", off).withColumn("context", F.shiftright("key", BITS))
        left = grams.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("rest"))
        if n == 1:
            known = grams.join(left, "context").withColumn("below", F.lit(1.0 / symbols))
        else:
            known = grams.join(left, "context").withColumn("suffix", tail("key", n - 1)).join(
                lower.select(F.col("key").alias("suffix"), F.col("value").alias("below")), "suffix")
        lower = cut(known.select("key", ((F.col("n") - F.col("off")) / F.col("total") + F.col("rest") * F.col("below"))
                                 .alias("value")))
        parts.append(lower.select(F.lit(n).alias("order"), F.lit(0).alias("kind"), "key", "value"))
        parts.append(left.select(F.lit(n).alias("order"), F.lit(1).alias("kind"), F.col("context").alias("key"),
                                 F.col("rest").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # one probability for characters never seen
    spark = counts.sparkSession
    return out.unionByName(spark.range(1).select(F.lit(0).alias("order"), F.lit(0).alias("kind"),
                                                 F.lit(0).cast("long").alias("key"), F.lit(1.0 / symbols).alias("value")))


def spread(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs * 0x9E3779B1) >> 15) % shards


class Shard:
    """Sorted tables of one shard."""

    def __init__(self, rows: pa.Table, shard: int, shards: int):
        order, kind = rows.column("order").to_numpy(), rows.column("kind").to_numpy()
        key, value = rows.column("key").to_numpy(), rows.column("value").to_numpy()
        self.shard, self.shards, self.tables = shard, shards, {}
        for n in range(ORDER + 1):
            for k in (0, 1):
                own = np.flatnonzero((order == n) & (kind == k))
                own = own[np.argsort(key[own])]
                self.tables[n, k] = (key[own], value[own])

    def find(self, n: int, kind: int, keys: np.ndarray, default: float) -> np.ndarray:
        have, value = self.tables[n, kind]
        if not len(have):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, value[at], default)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Negative log probability of each n-gram's last character; 0 for those of other shards."""
        p = np.full(len(grams), self.tables[0, 0][1][0])
        for n in range(1, ORDER + 1):
            keys = grams & ((1 << (BITS * n)) - 1)
            seen = self.find(n, 0, keys, -1.0)
            p = np.where(seen > 0, seen, self.find(n, 1, keys >> BITS, 1.0) * p)
        out = -np.log(p)
        if self.shards > 1:
            out[spread((grams >> BITS) & ((1 << (2 * BITS)) - 1), self.shards) != self.shard] = 0.0
        return out

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, sizes = windows(texts)
        distinct, place = np.unique(grams, return_inverse=True)
        sums = np.append(0.0, np.cumsum(self.cost(distinct)[place]))
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes], sizes


def sharded(table: DataFrame, shard_rows: int) -> Iterator[Shard]:
    """The model's shards, read one after the other; each holds about `shard_rows` rows."""
    shards = max(1, -(-table.count() // shard_rows))
    pair = tail(F.when(F.col("kind") == 0, F.shiftright("key", BITS)).otherwise(F.col("key")), 2)
    own = F.when(F.col("order") > 2, F.shiftright(pair * 0x9E3779B1, 15) % shards)
    for s in range(shards):
        yield Shard(table.where(own.isNull() | (own == s)).select("order", "kind", "key", "value").toArrow(), s, shards)


def sent(table: DataFrame, shard_rows: int) -> list[Broadcast]:
    """The shards as broadcasts; the driver holds one shard at a time."""
    return [send(table.sparkSession, shard) for shard in sharded(table, shard_rows)]


def with_costs(docs: DataFrame, shards: list[Broadcast], text: str = "text") -> DataFrame:
    """`docs` with lm_cost (sum of negative log probabilities) and lm_chars; a null text counts as empty."""
    out = docs.withColumn("lm_cost", F.lit(0.0)).withColumn("lm_chars", F.lit(0).cast("long"))
    position, names, schema = docs.columns.index(text), out.columns, out.schema
    for shard in shards:
        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cost, sizes = shard.value.costs([t or "" for t in batch.column(position).to_pylist()])
                before = batch.column(batch.num_columns - 2).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    batch.columns[:-2] + [pa.array(before + cost), pa.array(sizes)], names=names)

        out = out.mapInArrow(run, schema)
    return out


def joined_costs(grams: DataFrame, table: DataFrame) -> DataFrame:
    """(key, cost) of distinct n-grams: the negative log probability of each one's last character."""
    unseen = table.where("order = 0").first()["value"]
    out = grams.select("key").withColumn("p", F.lit(unseen))
    for n in range(1, ORDER + 1):
        for kind, name in ((0, "seen"), (1, "rest")):
            own = table.where((F.col("order") == n) & (F.col("kind") == kind)).select(
                F.col("key").alias("at"), F.col("value").alias(name))
            at = tail("key", n) if kind == 0 else F.shiftright(tail("key", n), BITS)
            out = join_small(out.withColumn("at", at), own, "at", "left").drop("at")
        out = out.select("key", F.coalesce("seen", F.coalesce("rest", F.lit(1.0)) * F.col("p")).alias("p"))
    return out.select("key", (-F.log("p")).alias("cost"))


def with_joined_costs(docs: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """As `with_costs`, for a model of any size; a task holds one block of texts and the costs of its n-grams."""
    wide = docs.withColumn("lm_block", F.lit(0).cast("long"))
    position, names = docs.columns.index(text), wide.columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for i, batch in enumerate(batches):
            block = pa.array(np.full(batch.num_rows, first + i, np.int64))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [block], names=names)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(1).to_numpy()
            for block in np.unique(blocks):
                own = batch.column(0).filter(pa.array(blocks == block)).to_pylist()
                keys = np.unique(windows([t or "" for t in own])[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], names=["lm_block", "key"])

    # the blocks are written: their numbers must not change between the two reads
    blocked = stored(wide.mapInArrow(numbered, wide.schema), "blocks")
    grams = cut(blocked.select(text, "lm_block").mapInArrow(distinct, "lm_block long, key long").distinct())
    costs = cut(joined_costs(grams.select("key").distinct(), table))
    schema = docs.withColumn("lm_cost", F.lit(0.0)).withColumn("lm_chars", F.lit(0).cast("long")).schema

    def summed(texts: pa.Table, known: pa.Table) -> pa.Table:
        values = [t or "" for t in texts.column(text).to_pylist()]
        found, sizes = windows(values)
        keys, cost = known.column("key").to_numpy(), known.column("cost").to_numpy()
        order = np.argsort(keys)
        each = cost[order][np.searchsorted(keys[order], found)] if len(found) else np.empty(0)
        sums, ends = np.append(0.0, np.cumsum(each)), np.cumsum(sizes)
        out = texts.drop_columns(["lm_block"])
        return out.append_column("lm_cost", pa.array(sums[ends] - sums[ends - sizes])).append_column("lm_chars", pa.array(sizes))

    return blocked.groupBy("lm_block").cogroup(grams.join(costs, "key").groupBy("lm_block")).applyInArrow(summed, schema)


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, prior_chars: int = 100, least: int = 50,
            shard_rows: int = 3_000_000, most_shards: int = 4) -> DataFrame:
    """All columns of `docs` with lm_perplexity, lm_limit and lm_keep.

    Trusted texts have label quality = 1. Two thirds of them, by their ids, train the model; a language's limit is the
    `quantile` of the perplexities of the others. Perplexities are per character, after `prior_chars` characters of
    average cost, so that very short texts are not judged by a few letters. Languages with fewer than `least` such
    texts, and null ones, take the limit of all languages together. Without trusted texts everything is kept. Null
    texts count as empty, have the average perplexity and are kept. Rows keep their number and columns, and their order
    while the model has at most `most_shards` shards, which are broadcast; a larger one is joined. Columns beginning with
    lm_ are refused. Labels that repeat an id count if any of them is 1.
    """
    if clash := {"lm_cost", "lm_chars", "lm_perplexity", "lm_limit", "lm_keep", "lm_block"} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    texts = docs.select("doc_id", "lang", "text")
    counts = counted(join_small(texts, trusted.where(labelled_side()), "doc_id", "left_semi"))
    table = cut(model(counts))
    entries = table.count()
    if entries <= 1:
        return docs.withColumn("lm_perplexity", F.lit(None).cast("double")).withColumn(
            "lm_limit", F.lit(None).cast("double")).withColumn("lm_keep", F.lit(True))
    if entries <= most_shards * shard_rows:
        shards = sent(table, shard_rows)

        def priced(rows: DataFrame) -> DataFrame:
            return with_costs(rows, shards)
    else:
        def priced(rows: DataFrame) -> DataFrame:
            return with_joined_costs(rows, table)
    held = priced(join_small(texts, trusted.where(~labelled_side()), "doc_id", "left_semi"))
    held = cut(held.select("lang", "lm_cost", "lm_chars"))
    mean = held.agg(F.sum("lm_cost") / F.sum("lm_chars")).first()[0]
    if mean is None:  # no text is left to set limits by
        mean, limits, overall = 0.0, None, None
    else:
        rate = (F.col("lm_cost") + prior_chars * mean) / (F.col("lm_chars") + prior_chars)
        overall = held.agg(F.percentile_approx(rate, quantile, 100_000)).first()[0]
        limits = held.where("lang IS NOT NULL").groupBy("lang").agg(
            F.count("*").alias("n"), F.percentile_approx(rate, quantile, 100_000).alias("limit_")).where(F.col("n") >= least)
    scored = priced(docs)
    rate = (F.col("lm_cost") + prior_chars * mean) / (F.col("lm_chars") + prior_chars)
    if limits is None:
        scored = scored.withColumn("limit_", F.lit(None).cast("double"))
    else:
        scored = join_small(scored, cut(limits.select("lang", "limit_")), "lang", "left")
    limit = F.coalesce("limit_", F.lit(overall).cast("double"))
    return scored.select(*docs.columns, F.exp(rate).alias("lm_perplexity"), F.exp(limit).alias("lm_limit"),
                         F.coalesce(rate <= limit, F.lit(True)).alias("lm_keep"))
