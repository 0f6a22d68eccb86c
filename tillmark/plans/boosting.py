"""Gradient boosting of regression trees with second-order gains and L1, L2 and split penalties.

Features are cut once into bins at sketched quantiles. The rows stay where they are, binned, with their margin; per level
of a tree every task adds up gradients and weights by node, feature and bin, Spark sums these histograms, and the driver
picks the splits from them. What reaches the driver is bounded by nodes x features x bins, whatever the number of rows.
Several targets are grown side by side: a level of all their trees is one pass.

Such a pass takes some tenths of a second even over few rows, and there is one per level and tree. Up to `WHOLE` cells a
task adds up all rows in less time than that, so there the binned rows of a target meet in one task, which grows all its trees
by the same rules; targets are grown in parallel.

Losses are squared errors: the gradient is margin - target, the second derivative 1. With the loss "logistic", of labels 0
and 1, the rules are those of MLlib's GBTClassifier: residuals of the loss 2 log(1 + exp(-2 y margin)) for y = -1 or 1 take the
place of the gradients, and the first tree, which is fitted to y, counts whole. A split's gain is
(T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2)) / 2 - gamma with T(G) = sign(G) max(|G| - l1, 0), and a
leaf is -eta T(G) / (H + l2).
"""

from __future__ import annotations

import hashlib
import random
import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from math import ceil, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.operators import evaluation as E
from tillmark.operators.ranking import positions
from tillmark.plans import forest as RF
from tillmark.plans.models import materialize

WHOLE = 1 << 24  # rows x features up to which one task grows a target's trees


@dataclass(frozen=True)
class Settings:
    """How one target's trees grow; a split needs `child_weight` rows on both sides.

    The features that may split are drawn for each tree, or for each node. Targets of the same `draw` draw the same rows and
    features; by default each target draws its own.
    """

    rounds: int = 100
    depth: int = 6
    eta: float = 0.3
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    child_weight: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    by_node: bool = False
    loss: str = "squared"
    draw: int | None = None


# Tuned parameters of the reported market models, by target.
TUNED = {
    "target_return_1d": Settings(rounds=400, depth=5, eta=0.08, l1=0.5, l2=0.5, gamma=0.0, row_share=1.0, column_share=0.8),
    "target_return_5d": Settings(rounds=649, depth=9, eta=0.04384185860108758, l1=0.41184091414726853, l2=0.3488682665429953,
                                 gamma=0.013554497071648353, row_share=0.9647645721239129, column_share=0.5694123867210101),
    "target_return_20d": Settings(rounds=649, depth=9, eta=0.04384185860108758, l1=0.41184091414726853, l2=0.3488682665429953,
                                  gamma=0.013554497071648353, row_share=0.9647645721239129, column_share=0.5694123867210101),
}


def tuned() -> dict[str, Settings]:
    """The tuned settings with all their rounds."""
    return dict(TUNED)


@dataclass
class Tree:
    """Nodes in arrays: the children of node i are 2i+1 and 2i+2; a feature below zero marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n))

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row of bins (rows x features) stands at after `levels` steps."""
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(levels):
            feature = self.feature[at]
            inner = feature >= 0
            right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def predict(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.value[self.node(bins, depth)]


@dataclass
class Packed:
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


@dataclass
class Booster:
    """Trees of one target over binned features."""

    features: list[str]
    cuts: list[np.ndarray]
    settings: Settings
    base: float
    trees: list[Tree] = field(default_factory=list)

    def predict_bins(self, bins: np.ndarray, packed: Packed | None = None) -> np.ndarray:
        """Margins of rows of bins (rows x features)."""
        packed, out = packed or self.packed(), np.full(len(bins), self.base)
        own, rows = np.ascontiguousarray(bins.T).ravel(), np.arange(len(bins))
        start = packed.feature.astype(np.intp) * len(bins)
        for t in range(len(start)):
            at = np.zeros(len(bins), np.intp)
            for _ in range(self.settings.depth):
                at = 2 * at + 1 + (own[start[t][at] + rows] > packed.bin[t][at])
            out += packed.value[t][at]
        return out

    def packed(self) -> Packed:
        """The trees as (tree, node) arrays without leaves above the last level: below a leaf all ways go to the left."""
        n, inner = 2 ** (self.settings.depth + 1) - 1, 2 ** self.settings.depth - 1
        out = Packed(np.zeros((len(self.trees), inner), np.int16), np.full((len(self.trees), inner), np.iinfo(np.int16).max, np.int16),
                     np.zeros((len(self.trees), n)))
        for t, tree in enumerate(self.trees):
            value, split = tree.value.copy(), tree.feature[:inner] >= 0
            out.feature[t][split], out.bin[t][split] = tree.feature[:inner][split], tree.bin[:inner][split]
            for level in range(self.settings.depth):
                leaf = 2 ** level - 1 + np.flatnonzero(~split[2 ** level - 1:2 ** (level + 1) - 1])
                value[2 * leaf + 1] = value[leaf]
            out.value[t] = value
        return out

    def importance(self) -> list[tuple[str, float]]:
        """Share of each feature in the gains of all splits."""
        sums = np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(sums, tree.feature[inner], tree.gain[inner])
        return list(zip(self.features, (sums / max(sums.sum(), 1e-300)).tolist(), strict=True))


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def quality(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return shrunk(g, s.l1) ** 2 / (h + s.l2)


def chance(*parts: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest()))


def draw_of(s: Settings, target: int) -> int:
    return target if s.draw is None else s.draw


def columns_of(n: int, s: Settings, seed: int, tree: int) -> np.ndarray:
    """The features one tree may split by."""
    size = n if s.by_node else max(1, round(s.column_share * n))
    return np.sort(chance(seed, tree).permutation(n)[:size])


def closed_to(n: int, s: Settings, seed: int, tree: int, level: int) -> np.ndarray | None:
    """(nodes of the level, features): the features a node may not split by, where they are drawn for each node."""
    size = ceil(s.column_share * n)
    if not s.by_node or size >= n:
        return None
    return chance(seed, tree, level).random((2 ** level, n)).argsort(axis=1).argsort(axis=1) >= size


def gradients(margin: np.ndarray, truth: np.ndarray, number: int, s: Settings) -> np.ndarray:
    """What tree `number` is fitted to, with the sign turned."""
    if s.loss == "squared":
        return margin - truth
    y = 2 * truth - 1
    return -4 * y / (1 + np.exp(np.minimum(2 * y * margin, 700))) if number else -y


def binned_columns(features: Sequence[str], cuts: list[np.ndarray]) -> Column:
    """Number of cuts below each value; cuts are few and become a literal."""
    def below(f: str, own: np.ndarray):
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in own]), lambda cut: cut < F.col(f).cast("double")))

    return F.array(*[below(f, own) if len(own) else F.lit(0) for f, own in zip(features, cuts, strict=True)]).cast("array<int>")


def cut_points(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Distinct sketched quantiles of each feature; fewer than `bins` where it has few values. Nulls have a bin of their own."""
    inner = [i / bins for i in range(1, bins)]
    found = df.approxQuantile(list(features), inner, 0.1 / bins)
    ends = df.agg(*[c for i, f in enumerate(features) for c in (
        F.max(F.col(f).cast("double")).alias(f"top{i}"), F.count_if(F.col(f).isNull()).alias(f"nulls{i}"))]).first()
    out = []
    for i, own in enumerate(found):
        cuts = {c for c in own if ends[f"top{i}"] is not None and c < ends[f"top{i}"]}
        out.append(np.array(sorted(cuts | ({float("-inf")} if ends[f"nulls{i}"] else set())), dtype=float))
    return out


def row_draw(keys: np.ndarray, target: int, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each row, tree and target."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((target * 1_000_003 + tree * 7919 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def digits(batch: pa.RecordBatch, first: int, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins (rows x features) of a batch's columns from `first` on: the number of cuts below each value."""
    return np.stack([np.searchsorted(c, batch.column(first + j).to_numpy(zero_copy_only=False)) for j, c in enumerate(cuts)], axis=1)


def unpack(batch: pa.RecordBatch, n_features: int, n_targets: int):
    bins = batch.column("bins").flatten().to_numpy().reshape(-1, n_features)
    truth = batch.column("truth").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_targets)
    margin = batch.column("margin").flatten().to_numpy().reshape(-1, n_targets)
    return batch.column("row_key").to_numpy(), bins, truth, margin


def histograms(rows: DataFrame, boosters: list[Booster], pending: list[int], growing: dict[int, tuple[Tree, int]], level: int,
               n_bins: int) -> dict[int, np.ndarray]:
    """Per target: (nodes of the level, features, bins, 2) of gradient and weight sums.

    `pending` says how many of a booster's last trees the stored margins lack; `growing` has each target's tree and its
    number. Rows without the target, or not drawn for the tree, do not count.
    """
    n_features, n_targets, width = len(boosters[0].features), len(boosters), 2 ** level
    lacking = {t: boosters[t].trees[len(boosters[t].trees) - pending[t]:] for t in growing}
    shape = {t: boosters[t].settings for t in growing}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((2, width * n_features * n_bins)) for t in growing}
        for batch in batches:
            if not batch.num_rows:
                continue
            key, bins, truth, margin = unpack(batch, n_features, n_targets)
            for t, (tree, number) in growing.items():
                own = shape[t]
                guess = margin[:, t].copy()
                for last in lacking[t]:
                    guess += last.predict(bins, own.depth)
                used = ~np.isnan(truth[:, t])
                if own.row_share < 1:
                    used &= row_draw(key, draw_of(own, t), number) < own.row_share
                node = tree.node(bins, level) - (width - 1)
                used &= node >= 0
                g = gradients(guess, truth[:, t], number, own)[used]
                flat = (node[used, None] * n_features + np.arange(n_features)) * n_bins + bins[used]
                size = width * n_features * n_bins
                sums[t][0] += np.bincount(flat.ravel(), np.repeat(g, n_features), size)
                sums[t][1] += np.bincount(flat.ravel(), minlength=size)
        for t, both in sums.items():
            at = np.flatnonzero(both[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), t, np.int32)), pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])],
                names=["target", "cell", "g", "h"])

    parts = rows.mapInArrow(run, "target int, cell long, g double, h double")
    table = parts.groupBy("target", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = {t: np.zeros((2, width * n_features * n_bins)) for t in growing}
    target, cell = table.column("target").to_numpy(), table.column("cell").to_numpy()
    for t, both in out.items():
        own = target == t
        both[0][cell[own]] = table.column("g").to_numpy()[own]
        both[1][cell[own]] = table.column("h").to_numpy()[own]
    return {t: np.moveaxis(both.reshape(2, width, n_features, n_bins), 0, -1) for t, both in out.items()}


def split_level(tree: Tree, sums: np.ndarray, level: int, columns: np.ndarray, s: Settings, number: int = 0,
                closed: np.ndarray | None = None) -> bool:
    """Set the level's leaves and, above the last level, its best splits; says whether any node was split.

    Equal gains go to the first feature and the lowest bin.
    """
    first, width = 2 ** level - 1, 2 ** level
    nodes = first + np.arange(width)
    total = sums[:, columns[0]].sum(axis=1)
    g, h = total[:, 0], total[:, 1]
    alive = h > 0
    if level:
        alive &= tree.feature[(nodes - 1) // 2] >= 0
    eta = 1.0 if s.loss != "squared" and not number else s.eta
    tree.value[nodes[alive]] = -eta * shrunk(g[alive], s.l1) / (h[alive] + s.l2)
    if level == s.depth or not alive.any():
        return False
    at = np.flatnonzero(alive)
    left = np.cumsum(sums[at][:, columns], axis=2)[:, :, :-1]
    if not left.shape[2]:
        return False
    gl, hl = left[..., 0], left[..., 1]
    g, h = g[at][:, None, None], h[at][:, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (quality(gl, hl, s) + quality(g - gl, h - hl, s) - quality(g, h, s)) / 2 - s.gamma
    gain[(hl < s.child_weight) | (h - hl < s.child_weight)] = -np.inf
    if closed is not None:
        gain[closed[at][:, columns]] = -np.inf
    gain = gain.astype(np.float32).reshape(len(at), -1)  # sums of floating numbers come in any order
    best = gain.argmax(axis=1)
    most = gain[np.arange(len(at)), best]
    split = most > 0
    feature, cut = np.divmod(best[split], left.shape[2])
    own = nodes[at[split]]
    tree.feature[own], tree.bin[own], tree.gain[own] = columns[feature], cut, most[split]
    return bool(split.any())


def fit(df: DataFrame, features: Sequence[str], targets: dict[str, Settings], key: Sequence[str], bins: int = 64,
        seed: int = 42, keep_every: int | None = None, whole: int = WHOLE, cuts: list[np.ndarray] | None = None) -> dict[str, Booster]:
    """A booster for each target. A null feature counts as the least value. A target's null rows are left out of its own
    trees. `key` names a row when rows are drawn. Up to `whole` cells of rows x features the trees of a target are grown by one task,
    unless `keep_every` asks for passes; it says after how many trees they cut their lineage.
    """
    names = list(targets)
    cuts = cut_points(df, features, bins) if cuts is None else cuts
    base = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(t).cast("double")).alias(f"b{i}") for i, t in enumerate(names)]).first()
    boosters = [Booster(list(features), cuts, s, float(base[f"b{i}"] or 0.0) if s.loss == "squared" else 0.0)
                for i, s in enumerate(targets.values())]
    filled = df.select(*key, *names, *[F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))).alias(f) for f in features])
    row_key = F.xxhash64(F.lit(seed), *key).alias("row_key")
    if keep_every is None and base["n"] * max(len(features), 8) <= whole:
        grow_whole(filled.select(row_key, *[F.col(t).cast("double") for t in names], *features), boosters, seed)
    else:
        rows = materialize(filled.select(
            row_key, binned_columns(features, cuts).alias("bins"), F.array(*[F.col(t).cast("double") for t in names]).alias("truth"),
            F.array(*[F.lit(b.base) for b in boosters]).alias("margin")))
        grow_in_passes(rows, boosters, seed, keep_every or 20)
    return dict(zip(names, boosters, strict=True))


def grow_in_passes(rows: DataFrame, boosters: list[Booster], seed: int, keep_every: int) -> None:
    """A pass per level adds up histograms. The first pass over a tree adds the last one to the margins and keeps them
    on the executors' disks, where two copies lie at most, so that no level looks through earlier trees again. Every
    `keep_every` trees they are written to the shared folder, which cuts their lineage.
    """
    n_features, n_bins = len(boosters[0].features), max(len(c) for c in boosters[0].cuts) + 1
    rounds, pending = [b.settings.rounds for b in boosters], [0] * len(boosters)
    for number in range(max(rounds)):
        growing = {t: (Tree.empty(b.settings.depth), number) for t, b in enumerate(boosters) if number < b.settings.rounds}
        seeds = {t: seed + draw_of(boosters[t].settings, t) for t in growing}
        columns = {t: columns_of(n_features, boosters[t].settings, seeds[t], number) for t in growing}
        open_, level, older = dict(growing), 0, None
        if max(pending):
            older, rows = rows, with_margins(rows, boosters, pending).persist(StorageLevel.DISK_ONLY)
            pending = [0] * len(boosters)
        while open_:
            sums = histograms(rows, boosters, pending, open_, level, n_bins)
            open_ = {t: pair for t, pair in open_.items() if split_level(
                pair[0], sums[t], level, columns[t], boosters[t].settings, number,
                closed_to(n_features, boosters[t].settings, seeds[t], number, level))}
            level += 1
            if older is not None:  # the pass has filled the newer copy
                older.unpersist()
                older = None
        for t, (tree, _) in growing.items():
            boosters[t].trees.append(tree)
            pending[t] += 1
        if (number + 1) % keep_every == 0 and number + 1 < max(rounds):
            older, rows = rows, materialize(with_margins(rows, boosters, pending))
            older.unpersist()
            pending = [0] * len(boosters)
    rows.unpersist()


def own_parts(spark, n: int) -> list[int]:
    """n numbers that Spark's hash partitioning sends to n different parts."""
    found = spark.range(64 * n + 64, numPartitions=1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part")).collect()
    first = {r.part: r.id for r in reversed(found)}
    return [first.get(i, i) for i in range(n)]


def grow_whole(rows: DataFrame, boosters: list[Booster], seed: int) -> None:
    """The rows of a target, binned, meet in one task. `rows` has the row's key, the targets and the features."""
    cuts, n_targets, keys = boosters[0].cuts, len(boosters), own_parts(rows.sparkSession, len(boosters))
    width, n_bins = len(cuts), max(len(c) for c in cuts) + 1
    shape = [(b.base, b.settings) for b in boosters]
    numbers, kind = {k: t for t, k in enumerate(keys)}, np.uint8 if n_bins <= 256 else np.int32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_key, bins = batch.column(0).to_numpy(), digits(batch, 1 + n_targets, cuts).astype(kind)
            out = []
            for t in range(n_targets):
                truth = batch.column(1 + t).to_numpy(zero_copy_only=False)
                known = ~np.isnan(truth)
                out.append([x[known].tobytes() for x in (row_key, bins, truth)])
            columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns], names=["target", "row_key", "bins", "truth"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, held = None, []

        def out() -> pa.RecordBatch:
            row_key, bins, truth = [np.concatenate([np.frombuffer(r[i], k) for r in held]) for i, k in enumerate((np.int64, kind, np.float64))]
            held.clear()
            t, bins = numbers[target], np.ascontiguousarray(bins.reshape(-1, width).T)
            trees = [b"".join([x.feature.astype(np.int16).tobytes(), x.bin.astype(np.int16).tobytes(), x.value.tobytes(), x.gain.tobytes()])
                     for x in grown(bins, row_key, truth, *shape[t], t, n_bins, seed)]
            columns = [pa.array([t] * len(trees), pa.int32()), pa.array(range(len(trees)), pa.int32()), pa.array(trees, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["target", "number", "tree"])

        for batch in batches:
            for own, *data in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
                if own != target and held:
                    yield out()
                target = own
                held.append(data)
        if held:
            yield out()

    packed = rows.mapInArrow(pack, "target long, row_key binary, bins binary, truth binary").withColumn("place", F.monotonically_increasing_id())
    met = packed.repartition(n_targets, "target").sortWithinPartitions("target", "place")
    found = {(r.target, r.number): r.tree for r in met.mapInArrow(grow, "target int, number int, tree binary").collect()}
    for t, b in enumerate(boosters):
        n = 2 ** (b.settings.depth + 1) - 1
        for number in range(b.settings.rounds):
            data = found.get((t, number))
            if data is None:  # no rows
                b.trees.append(Tree.empty(b.settings.depth))
                continue
            feature, cut = (np.frombuffer(data, np.int16, n, at).astype(int) for at in (0, 2 * n))
            value, gain = (np.frombuffer(data, np.float64, n, at).copy() for at in (4 * n, 12 * n))
            b.trees.append(Tree(feature, cut, value, gain))


def grown(bins: np.ndarray, row_key: np.ndarray, truth: np.ndarray, base: float, s: Settings, target: int, n_bins: int,
          seed: int) -> list[Tree]:
    """All trees of a target from its rows; `bins` is features x rows."""
    n_features, n = bins.shape
    flat, margin, every, trees, draw = bins.ravel(), np.full(n, base), np.arange(n), [], draw_of(s, target)
    for number in range(s.rounds):
        tree, g, weight = Tree.empty(s.depth), gradients(margin, truth, number, s), None
        if s.row_share < 1:
            weight = (row_draw(row_key, draw, number) < s.row_share).astype(float)
            g = g * weight
        columns, at, rows = columns_of(n_features, s, seed + draw, number), np.zeros(n, np.intp), None
        for level in range(s.depth + 1):
            first, width = 2 ** level - 1, 2 ** level
            own, of, shares = (at, g, weight) if rows is None else (at[rows], g[rows], None if weight is None else weight[rows])
            last = level == s.depth
            deep, slot = 1 if last else n_bins, (own - first) * (1 if last else n_bins)
            sums = np.zeros((width, n_features, deep, 2))
            for j in columns[:1] if last else columns:
                cell = slot if last else slot + (bins[j] if rows is None else bins[j][rows])
                sums[:, j, :, 0] = np.bincount(cell, of, width * deep).reshape(width, deep)
                sums[:, j, :, 1] = np.bincount(cell, shares, width * deep).reshape(width, deep)
            if not split_level(tree, sums, level, columns, s, number, None if last else closed_to(n_features, s, seed + draw, number, level)):
                break
            feature = tree.feature[own]
            inner = feature >= 0
            if not inner.all():
                rows = (every if rows is None else rows)[inner]
                own, feature = own[inner], feature[inner]
            right = flat[feature * n + (every if rows is None else rows)] > tree.bin[own]
            own = 2 * own + 1 + right
            if rows is None:
                at = own
            else:
                at[rows] = own
        margin += tree.value[at]
        trees.append(tree)
    return trees


def with_margins(rows: DataFrame, boosters: list[Booster], pending: list[int]) -> DataFrame:
    n_features, n_targets, names = len(boosters[0].features), len(boosters), rows.columns
    lacking = [(b.settings.depth, b.trees[len(b.trees) - n:]) for b, n in zip(boosters, pending, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, bins, _, margin = unpack(batch, n_features, n_targets)
            margin = margin.copy()
            for t, (depth, trees) in enumerate(lacking):
                for last in trees:
                    margin[:, t] += last.predict(bins, depth)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_targets)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(margin.ravel()))], names=names)

    return rows.mapInArrow(run, rows.schema)


def predict(df: DataFrame, boosters: dict[str, Booster], prefix: str = "prediction_") -> DataFrame:
    """All columns of `df` and a prediction for each target."""
    own = [(replace(b, trees=[]), b.packed()) for b in boosters.values()]  # trees travel packed
    features, cuts = next(iter(boosters.values())).features, own[0][0].cuts
    wide = df.select("*", *[F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))).alias(f"_f{i}") for i, f in enumerate(features)])
    schema = df.select("*", *[F.lit(0.0).alias(prefix + t) for t in boosters]).schema
    kept = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = digits(batch, kept, cuts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *[pa.array(b.predict_bins(bins, packed)) for b, packed in own]], names=schema.names)

    return wide.mapInArrow(run, schema)


def report(df: DataFrame, boosters: dict[str, Booster]) -> DataFrame:
    """Errors and share of right signs of each target's predictions over `df`."""
    scored = materialize(predict(df, boosters).select(*boosters, *[f"prediction_{t}" for t in boosters]))
    out = None
    for target in boosters:
        guess = scored.select(F.col(target).alias("truth"), F.col(f"prediction_{target}").alias("guess"))
        direction = E.directional_accuracy(guess, rules=["sign"]).select("directional_accuracy")
        row = E.regression_metrics(guess).select(F.lit(target).alias("target"), F.lit("boosted").alias("model"), "*")
        row = row.withColumn("directional_accuracy", direction.scalar())
        out = row if out is None else out.unionByName(row)
    return out


def donor_step(n: int, rng: random.Random) -> tuple[int, int]:
    """a and b of a random permutation p -> (a p + b) mod n."""
    a = next(x for x in iter(lambda: rng.randrange(1, max(n, 2)), None) if gcd(x, n) == 1)
    return a, rng.randrange(n)


def permutation_errors(df: DataFrame, boosters: dict[str, Booster], key: Sequence[str], repeats: int = 10,
                       seed: int = 42) -> dict[str, DataFrame]:
    """Per target (feature, importance, importance_std): how much the mean absolute error grows when a feature is shuffled.

    The error is a mean over rows, so no ranking is needed: all features, targets and repeats are scored in one pass and
    summed up. Rows have consecutive positions in hash order, and row p takes the value of row (a p + b) mod n. Rows
    without a target do not count for it.
    """
    features, targets = next(iter(boosters.values())).features, list(boosters)
    base = materialize(positions(df.select(*key, *targets, *features), key, "_pos", seed))
    n, rng, parts = base.count(), random.Random(seed), []
    own = F.array(*[F.col(f).cast("double") for f in features])
    rows = base.select("_pos", *targets, own.alias("_own"))
    for repeat in range(repeats if n else 0):
        a, b = donor_step(n, rng)
        step = F.col("_pos").cast("decimal(19,0)") * F.lit(a).cast("decimal(18,0)") + F.lit(b)
        donors = base.select(F.pmod(step, F.lit(n)).cast("long").alias("_pos"), own.alias("_other"))
        parts.append(rows.join(donors, "_pos").withColumn("_repeat", F.lit(repeat)))
    # feature -1 is left as it is: the error to compare with
    whole = rows.withColumns({"_other": F.col("_own"), "_repeat": F.lit(-1), "_j": F.lit(-1)})
    mixed = whole
    for part in parts:
        mixed = mixed.unionByName(part.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))))
    value = {f: F.when(F.col("_j") == i, F.get("_other", F.lit(i))).otherwise(F.get("_own", F.lit(i))) for i, f in enumerate(features)}
    scored = predict(mixed.select(*targets, "_repeat", "_j", *[c.alias(f) for f, c in value.items()]), boosters)
    errors = materialize(scored.groupBy("_j", "_repeat").agg(
        *[F.avg(F.abs(F.col(t) - F.col(f"prediction_{t}"))).alias(t) for t in targets]))
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("_j"))
    out = {}
    for t in targets:
        reference = errors.where("_j = -1").select(F.col(t).alias("_reference"))
        drops = errors.where("_j >= 0").select(name.alias("feature"), (F.col(t) - reference.scalar()).alias("drop"))
        out[t] = drops.groupBy("feature").agg(
            F.avg("drop").alias("importance"), F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("importance_std"))
    return out


# ---- classifier -------------------------------------------------------------------
ALL = {"all": 1.0, "auto": 1.0}
NOT_USED = {"minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "lossType": "logistic"}


@dataclass
class ClassifierModel:
    """A fitted classifier; `rounds` of the booster's trees count."""

    features: str
    booster: Booster
    rounds: int

    def transform(self, df: DataFrame) -> DataFrame:
        """All columns of `df` and `probability`, as MLlib's models give it."""
        booster = replace(self.booster, trees=self.booster.trees[:self.rounds])
        packed, booster = booster.packed(), replace(booster, trees=[])

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(booster.cuts)))
            bins = np.stack([np.searchsorted(c, values[:, j]) for j, c in enumerate(booster.cuts)], axis=1)
            share = 1 / (1 + np.exp(np.clip(-2 * booster.predict_bins(bins, packed), -700, 700)))
            return pd.Series(list(np.stack([1 - share, share], axis=1)))

        return df.withColumn("probability", array_to_vector(shares(vector_to_array(self.features))))


class Classifier:
    """Fits what an MLlib GBTClassifier describes with the booster above; MLlib itself runs some jobs for each of the trees.

    Rules are MLlib's, bins too; draws of rows and of a node's features are hashes, so a fit that draws differs from MLlib's as
    those of two seeds do. `key` names a row. Up to `mllib` training rows MLlib fits the trees.
    """

    def __init__(self, like: GBTClassifier, key: Sequence[str], mllib: int = 0, whole: int = WHOLE):
        self.like, self.key, self.mllib, self.whole = like, list(key), mllib, whole

    def getParam(self, name: str):
        return self.like.getParam(name)

    def settings(self, like: GBTClassifier) -> Settings:
        other = [p for p, v in NOT_USED.items() if like.getOrDefault(p) != v]
        other += [p for p in ("weightCol", "validationIndicatorCol") if like.isDefined(p)]
        share = ALL.get(like.getFeatureSubsetStrategy()) or float(like.getFeatureSubsetStrategy())
        if other or not 0 < share <= 1:
            raise ValueError(f"not supported: {', '.join(other) or like.getFeatureSubsetStrategy()}")
        return Settings(like.getMaxIter(), like.getMaxDepth(), like.getStepSize(), l2=0.0, child_weight=like.getMinInstancesPerNode(),
                        row_share=like.getSubsamplingRate(), column_share=share, by_node=True, loss="logistic", draw=0)

    def fit(self, frame: DataFrame):
        if self.mllib and frame.count() <= self.mllib:
            return self.like.fit(frame)
        return next(self.fitMultiple(frame, [{}]))[1]

    def fitMultiple(self, frame: DataFrame, maps: Sequence[dict]) -> Iterator[tuple[int, ClassifierModel]]:
        """Models of all points, side by side. Points that differ in their rounds alone share the trees of the longest fit."""
        every = [self.like.copy(m) for m in maps]
        if len({(e.getMaxBins(), e.getSeed(), e.getFeaturesCol(), e.getLabelCol()) for e in every}) > 1:
            raise ValueError("bins, seed and columns must be the same for all points")
        like, points = every[0], [self.settings(e) for e in every]
        fits = {}
        for s in points:
            fits[replace(s, rounds=0)] = max(s.rounds, fits.get(replace(s, rounds=0), 0))
        names = {s: f"_t{i}" for i, s in enumerate(fits)}
        base = frame.select(*self.key, vector_to_array(like.getFeaturesCol()).alias("x"), F.col(like.getLabelCol()).cast("double").alias("_label"))
        ends = base.agg(F.max(F.size("x")).alias("size"), F.count_if(~F.coalesce(F.col("_label").isin(0, 1), F.lit(False))).alias("odd")).first()
        if ends["size"] is None or ends.odd:
            raise ValueError("labels must be 0 and 1, and there must be rows")
        features = [f"_x{j}" for j in range(ends["size"])]
        cuts = RF.cut_points(base.select("x", F.lit(1.0).alias("w")), len(features), like.getMaxBins())
        wide = base.select(*self.key, *[F.get("x", F.lit(j)).alias(f) for j, f in enumerate(features)],
                           *[F.col("_label").alias(n) for n in names.values()])
        boosters = fit(wide, features, {n: replace(s, rounds=fits[s]) for s, n in names.items()}, self.key, seed=like.getSeed(),
                       whole=self.whole, cuts=cuts)
        models = [ClassifierModel(like.getFeaturesCol(), boosters[names[replace(s, rounds=0)]], s.rounds) for s in points]
        return Shared(enumerate(models))


class Shared:
    """An iterator that threads may share."""

    def __init__(self, items: Iterator):
        self.items, self.lock = items, threading.Lock()

    def __iter__(self):
        return self

    def __next__(self):
        with self.lock:
            return next(self.items)
