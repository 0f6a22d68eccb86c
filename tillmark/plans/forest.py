"""Random forests of deep trees that neither the driver nor one task holds whole.

MLlib keeps all nodes of a fit on the driver, and a deep forest has nodes in proportion to the training rows. Here the driver
sees only the top of each tree: per level, tasks add up class weights by node, drawn feature and bin, Spark sums them, and the
driver picks the splits until a node has at most `block` rows. The rows of such a node then meet in one task, which grows the
rest of that tree; these lower parts are stored as a table. Rows to be scored travel to the lower parts, not the other way.

The rules are MLlib's: Poisson bootstrap, a new draw of sqrt(features) for each node, weighted Gini gains over at most
`maxBins` bins, no split without gain, siblings of the same class merged, class shares of the leaves averaged over the trees.
Draws are hashes, so a fit differs from MLlib's as fits of two seeds do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.plans.models import materialize

LARGEST = 20_000  # training rows up to which MLlib fits the trees: some 20 nodes a row and 100 trees
BLOCK = 50_000  # rows of a node that one task grows on
PACK = 1 << 14  # rows that travel as one record
SIDE = 4096  # nodes of a level whose sums a task holds
UNIT = 1 << 24  # the largest weight in whole units: sums are exact in any order
FINE = 1024  # quantiles from which the bins are chosen
NOT_USED = {"impurity": "gini", "minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0,
            "subsamplingRate": 1.0, "featureSubsetStrategy": "auto", "bootstrap": True}
POISSON = np.cumsum([np.exp(-1.0) / factorial(i) for i in range(18)])


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    bins: int
    seed: int
    block: int = BLOCK


@dataclass
class Nodes:
    """A tree, or the lower part of one: the children of node i are left[i] and left[i] + 1; a feature below zero marks a leaf.

    `path` is 1 for a root and 2p, 2p + 1 for the children of p; `weight` has the class weights.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    weight: np.ndarray

    @staticmethod
    def root(path: int, weight: np.ndarray) -> Nodes:
        return Nodes(np.array([-1], np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.array([path], np.uint64),
                     np.asarray(weight, float).reshape(1, 2))

    def grow(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Split the nodes `at`; `children` is (nodes, 2 sides, 2 classes). The new nodes' numbers, pair by pair."""
        new = len(self.feature) + np.arange(2 * len(at))
        self.feature[at], self.cut[at], self.left[at] = feature, cut, new[::2]
        below = np.repeat(self.path[at] * np.uint64(2), 2)
        below[1::2] += np.uint64(1)
        self.feature = np.append(self.feature, np.full(len(new), -1, np.int16))
        self.cut = np.append(self.cut, np.zeros(len(new), np.uint8))
        self.left = np.append(self.left, np.zeros(len(new), np.int32))
        self.path = np.append(self.path, below)
        self.weight = np.concatenate([self.weight, children.reshape(-1, 2)])
        return new

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins (rows x features) ends in."""
        at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(live):
            f = self.feature[at[live]]
            inner = f >= 0
            live, f = live[inner], f[inner]
            here = at[live]
            at[live] = self.left[here] + (bins[live, f] > self.cut[here])
        return at

    def likelier(self) -> np.ndarray:
        return self.weight[:, 1] > self.weight[:, 0]

    def share(self) -> np.ndarray:
        """Of class 1; a half where no row was drawn."""
        total = self.weight.sum(axis=1)
        return np.where(total > 0, self.weight[:, 1] / np.maximum(total, 1), 0.5)

    def pruned(self, larger: np.ndarray | None = None) -> tuple[Nodes, np.ndarray]:
        """Two leaves of the same class become one, from the bottom up; `larger` marks leaves that stand for larger parts.

        Also says which of the old nodes are left.
        """
        feature, one = self.feature.copy(), self.likelier()
        single = (feature < 0) & (~larger if larger is not None else True)
        # all nodes of a level follow those of the level above
        level = np.floor(np.log2(self.path.astype(float))).astype(int)
        for own in np.unique(level)[::-1]:
            at = np.flatnonzero((level == own) & (feature >= 0))
            low = self.left[at]
            at = at[single[low] & single[low + 1] & (one[low] == one[low + 1])]
            feature[at], single[at] = -1, True
        used = np.zeros(len(feature), bool)
        used[0] = True
        for own in np.unique(level):
            low = self.left[np.flatnonzero((level == own) & (feature >= 0) & used)]
            used[low] = used[low + 1] = True
        place = np.cumsum(used) - 1
        left = np.where(feature >= 0, place[self.left], 0).astype(np.int32)
        return Nodes(feature[used], self.cut[used], left[used], self.path[used], self.weight[used]), used

    def pack(self) -> bytes:
        return b"".join([np.int64(len(self.feature)).tobytes(), self.feature.tobytes(), self.cut.tobytes(), self.left.tobytes(),
                         self.share().tobytes()])


def unpacked(data: bytes) -> tuple[Nodes, np.ndarray]:
    """A tree to walk through and the share of class 1 at its nodes."""
    n, at, parts = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in (np.int16, np.uint8, np.int32, np.float64):
        parts.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return Nodes(*parts[:3], np.empty(0), np.empty(0)), parts[3]


def mixed(x: np.ndarray, *parts: int) -> np.ndarray:
    """Numbers from 0 to 1, drawn by hashing."""
    with np.errstate(over="ignore"):
        for part in (*parts, 0):
            x = (x ^ np.uint64(part)) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def times_drawn(rows: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    return np.searchsorted(POISSON, mixed(rows, s.seed, tree, 1), side="right")


def columns_of(path: np.ndarray, tree: int, n_features: int, s: Settings) -> np.ndarray:
    """(nodes, drawn): the features each node may split by, in order."""
    size = min(n_features, ceil(sqrt(n_features)))
    draw = np.stack([mixed(path, s.seed, tree, 2 + f) for f in range(n_features)], axis=1)
    return np.sort(np.argsort(draw, axis=1, kind="stable")[:, :size], axis=1)


def sums_of(slot: np.ndarray, n_slots: int, columns: np.ndarray, bins: np.ndarray, weight: np.ndarray, n_bins: int) -> np.ndarray:
    """(nodes, drawn, bins, channels): `weight` (rows x channels) added up; `slot` is the row's place among the nodes."""
    size = columns.shape[1]
    flat = ((slot[:, None] * size + np.arange(size)) * n_bins + bins[np.arange(len(bins))[:, None], columns[slot]]).ravel()
    cells = n_slots * size * n_bins
    out = [np.bincount(flat, np.repeat(weight[:, c], size), cells) for c in range(weight.shape[1])]
    return np.stack(out, axis=-1).reshape(n_slots, size, n_bins, -1)


def gini(weight: np.ndarray) -> np.ndarray:
    """Class weights' sum times their impurity."""
    total = weight.sum(axis=-1)
    return 2 * weight[..., 0] * weight[..., 1] / np.maximum(total, 1)


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node: whether a split gains, the place of its feature, its bin, and the sums of both sides (nodes, 2, channels).

    Equal gains go to the first feature and the lowest bin.
    """
    left = np.cumsum(sums, axis=2)
    total, left = left[:, :, -1:], left[:, :, :-1]
    if not left.shape[2]:
        n = len(sums)
        return np.zeros(n, bool), np.zeros(n, int), np.zeros(n, int), np.zeros((n, 2, sums.shape[3]))
    wl, wr = left[..., :2], (total - left)[..., :2]
    whole = total[:, 0, 0, :2]
    gain = (gini(whole)[:, None, None] - gini(wl) - gini(wr)) / whole.sum(axis=1)[:, None, None]
    gain[(wl.sum(axis=-1) == 0) | (wr.sum(axis=-1) == 0)] = -1.0
    best = gain.reshape(len(sums), -1).argmax(axis=1)
    node = np.arange(len(sums))
    place, cut = np.divmod(best, gain.shape[2])
    low = left[node, place, cut]
    return gain[node, place, cut] > 1e-15, place, cut, np.stack([low, total[:, 0, 0] - low], axis=1)


def grown(bins: np.ndarray, weight: np.ndarray, tree: int, path: int, s: Settings, n_bins: int, chunk: int = 1024) -> Nodes:
    """The part of a tree below one node, from the rows in it; `weight` is rows x classes."""
    nodes = Nodes.root(path, weight.sum(axis=0))
    level, rows, slot, at = path.bit_length() - 1, np.arange(len(bins)), np.zeros(len(bins), np.int64), np.array([0])
    while len(at) and level < s.depth:
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        ends = np.searchsorted(slot, np.arange(0, len(at) + chunk, chunk))
        found = []
        columns = columns_of(nodes.path[at], tree, bins.shape[1], s)
        for i in range(0, len(at), chunk):
            part, some = slice(ends[i // chunk], ends[i // chunk + 1]), columns[i:i + chunk]
            sums = sums_of(slot[part] - i, len(some), some, bins[rows[part]], weight[rows[part]], n_bins)
            found.append(best_splits(sums))
        split, place, cut, sides = (np.concatenate(x) for x in zip(*found, strict=True))
        feature = columns[np.arange(len(at)), place]
        right = bins[rows, feature[slot]] > cut[slot]
        new = nodes.grow(at[split], feature[split], cut[split], sides[split])
        open_ = (nodes.weight[new] > 0).all(axis=1)
        child = np.full(2 * len(at), -1)  # place of the children among the nodes of the next level
        child[np.repeat(split, 2)] = np.where(open_, np.cumsum(open_) - 1, -1)
        slot = child[2 * slot + right]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        at, level = new[open_], level + 1
    return nodes


# ---- bins -----------------------------------------------------------------------
def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's choice: between all neighbours if they are few, else where the weight before comes nearest to equal shares."""
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    before, stride, out = np.cumsum(weights), weights.sum() / bins, []
    target = stride
    for i in range(1, len(values)):
        if abs(before[i - 1] - target) < abs(before[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out[:bins - 1])


def cut_points(df: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Per feature the borders of its bins, from all rows: weights of single values where these are few, else of fine quantiles.

    `df` has `x` (array) and `w`.
    """
    names = [f"x{i}" for i in range(n_features)]
    wide = df.select("w", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    distinct = wide.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    many = [n for n in names if distinct[n] > 4 * bins]
    fine = dict(zip(many, wide.approxQuantile(many, [i / FINE for i in range(FINE + 1)], 0.25 / FINE), strict=True)) if many else {}
    edges = {n: np.unique(fine[n]) for n in many}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = batch.column(0).to_numpy()
            for j, n in enumerate(names):
                x = batch.column(1 + j).to_numpy()
                if n in edges:  # the least fine quantile that is not below the value
                    x = edges[n][np.minimum(np.searchsorted(edges[n], x), len(edges[n]) - 1)]
                value, place = np.unique(x, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), j, np.int32)), pa.array(value), pa.array(np.bincount(place, weight))],
                    names=["j", "value", "w"])

    table = wide.mapInArrow(run, "j int, value double, w double").groupBy("j", "value").agg(F.sum("w").alias("w")).toArrow()
    out = []
    for j in range(n_features):
        own = table.column("j").to_numpy() == j
        value, weight = table.column("value").to_numpy()[own], table.column("w").to_numpy()[own]
        order = np.argsort(value)
        out.append(thresholds(value[order], weight[order], bins))
    return out


# ---- rows -----------------------------------------------------------------------
def records(df: DataFrame, cuts: list[np.ndarray], extra: dict[str, type]) -> DataFrame:
    """(batch, n, bins, extra columns): up to PACK rows of `x` and `extra` as one record, numbered and stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            bins = np.concatenate([b for b, _ in held])
            columns = [np.concatenate([e[i] for _, e in held]) for i in range(len(extra))]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(bins)], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in (bins, *columns)]],
                names=["n", "bins", *extra])

        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                part = batch.slice(start, PACK)
                x = part.column(0).flatten().to_numpy().reshape(-1, len(cuts))
                bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
                if held and size + len(bins) > PACK:
                    yield out()
                    held, size = [], 0
                held.append((bins, [part.column(1 + i).to_numpy().astype(k) for i, k in enumerate(extra.values())]))
                size += len(bins)
        if held:
            yield out()

    schema = "n int, bins binary" + "".join(f", {c} binary" for c in extra)
    packed = df.select("x", *extra).mapInArrow(run, schema)
    return materialize(packed.select(F.monotonically_increasing_id().alias("batch"), "*"))


def each(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple]:
    """(batch, bins, raw extra columns) of each record."""
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield row[0], np.frombuffer(row[2], np.uint8).reshape(-1, n_features), row[3:]


def parted(df: DataFrame, by: str, pairs: int, *order: str) -> DataFrame:
    """Records of one key in one task, in order. Work follows pairs of rows and trees, not bytes, so the parts are counted."""
    parts = max(3 * df.sparkSession.sparkContext.defaultParallelism, pairs // 2_000_000)
    return df.repartition(parts, by).sortWithinPartitions(by, *order)


def by_value(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and the places where it stands."""
    order = np.argsort(keys, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        yield int(keys[places[0]]), places


MESSAGE = "block long, batch long, places binary, data binary"  # places of a record's rows, and what is said of them


def messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["block", "batch", "places", "data"])


def number(value: int, name: str = "batch") -> Column:
    return F.lit(value).cast("long").alias(name)


@dataclass
class Forest:
    """Tops of all trees, and the table (block, nodes) of what hangs below them."""

    features: str
    cuts: list[np.ndarray]
    tops: list[Nodes]
    blocks: list[np.ndarray]  # for each node of a top the number of the block below it, or -1
    parts: list[DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        """All columns of `df` and `probability`, as MLlib's models give it."""
        base = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
        width, trees = len(self.cuts), len(self.tops)
        rows = records(base.select(vector_to_array(self.features).alias("x"), F.col("_row").alias("rows")), self.cuts, {"rows": np.int64})
        tops = [(top, top.share(), blocks) for top, blocks in zip(self.tops, self.blocks, strict=True)]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, bins, _ in each(batches, width):
                sure, out = np.zeros(len(bins)), []
                for top, share, blocks in tops:
                    at = top.walk(bins)
                    sure += np.where(blocks[at] < 0, share[at], 0.0)
                    for block, places in by_value(blocks[at]):
                        if block >= 0:
                            out.append((block, batch, places.astype(np.int32).tobytes(), bins[places].tobytes()))
                out.append((-1, batch, np.arange(len(bins), dtype=np.int32).tobytes(), sure.tobytes()))
                yield messages(out)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tree, share = None, None, None
            for batch in batches:
                out = []
                for block, record, place, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if block < 0:  # leaves of the tops
                        out.append((block, record, place, data))
                    elif record < 0:  # the block's nodes come before its rows
                        own, (tree, share) = block, unpacked(data)
                    elif block != own:
                        raise ValueError(f"no nodes for block {block}")
                    else:
                        bins = np.frombuffer(data, np.uint8).reshape(-1, width)
                        out.append((block, record, place, share[tree.walk(bins)].tobytes()))
                yield messages(out)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, total = None, None

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total / trees)], names=["_row", "_score"])

            for batch in batches:
                for block, _, place, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if block == -2:  # a record's rows come before the votes on them
                        if ids is not None:
                            yield out()
                        ids = np.frombuffer(data, np.int64)
                        total = np.zeros(len(ids))
                    else:
                        total[np.frombuffer(place, np.int32)] += np.frombuffer(data, np.float64)
            if ids is not None:
                yield out()

        pairs = base.count() * trees
        hung = rows.mapInArrow(send, MESSAGE)
        for part in self.parts:
            hung = hung.unionByName(part.select("block", number(-1), F.lit(b"").alias("places"), F.col("nodes").alias("data")))
        hung = hung.withColumn("_by", F.when(F.col("block") < 0, -1 - F.col("batch")).otherwise(F.col("block")))
        votes = parted(hung, "_by", pairs, "block", "batch").drop("_by").mapInArrow(vote, MESSAGE)
        heads = rows.select(number(-2, "block"), "batch", F.lit(b"").alias("places"), F.col("rows").alias("data"))
        # blocks are sorted by tree, so votes on a row are added in the same order at any size of the cluster
        summed = parted(heads.unionByName(votes), "batch", pairs, "block").mapInArrow(add, "_row long, _score double")
        vector = array_to_vector(F.array(1 - F.col("_score"), F.col("_score")))
        return base.join(summed, "_row").withColumn("probability", vector).drop("_row", "_score")


# ---- fit ------------------------------------------------------------------------
def drawn(number: int, n: int, tree: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of a record's rows that are in a tree's sample, and how often."""
    with np.errstate(over="ignore"):
        times = times_drawn(np.uint64(number) * np.uint64(PACK) + np.arange(n, dtype=np.uint64), tree, s)
    places = np.flatnonzero(times)
    return places, times[places]


def class_weights(label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.where(label[:, None] == np.arange(2), weight[:, None], 0)


def level_sums(rows: DataFrame, tops: dict[int, Nodes], open_: dict[int, np.ndarray], n_features: int, n_bins: int,
               s: Settings) -> np.ndarray:
    """(open nodes, drawn features, bins, (weight of class 0, of class 1, rows)) over all trees, in their order."""
    first = dict(zip(open_, np.cumsum([0] + [len(a) for a in open_.values()]), strict=False))
    columns = {t: columns_of(tops[t].path[at], t, n_features, s) for t, at in open_.items()}
    n_nodes, size = sum(len(a) for a in open_.values()), min(n_features, ceil(sqrt(n_features)))
    shape = (n_nodes, size, n_bins, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape)
        for record, bins, (label, weight) in each(batches, n_features):
            label, weight = np.frombuffer(label, np.uint8), np.frombuffer(weight, np.int64)
            for t, at in open_.items():
                places, times = drawn(record, len(bins), t, s)
                slot = np.full(len(tops[t].feature), -1)
                slot[at] = np.arange(len(at))
                slot = slot[tops[t].walk(bins[places])]
                places, times, slot = places[slot >= 0], times[slot >= 0], slot[slot >= 0]
                own = np.column_stack([class_weights(label[places], weight[places] * times), np.ones(len(places))])
                sums[first[t]:first[t] + len(at)] += sums_of(slot, len(at), columns[t], bins[places], own, n_bins)
        flat = sums.reshape(-1, 3)
        cell = np.flatnonzero(flat[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(flat[cell, c]) for c in range(3)]], names=["cell", "a", "b", "n"])

    table = rows.mapInArrow(run, "cell long, a double, b double, n double").groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in ("a", "b", "n")]).toArrow()
    out = np.zeros((int(np.prod(shape[:3])), 3))
    out[table.column("cell").to_numpy()] = np.column_stack([table.column(c).to_numpy() for c in ("a", "b", "n")])
    return out.reshape(shape)


def grow_tops(rows: DataFrame, trees: range, n_features: int, n_bins: int, s: Settings) -> tuple[dict[int, Nodes], dict[int, np.ndarray]]:
    """Tops of some trees, and which of their leaves are blocks: mixed nodes of at most `s.block` rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), 3))
        for record, bins, (label, weight) in each(batches, n_features):
            label, weight = np.frombuffer(label, np.uint8), np.frombuffer(weight, np.int64)
            for i, t in enumerate(trees):
                places, times = drawn(record, len(bins), t, s)
                total[i] += [*class_weights(label[places], weight[places] * times).sum(axis=0), len(places)]
        yield pa.RecordBatch.from_arrays([pa.array(trees), *[pa.array(total[:, c]) for c in range(3)]], names=["tree", "a", "b", "n"])

    found = rows.mapInArrow(count, "tree long, a double, b double, n double").groupBy("tree").agg(
        *[F.sum(c).alias(c) for c in ("a", "b", "n")]).collect()
    tops = {r.tree: Nodes.root(1, [r.a, r.b]) for r in found}
    blocks = {t: np.zeros(1, bool) for t in tops}
    new = {r.tree: (np.array([0]), np.array([r.n])) for r in found}
    for level in range(s.depth):
        open_ = {}
        for t, (at, n) in sorted(new.items()):
            mixed_, few = (tops[t].weight[at] > 0).all(axis=1), n <= s.block
            blocks[t] = np.append(blocks[t], np.zeros(len(tops[t].feature) - len(blocks[t]), bool))
            blocks[t][at[mixed_ & few]] = True
            if (mixed_ & ~few).any():
                open_[t] = at[mixed_ & ~few]
        if not open_:
            break
        sums, first, new = level_sums(rows, tops, open_, n_features, n_bins, s), 0, {}
        for t, at in open_.items():
            split, place, cut, sides = best_splits(sums[first:first + len(at)])
            first += len(at)
            feature = columns_of(tops[t].path[at], t, n_features, s)[np.arange(len(at)), place]
            below = tops[t].grow(at[split], feature[split], cut[split], sides[split][..., :2])
            new[t] = (below, sides[split][..., 2].ravel())
    for t, top in tops.items():
        blocks[t] = np.append(blocks[t], np.zeros(len(top.feature) - len(blocks[t]), bool))
    return tops, blocks


def grow_blocks(rows: DataFrame, tops: dict[int, Nodes], numbers: dict[int, np.ndarray], pairs: int, n_features: int, n_bins: int,
                s: Settings) -> DataFrame:
    """(block, nodes, single): the part of its tree below each block, and whether it came down to one leaf."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record, bins, (label, weight) in each(batches, n_features):
            label, weight, out = np.frombuffer(label, np.uint8), np.frombuffer(weight, np.int64), []
            for t, top in tops.items():
                places, times = drawn(record, len(bins), t, s)
                for block, some in by_value(numbers[t][top.walk(bins[places])]) if len(places) else ():
                    if block >= 0:
                        own = class_weights(label[places[some]], weight[places[some]] * times[some])
                        out.append((block, record, own.tobytes(), bins[places[some]].tobytes()))
            yield messages(out)

    paths = {int(b): int(tops[t].path[i]) for t, own in numbers.items() for i, b in enumerate(own) if b >= 0}

    def finished(block: int, held: list[tuple[bytes, bytes]]) -> tuple:
        bins = np.frombuffer(b"".join(d for _, d in held), np.uint8).reshape(-1, n_features)
        weight = np.frombuffer(b"".join(w for w, _ in held), np.int64).reshape(-1, 2).astype(float)
        nodes, _ = grown(bins, weight, block >> 32, paths[block], s, n_bins).pruned()
        return block, nodes.pack(), len(nodes.feature) == 1

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(
                finished(own, held), (pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["block", "nodes", "single"])

        for batch in batches:
            for block, _, weight, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != own:
                    if held:
                        yield out()
                    own, held = block, []
                held.append((weight, data))
        if held:
            yield out()

    sent = rows.mapInArrow(send, MESSAGE)
    return materialize(parted(sent, "block", pairs, "batch").mapInArrow(grow, "block long, nodes binary, single boolean"))


def fit_large(frame: DataFrame, features: str, label: str, weight: str, s: Settings) -> Forest:
    """A forest over a vector column, labels 0 and 1 and a weight; rows of weight 0 do not count."""
    base = materialize(frame.where(F.col(weight) > 0).select(
        vector_to_array(features).alias("x"), F.col(label).cast("int").alias("label"), F.col(weight).cast("double").alias("w")))
    ends = base.agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max(F.size("x")).alias("size"),
                    F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("odd")).first()
    if not ends.n or ends.odd:
        raise ValueError("labels must be 0 and 1, and there must be rows")
    cuts = cut_points(base, ends.size, s.bins)
    n_bins = max(len(c) for c in cuts) + 1
    unit = F.greatest(F.round(F.col("w") * (UNIT / ends.w)).cast("long"), F.lit(1).cast("long"))
    rows = records(base.select("x", F.col("label"), unit.alias("weight")), cuts, {"label": np.uint8, "weight": np.int64})
    side = max(1, min(s.trees, SIDE * s.block // ends.n))
    tops, blocks, parts = [], [], []
    for first in range(0, s.trees, side):
        trees = range(first, min(first + side, s.trees))
        grown_tops, is_block = grow_tops(rows, trees, ends.size, n_bins, s)
        numbers = {t: np.where(own, (t << 32) + np.arange(len(own)), -1) for t, own in is_block.items()}
        part = grow_blocks(rows, grown_tops, numbers, ends.n * len(trees), ends.size, n_bins, s)
        single = np.array([r.block for r in part.where("single").select("block").collect()], np.int64)
        for t in trees:
            top, used = grown_tops[t].pruned(is_block[t] & ~np.isin(numbers[t], single))
            tops.append(top)
            own = numbers[t][used]
            blocks.append(np.where((top.feature < 0) & ~np.isin(own, single), own, -1))
        parts.append(part)
    return Forest(features, cuts, tops, blocks, parts)


def fit(estimator: RandomForestClassifier, frame: DataFrame, largest: int = LARGEST):
    """MLlib's fit up to `largest` rows, as its trees fit the driver; the forest of this module with the same settings above."""
    if frame.count() <= largest:
        return estimator.fit(frame)
    other = [p for p, v in NOT_USED.items() if estimator.getOrDefault(p) != v]
    if other:
        raise ValueError(f"not supported above {largest} rows: {', '.join(other)}")
    if not estimator.isDefined("weightCol"):
        frame, weight = frame.withColumn("_w", F.lit(1.0)), "_w"
    else:
        weight = estimator.getWeightCol()
    s = Settings(estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMaxBins(), estimator.getSeed())
    return fit_large(frame, estimator.getFeaturesCol(), estimator.getLabelCol(), weight, s)
