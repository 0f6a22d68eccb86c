"""Exact Jaccard join of word n-gram sets, by prefixes under several global orders.

Two sets of similarity t share a token among the first n - ceil(t n) + 1 tokens of each, under any global order of the
tokens. Two orders are used; both put the most frequent tokens last, and within that follow different hashes. A pair is
a candidate only if its prefixes meet under both orders, its sizes fit, and its counts in 64 hash classes do not differ
by more than the allowed difference; candidates are then verified by their whole sets. Under the first order the
prefixes must even share as many tokens as a link needs beyond the longer rest: a common token that is not in both
prefixes stands in the rest of the set whose prefix ends first.

Large groups of near copies would meet at very many tokens. So documents that share several prefix tokens with the same
pivot of their token groups are put together first; pairs are only listed across such gatherings. A gathering of more
than a few nodes is met as a whole, once for each node and token, whatever its size. Gatherings and
candidate pairs make up the canopies: every linked pair lies inside one. A canopy is verified in blocks, by products of
0/1 matrices, and each block returns a spanning forest of its links. Nothing is dropped or capped.

Documents with equal sets are one node, named by their smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import cut, join_small, stored
from tillmark.llm.components import Forest, components
from tillmark.llm.wordhash import U64, mix, shingle_sets

CLASSES = 64
BLOCK_TOKENS = 1 << 18
PAIRS = 1 << 17  # pairs a task holds before it passes them on
MOST_FREQUENT = 500_000  # at most so many tokens are held to be put last


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    flat = flat.view(np.int64) if flat.dtype == U64 else flat
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def texts_of(batch: pa.RecordBatch, at: int = 1) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def sums(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two sums over each set, which name it."""
    with np.errstate(over="ignore"):
        plain = np.array([x.sum() for x in sets], dtype=U64)
        mixed = np.array([mix(x ^ U64(77)).sum() for x in sets], dtype=U64)
    return pa.array(plain.view(np.int64)), pa.array(mixed.view(np.int64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, other columns but the text, n, s1, s2): set size and the sums that name the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array([len(x) for x in sets], pa.int64()), *sums(sets)], names=names)

    shape = docs.select(F.col("doc_id").cast("long"), *docs.columns[2:], *[
        F.lit(None).cast("long").alias(name) for name in ("n", "s1", "s2")])
    names = shape.columns
    return docs.mapInArrow(run, shape.schema)


def frequencies(docs: DataFrame, words: int, percent: int, held: int = 1 << 21) -> DataFrame:
    """(token, n): how often tokens stand in the prefixes in the order of the hashes.

    A task adds up what it has seen and leaves out what it has seen once, so the counts are lower bounds: they only
    decide which tokens come last in the order, and frequent ones repeat within a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(tokens):
            values, n = np.unique(np.concatenate([*tokens, np.empty(0, U64)]), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["token", "n"])

        tokens, size = [], 0
        for batch in batches:
            for x in shingle_sets(texts_of(batch), words):
                tokens.append(x[: prefix_length(len(x), percent)])
                size += len(tokens[-1])
            if size > held:
                yield rows(tokens)
                tokens, size = [], 0
        yield rows(tokens)

    return docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def least(tokens: np.ndarray, take: int) -> np.ndarray:
    """The first `take` tokens in the second order."""
    if take <= 0 or take >= len(tokens):
        return tokens[: max(take, 0)]
    return tokens[np.argpartition(mix(tokens + U64(0x51ED270B)), take)[:take]]


def prefixes(docs: DataFrame, words: int, percent: int, last: np.ndarray) -> DataFrame:
    """(doc_id, s1, s2, classes, first, second): counts by hash class and the prefixes under both orders.

    Counts stop at 255, which keeps their differences lower bounds. The second prefix holds half of each hash: a chance
    match only lets a pair be verified that need not be.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch), words)
            counts, first, second = [], [], []
            for x in sets:
                take = prefix_length(len(x), percent)
                late = np.zeros(len(x), dtype=bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
                early, rest = x[~late], x[late]
                first.append(np.concatenate([early[:take], rest[: max(0, take - len(early))]]))
                second.append(np.concatenate([least(early, take), least(rest, take - len(early))]))
                by_class = np.bincount((x & U64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                counts.append(np.minimum(by_class, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *sums(sets), pa.array(counts, pa.binary()), lists(first),
                 lists([(x & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in second])],
                names=["doc_id", "s1", "s2", "classes", "first", "second"])

    return docs.mapInArrow(
        run, "doc_id long, s1 long, s2 long, classes binary, first array<long>, second array<int>")


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """The rows of each value of the first `keys` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
            if held:
                change[0] |= values[0] != held[-1].column(k)[-1].as_py()
        begin = 0
        for at in np.flatnonzero(change).tolist():
            if at > begin:
                held.append(batch.slice(begin, at - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], at
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def gathered(tokens: DataFrame) -> DataFrame:
    """(token, node, pivot) of the tokens that several nodes hold; the pivot has the smallest hash of them."""
    rows = tokens.repartition("token").sortWithinPartitions("token", F.xxhash64("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run's first row is held back until a second one shows that the token is shared
        last, pivot, shown, previous = None, None, True, None
        for batch in batches:
            token, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # rows of copies are the same row
            fresh = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))[: len(token)]
            if len(token) and last is not None and token[0] == last and doc[0] == previous:
                fresh[0] = False
            token, doc = token[fresh], doc[fresh]
            if not len(token):
                continue
            previous = doc[-1]
            new = np.concatenate([[last is None or token[0] != last], token[1:] != token[:-1]])
            starts = np.flatnonzero(new)
            pivots = np.empty(len(token), np.int64)
            pivots[: starts[0] if len(starts) else len(token)] = pivot if pivot is not None else 0
            ends = np.append(starts[1:], len(token))
            for_each = np.repeat(doc[starts], ends - starts)
            if len(starts):
                pivots[starts[0] :] = for_each
            follows = ~new
            shared = follows.copy()
            shared[:-1] |= follows[1:]
            t, d, p = token[shared], doc[shared], pivots[shared]
            if follows[0] and not shown:
                t, d, p = np.append(t, last), np.append(d, pivot), np.append(p, pivot)
            shown = bool(shared[-1])
            last, pivot = token[-1], int(pivots[-1])
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(d), pa.array(p)], names=["token", "node", "pivot"])

    return rows.select("token", "node").mapInArrow(run, "token long, node long, pivot long")


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that end where a value of the first column ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_numpy()
            end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if end:
                yield table.slice(0, end)
                held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def least_common(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that prefixes of sets of these sizes share at least, if the sets link."""
    # a link has at least percent / (100 + percent) of both sizes in common; a prefix leaves out ceil(percent n / 100) - 1
    return -(-percent * (left + right) // (100 + percent)) + percent * np.maximum(left, right) // -100 + 1


def against_crowds(token: np.ndarray, node: np.ndarray, n: np.ndarray, group: np.ndarray, counts: np.ndarray,
                   crowd: np.ndarray, percent: int, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, ...]]:
    """(node, gathering, least) of the rows and the crowded gatherings of each token, where some of these may link.

    A gathering stands for its rows of the token by the range of their sizes and of their class counts. Of two crowded
    gatherings the rows of the smaller id meet the other. Rows are sorted by token.
    """
    at = np.flatnonzero(crowd)
    if not len(at):
        return
    at = at[np.lexsort((group[at], token[at]))]
    begins = np.flatnonzero(np.append(True, (token[at[1:]] != token[at[:-1]]) | (group[at[1:]] != group[at[:-1]])))
    of, name = token[at[begins]], group[at[begins]]
    fewest, largest = np.minimum.reduceat(n[at], begins), np.maximum.reduceat(n[at], begins)
    floor, ceiling = np.minimum.reduceat(counts[at], begins), np.maximum.reduceat(counts[at], begins)
    first = np.searchsorted(of, token)
    many = np.searchsorted(of, token, side="right") - first
    ends = np.cumsum(many)
    bounds = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], most), side="right"), len(token)))
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        i = np.repeat(np.arange(begin, end), many[begin:end])
        k = np.arange(len(i)) + ends[begin] - many[begin] + np.repeat((first - ends + many)[begin:end], many[begin:end])
        fit = (group[i] < name[k]) | ((group[i] != name[k]) & ~crowd[i])
        i, k = i[fit], k[fit]
        low = np.maximum(fewest[k], -(-percent * n[i] // 100))
        high = np.minimum(largest[k], n[i] * 100 // percent)
        fit = low <= high
        i, k, low, high = i[fit], k[fit], low[fit], high[fit]
        apart = (np.maximum(floor[k] - counts[i], 0) + np.maximum(counts[i] - ceiling[k], 0)).sum(axis=1)
        fit = (100 + percent) * apart <= (100 - percent) * (n[i] + high)
        i, k, low, high = i[fit], k[fit], low[fit], high[fit]
        # it grows up to the row's own size and falls beyond, but for rounding
        least_of = np.minimum(least_common(n[i], low, percent), least_common(n[i], high, percent) - 1)
        yield node[i], name[k], least_of


def crossing_pairs(rows: DataFrame, percent: int, short: int = 48) -> DataFrame:
    """(a, b, whole) of different gatherings whose sizes, class counts and common prefix tokens allow a link.

    `rows`: token, node, n, classes, gathering, crowd. A pair comes up once for each common prefix token. The nodes of a
    crowded gathering are not listed: where `whole`, a may link with some node of the gathering b. Runs of up to `short`
    other rows are compared together, shift by shift.
    """
    ordered = rows.repartition("token").sortWithinPartitions("token", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_runs(batches):
            token, node = own.column("token").to_numpy(), own.column("node").to_numpy()
            n, group = own.column("n").to_numpy(), own.column("gathering").to_numpy()
            counts = np.frombuffer(b"".join(own.column("classes").to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
            crowd = own.column("crowd").to_numpy()
            for found in against_crowds(token, node, n, group, counts, crowd, percent):
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(np.ones(len(found[0]), dtype=bool))], names=names)
            token, node, n, group, counts = (x[~crowd] for x in (token, node, n, group, counts))
            if not len(token):
                continue
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            sizes = np.diff(np.append(starts, len(token)))

            def compare(i, j):
                """Columns of the pairs that may link."""
                fit = (group[i] != group[j]) & (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j]))
                i, j = i[fit], j[fit]
                apart = np.abs(counts[i] - counts[j]).sum(axis=1)
                fit = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
                i, j = i[fit], j[fit]
                held.append((node[i], node[j], least_common(n[i], n[j], percent)))
                nonlocal size
                size += len(i)
                return size >= PAIRS

            def pairs():
                nonlocal size
                size = 0
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                whole = np.zeros(len(columns[0]), dtype=bool)
                out = pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, whole)], names=names)
                held.clear()
                return out

            held, size = [], 0
            in_short = np.repeat(sizes <= short, sizes)
            for shift in range(1, min(short, int(sizes.max(initial=0)))):
                at = np.flatnonzero((token[shift:] == token[:-shift]) & in_short[shift:])
                if compare(at, at + shift):
                    yield pairs()
            for begin, long in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
                inside = group[begin : begin + long]
                gatherings, times = np.unique(inside, return_counts=True)
                if len(gatherings) > 1:  # rows of the largest gathering need not be compared with each other
                    others = begin + np.flatnonzero(inside != gatherings[times.argmax()])
                    for i in others.tolist():
                        low = begin + np.searchsorted(n[begin : begin + long], -(-percent * n[i] // 100))
                        high = begin + np.searchsorted(n[begin : begin + long], n[i] * 100 // percent, side="right")
                        near = np.arange(low, high)
                        near = near[(inside[near - begin] == gatherings[times.argmax()]) | (near > i)]
                        if compare(np.full(len(near), i), near):
                            yield pairs()
            if held:
                yield pairs()

    names = ["a", "b", "least", "whole"]
    found = ordered.select("token", "node", "n", "classes", "gathering", "crowd").mapInArrow(
        run, "a long, b long, least long, whole boolean")
    a = F.when(F.col("whole"), F.col("a")).otherwise(F.least("a", "b"))
    b = F.when(F.col("whole"), F.col("b")).otherwise(F.greatest("a", "b"))
    return found.groupBy(a.alias("a"), b.alias("b"), "whole").agg(F.count("*").alias("tokens"), F.min("least").alias("least")).where(
        "tokens >= least").select("a", "b", "whole")


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, width: int = 2048):
    """Index pairs whose sets link; without `right`, within `left`. Intersections are products of 0/1 matrices."""
    both = left + (right or [])
    sizes = np.array([len(x) for x in both])
    rows = np.repeat(np.arange(len(both)), sizes)
    flat = np.concatenate([*both, np.empty(0, U64)])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    renumber = np.cumsum(counts > 1) - 1
    rows, column = rows[shared], renumber[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    a, b = len(left), len(both) if right is None else len(right)
    first = 0 if right is None else a
    common = np.zeros((a, b), dtype=np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [begin, begin + width])
        table = np.zeros((len(both), width), dtype=np.float32)
        table[rows[low:high], column[low:high] - begin] = 1
        common += table[:a] @ table[first:].T
    total = sizes[:a, None] + sizes[None, first:]
    hit = (100 + percent) * common >= percent * total
    if right is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def linked(members: DataFrame, texts: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside each canopy.

    `members`: canopy, node, doc_id, n, s1; `texts`: doc_id, text. A canopy's nodes are cut by size to blocks of about
    `block` nodes, fewer of large ones; two blocks meet if their sizes allow a link. A text whose set has not the
    node's sum is another text of the same id.
    """
    by_size = Window.partitionBy("canopy").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.greatest("n", F.lit(BLOCK_TOKENS // block))).over(by_size), F.lit(0))
    placed = cut(members.withColumn("block", F.floor(filled / BLOCK_TOKENS)))
    spans = placed.groupBy("canopy", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    later = spans.select("canopy", F.col("block").alias("other"), F.col("low").alias("other_low"))
    meets = spans.join(later, "canopy").where(
        (F.col("other") >= F.col("block")) & (F.col("other_low") * percent <= F.col("high") * 100))
    units = meets.select("canopy", F.col("block").alias("i"), F.col("other").alias("j"))
    roles = units.select("canopy", F.col("i").alias("block"), "i", "j").unionByName(
        units.where("i != j").select("canopy", F.col("j").alias("block"), "i", "j"))
    shipped = placed.join(texts, "doc_id").join(roles, ["canopy", "block"])
    ordered = shipped.select("canopy", "i", "j", "block", "node", "s1", "text").repartition("canopy", "i", "j")
    ordered = ordered.sortWithinPartitions("canopy", "i", "j", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, 3):
            sides: tuple[list, list] = ([], [])
            last = None
            sets = shingle_sets([t or "" for t in own.column("text").to_pylist()], words)
            first = own.column("block")[0].as_py()
            for x, block_of, node, s1, found in zip(
                    sets, own.column("block").to_pylist(), own.column("node").to_pylist(),
                    own.column("s1").to_pylist(), sums(sets)[0].to_pylist(), strict=True):
                if found == s1 and node != last:
                    sides[block_of != first].append((node, x))
                    last = node
            left, right = sides
            # a unit of two blocks compares only across; each block has a unit of its own
            alone = own.column("i")[0].as_py() == own.column("j")[0].as_py()
            forest = Forest()
            others = left if alone else right
            for i, j in zip(*links_between([x for _, x in left], None if alone else [x for _, x in right], percent),
                            strict=True):
                forest.join(left[i][0], others[j][0])
            if edges := forest.edges():
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()),
                                                  pa.array([y for _, y in edges], pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90, block: int = 256, gather: int = 3,
                       frequent: int = 64, crowded: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest id reachable by links, itself included.

    Columns named in `keep` are returned as well.

    A set holds the distinct n-grams of `words` lower-cased (A-Z) words; fewer words count as one n-gram. Two documents
    link when their sets' similarity reaches `percent` hundredths. Null texts are empty; empty sets link with nothing.
    Rows without doc_id are returned with a null component and link with nothing. Rows that repeat an id are linked
    each by its own text. `gather`, `frequent` and `crowded` change the work, not the result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = stored(signatures(docs.select(rows.columns + list(keep)), words), "signatures")
    named = ["doc_id", "s1", "s2"]
    sets = found.where("doc_id IS NOT NULL AND n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    # nodes are named by their smallest id; where that id names several texts, the others by a hash of their sets
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "s1", "s2"))
    nodes = cut(sets.withColumn("node", F.when(turn == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "s1", "s2"))))

    counts = cut(frequencies(rows, words, percent).where(F.col("n") >= frequent))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(frequent, -(-total // MOST_FREQUENT))  # so that at most MOST_FREQUENT tokens reach it
    often = counts.where(F.col("n") >= limit).select("token").toLocalIterator()
    last = np.sort(np.array([r[0] for r in often], dtype=np.int64).view(U64))

    wide = join_small(prefixes(rows, words, percent, last), nodes.select(*named, "n", "node"), named)
    wide = stored(wide.drop(*named), "prefixes")
    shared = stored(gathered(wide.select(F.explode("first").alias("token"), "node")), "shared")
    classes = wide.select("node", "n", "classes").dropDuplicates(["node"])
    strong = shared.where("node != pivot").groupBy("node", "pivot").count().join(nodes.select("node", "n"), "node").where(
        F.col("count") >= F.greatest(F.lit(gather), F.floor(F.col("n") * (100 - percent) / 300)))
    gathering = components(strong.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    crowds = gathering.groupBy("component").count().where(F.col("count") > crowded).select("component", F.lit(True).alias("crowd"))
    meeting = shared.select("token", "node").join(classes, "node").join(
        join_small(gathering, crowds, "component", "left"), "node", "left").select(
        "token", "node", "n", "classes", F.coalesce("component", "node").alias("gathering"), F.coalesce("crowd", F.lit(False)).alias("crowd"))
    pairs = cut(crossing_pairs(meeting, percent))
    second = wide.select("node", "second")
    met = pairs.where("NOT whole").join(second.toDF("a", "of_a"), "a").join(second.toDF("b", "of_b"), "b").where(
        F.arrays_overlap("of_a", "of_b")).select("a", "b").unionByName(pairs.where("whole").select("a", "b"))
    canopies = components(gathering.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(met))
    members = canopies.withColumnRenamed("component", "canopy").join(nodes, "node")
    # cut, so that a task has one Python worker at a time
    links = cut(linked(members.select("canopy", "node", "doc_id", "n", "s1"), rows, words, percent, block))
    merged = components(links)

    labels = nodes.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = labels.join(smallest, "component").select("n", "s1", "s2", "component_id")
    out = found.select("doc_id", *keep, "n", "s1", "s2").join(by_set, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", *keep, F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents that are linked to one with a smaller id, directly or through others.

    Of rows that repeat id and text one stays. Rows without doc_id stay. Columns are those of `docs`.
    """
    named = docs.withColumn("jaccard_text", F.xxhash64("text"))
    keys = ["doc_id", "jaccard_text"]
    found = cut(jaccard_components(named.select("doc_id", "text", "jaccard_text"), words, percent, keep=("jaccard_text",)))
    surplus = found.where("doc_id != component_id").select(*keys).distinct()
    kept = join_small(named, surplus, keys, "left_anti")
    repeated = found.where("doc_id = component_id").groupBy(*keys).count().where("count > 1").select(*keys)
    if repeated.limit(1).count():
        once = join_small(kept, repeated, keys, "left_semi").dropDuplicates(keys)
        kept = join_small(kept, repeated, keys, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
