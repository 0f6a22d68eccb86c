import random

import numpy as np
import pytest

from tests.llm.helpers import awkward, brute_components, cluttered, nothing
from tillmark.llm.components import components
from tillmark.llm.jaccard import CLASSES, crossing_pairs, jaccard_components, least_common, one_of_each, prefix_length
from tillmark.llm.wordhash import shingle_sets


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def planted(seed, copies=40):
    """Random texts, chains of edited copies, exact copies, shared passages, and one large group of near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows, at = [], 0

    def add(text):
        nonlocal at
        rows.append((at, text))
        at += 1

    for _ in range(60):
        text = rng.choices(words, k=rng.randint(1, 120))
        add(" ".join(text))
        for _ in range(rng.randint(0, 3)):
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            add(" ".join(text))
    for _ in range(30):
        add(passage + " " + " ".join(rng.choices(words, k=rng.randint(0, 80))))
    base = rng.choices(words, k=100)
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(100)] = rng.choice(words)
        add(" ".join(text))
    return rows


@pytest.mark.parametrize("seed,words,percent", [(1, 3, 90), (2, 5, 80)])
def test_equals_brute_force(spark, seed, words, percent):
    rows = planted(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, words, percent)
    # small blocks and low limits so that every path is taken
    assert found(jaccard_components(docs, words, percent, block=8, gather=2, frequent=5)) == want
    assert found(jaccard_components(docs, words, percent)) == want


@pytest.mark.parametrize("seed,words,percent,gather", [(3, 3, 90, 2), (4, 5, 80, 60)])
def test_crowded_gatherings_lose_no_link(spark, seed, words, percent, gather):
    rows = planted(seed, copies=70)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, words, percent)
    for crowded in (0, 1, 4):
        assert found(jaccard_components(docs, words, percent, gather=gather, frequent=200, crowded=crowded)) == want


def test_crowded_gatherings_meet_as_a_whole(spark):
    """Pairs of two gatherings of near copies would grow with the square of their size."""
    nodes = spark.range(240).selectExpr("id AS node", "100 AS n", f"cast(repeat('a', {CLASSES}) AS binary) AS classes",
                                        "id % 2 AS gathering", "true AS crowd")
    rows = spark.range(20).selectExpr("id AS token").crossJoin(nodes).select("token", "node", "n", "classes", "gathering", "crowd")
    rows = rows.select(*[rows[c].cast("long") if c in ("n", "gathering") else rows[c] for c in rows.columns])
    met = crossing_pairs(rows, 80).collect()
    assert sorted((r["a"], r["b"]) for r in met) == [(i, 1) for i in range(0, 240, 2)]
    assert all(r["whole"] for r in met)
    apart = rows.withColumn("n", rows["n"] + 100 * rows["gathering"])
    assert crossing_pairs(apart, 80).count() == 0  # their sizes allow no link


def test_least_common_tokens_of_a_range_of_sizes():
    for percent in (80, 90):
        for n in range(1, 120):
            fit = np.arange(-(-percent * n // 100), n * 100 // percent + 1)
            values = least_common(np.full(len(fit), n), fit, percent)
            for end in range(1, len(fit) + 1):
                assert min(values[0], values[end - 1] - 1) <= values[:end].min()


def test_awkward_rows(spark):
    docs = cluttered(awkward(spark))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(jaccard_components(docs)) == brute_components(rows, 3, 90)


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d"), (4, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard_components(docs)) == brute_components(rows, 3, 90)


def test_empty_table(spark):
    assert found(jaccard_components(nothing(spark))) == []
    assert one_of_each(nothing(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 5, 6, 7, 8, 9, None]


def test_prefix_length_reaches_every_link():
    for percent in (80, 90):
        for n in range(1, 300):
            least = -(-percent * n // 100)  # shared tokens of a link
            assert prefix_length(n, percent) == n - least + 1


def test_word_sets_follow_the_texts():
    texts = ["A b\tC d", "a B c\nd", "", "x", "Ä b c", "ä b c", "a b c d"]
    sets = shingle_sets(texts, 3)
    assert np.array_equal(sets[0], sets[1])  # only A-Z are lower-cased, only ASCII white space separates
    assert [len(s) for s in sets] == [2, 2, 0, 1, 1, 1, 1]
    assert not np.array_equal(sets[4], sets[5])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (103, 103)], "a long, b long")
    labels = {r["node"]: r["component"] for r in components(edges.repartition(7)).collect()}
    assert all(labels[i] == 0 for i in range(51))
    assert labels[101] == 100 and 103 not in labels
