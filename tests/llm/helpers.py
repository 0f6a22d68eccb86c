"""Small tables with awkward rows, and brute-force twins of the operators."""

import itertools
import re

LONG = "word " * 20_000
AWKWARD = [
    (1, "One two three four five six.", "en", "a", 28), (2, None, "en", "a", None), (3, "", None, None, 0),
    (4, "One two three four five six.", "en", "a", 28), (4, "One two three four five six.", "en", "a", 28),
    (None, "no id here", "en", "b", 10), (5, LONG, "en", "b", len(LONG)), (6, "Été\n\nétoile  double", "fr", "", 20),
    (7, " \t\n ", "de", "a", 4), (8, "x", "de", "c", 1), (9, "tab\tand \nfeed \n both", "en", "c", 20),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SHAPE)


def nothing(spark):
    return spark.createDataFrame([], SHAPE)


def cluttered(docs):
    """With columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["bucket", "guest", "node", "n", "row", "kind", "component", "token", "label", "rank", "cell", "part", "opens"]
    return docs.withColumns({name: F.lit("clash") for name in names})


def word_set(text, n):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    size = min(n, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, n, percent):
    """(doc_id, set size, smallest id reachable) of rows (doc_id, text)."""
    sets = [word_set(text, n) for _, text in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
            continue
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return sorted(((doc, len(sets[i]), None if doc is None else smallest[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)
