"""Toxicity by a learned lexicon, a Levenshtein automaton over its trie, and the context of each hit.

The lexicon comes from labelled texts: words and word beginnings (stems) that occur far more often in toxic ones. Its
trie and the Levenshtein automaton are intersected once into one table of states (sets of trie nodes with the edits
spent), so that a batch's new words are matched by one table step per character, exact or misspelled alike. A large
lexicon has several tables, each for a run of its sorted terms. Letters written as digits or signs count as the letters. Each hit weighs by its window: inside quotation marks or after a reporting
word it is likely a quotation and counts for less. A logistic regression of the weighted sums gives the score.

The labelled texts are a bounded sample (`sample_rows` rows by the hash of their ids); every text is scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import cut, labelled_side, send, stored

LEET = str.maketrans("013457@$", "oieastas")
REPORTING = frozenset("said says wrote called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
OPENING, CLOSING, PLAIN = "“„«‹", "”“»›", "\"'"
SHORTEST, LONGEST = 3, 16
GROUP = 150
WORD_TABLE = np.array([chr(c).isalnum() or chr(c) in "@$" if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])
PARTS = ("exact", "misspelled")


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


def folded(text: str) -> str:
    """Lower case, one character for each of the text's, letters for look-alike digits and signs."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(LEET)


def spans(folded_text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, begin and end of each word)."""
    points = np.frombuffer(folded_text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.where(points < 1 << 16, WORD_TABLE[np.minimum(points, 0xFFFF)], True)
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return points, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def forms(text: str) -> set[str]:
    """Words (with an end mark) and their beginnings."""
    low = folded(text)
    _, begin, end = spans(low)
    words = {low[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b - a >= SHORTEST}
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + "\0" for w in words}


class Automaton:
    """The trie of the lexicon and the Levenshtein automata of its terms as one deterministic table.

    A term that ends with an end mark must match the whole word; the others match a beginning of it.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        nodes: list[dict] = [{}]
        ends: dict[int, list[int]] = {}
        depth_limit = [0]
        for t, term in enumerate(terms):
            letters, node = term.rstrip("\0"), 0
            limit = allowed_edits(len(letters))
            depth_limit[0] = max(depth_limit[0], limit)
            for letter in letters:
                if letter not in nodes[node]:
                    nodes[node][letter] = len(nodes)
                    nodes.append({})
                    depth_limit.append(0)
                node = nodes[node][letter]
                depth_limit[node] = max(depth_limit[node], limit)
            ends.setdefault(node, []).append(t)
        letters = sorted({c for term in terms for c in term.rstrip("\0")})
        self.classes = np.zeros(1 << 16, np.int64)  # 0: a letter of no term
        for i, c in enumerate(letters):
            if ord(c) < 1 << 16:
                self.classes[ord(c)] = i + 1
        alphabet = [None, *letters]

        def closed(states: dict[int, int]) -> frozenset:
            """With skipped letters of terms; node -> fewest edits."""
            todo = list(states.items())
            while todo:
                node, spent = todo.pop()
                for child in nodes[node].values():
                    if spent + 1 <= depth_limit[child] and spent + 1 < states.get(child, 9):
                        states[child] = spent + 1
                        todo.append((child, spent + 1))
            return frozenset(states.items())

        def step(states: frozenset, letter: str | None) -> frozenset:
            out: dict[int, int] = {}

            def reach(node, spent):
                if spent <= depth_limit[node] and spent < out.get(node, 9):
                    out[node] = spent

            for node, spent in states:
                reach(node, spent + 1)  # an additional letter
                for own, child in nodes[node].items():
                    reach(child, spent + (own != letter))
            return closed(out)

        def hits(states: frozenset) -> list[tuple[int, int]]:
            return [(spent, t) for node, spent in states for t in ends.get(node, ())
                    if spent <= allowed_edits(len(terms[t].rstrip("\0")))]

        start = closed({0: 0})
        # a state also remembers the best stem matched so far; state 0 is dead
        number: dict[tuple, int] = {(frozenset(), None): 0, (start, None): 1}
        order, rows = [(frozenset(), None), (start, None)], []
        at = 0
        while at < len(order):
            states, best = order[at]
            row = []
            for letter in alphabet:
                to = step(states, letter) if states else states
                stems = [h for h in hits(to) if not terms[h[1]].endswith("\0")]
                key = (to, min([*stems, *([best] if best else [])], default=None))
                if key not in number:
                    number[key] = len(order)
                    order.append(key)
                row.append(number[key])
            rows.append(row)
            at += 1
        self.table = np.array(rows, dtype=np.int32)
        final = [min([*hits(states), *([best] if best else [])], default=None) for states, best in order]
        self.edits = np.array([f[0] if f else -1 for f in final])
        self.term = np.array([f[1] if f else -1 for f in final])
        # states that no further letter leaves need no more steps
        self.fixed = (self.table == np.arange(len(order))[:, None]).all(axis=1)

    def match(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(word numbers, terms, edits) of the words that match."""
        state = np.ones(len(begin), np.int32)
        live, depth = np.arange(len(begin)), 0
        classes = self.classes[np.minimum(points, 0xFFFF)]
        while len(live):
            state[live] = self.table[state[live], classes[begin[live] + depth]]
            depth += 1
            live = live[(end[live] - begin[live] > depth) & ~self.fixed[state[live]]]
        hit = np.flatnonzero(self.edits[state] >= 0)
        return hit, self.term[state[hit]], self.edits[state[hit]]


class Automata:
    """One automaton for each run of `group` sorted terms: their size grows with the number of terms, not faster."""

    def __init__(self, terms: list[str], group: int = GROUP):
        self.terms, self.longest = terms, max(map(len, terms))
        self.parts = [(at, Automaton(terms[at : at + group])) for at in range(0, len(terms), group)]

    def match(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(word numbers, terms, edits) of the words that match; of several terms the first of the fewest edits."""
        term, fewest = np.full(len(begin), -1), np.full(len(begin), 9)
        for at, part in self.parts:
            hit, own, edits = part.match(points, begin, end)
            better = edits < fewest[hit]
            hit = hit[better]
            term[hit], fewest[hit] = own[better] + at, edits[better]
        hit = np.flatnonzero(term >= 0)
        return hit, term[hit], fewest[hit]


def context_weight(text: str, begin: int, end: int, quoted_weight: float, window: int = 60) -> float:
    """1 for a hit that stands for itself, `quoted_weight` for one that seems to be quoted."""
    before, after = text[max(0, begin - window) : begin], text[end : end + window]
    before = before[before.rfind("\n") + 1 :]
    after = after.split("\n", 1)[0]
    plain = any(before.count(q) % 2 and q in after for q in PLAIN if q != "'")
    opened = max(before.rfind(q) for q in OPENING)
    directed = opened >= 0 and opened > max((before.rfind(q) for q in CLOSING if q not in OPENING), default=-1) and any(
        q in after for q in CLOSING)
    reported = bool(REPORTING.intersection(before.lower().replace(":", " ").split()[-3:]))
    return quoted_weight if plain or directed or reported else 1.0


class Model:
    def __init__(self, automaton: Automata | None, trusted: np.ndarray | None, weights: np.ndarray, quoted_weight: float):
        self.automaton, self.trusted, self.weights, self.quoted_weight = automaton, trusted, weights, quoted_weight
        self.known: dict[str, tuple[int, int] | None] = {}

    def found(self, texts: list[str]):
        """For each hit: number of the text, term, edits, weight by context."""
        reach = self.automaton.longest + 3  # what follows in a longer word changes nothing
        split = []
        for text in texts:
            low = folded(text)
            _, begin, end = spans(low)
            split.append([(low[a : min(b, a + reach)], a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        self.learn_words({word for own in split for word, _, _ in own})
        for i, own in enumerate(split):
            for word, a, b in own:
                if match := self.known[word]:
                    yield i, *match, context_weight(texts[i], a, b, self.quoted_weight)

    def learn_words(self, words: set[str], limit: int = 300_000) -> None:
        """Matches of the words, each found once; the memory is emptied when it is full, which changes no result."""
        if len(self.known) > limit:
            self.known.clear()
        missing = list(words - self.known.keys())
        points, begin, end = spans(" ".join(missing))
        self.known.update(dict.fromkeys(missing))
        for h, t, e in zip(*(x.tolist() for x in self.automaton.match(points, begin, end)), strict=True):
            self.known[missing[h]] = (t, e)

    def features(self, texts: list[str]) -> np.ndarray:
        sums = np.zeros((len(texts), len(PARTS)))
        if self.automaton is not None:
            for i, t, e, weight in self.found(texts):
                if self.trusted is None or self.trusted[t, min(e, 1)]:
                    sums[i, min(e, 1)] += weight
        return np.log1p(sums)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.weights[0] + self.features(texts) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chosen_terms(positive: dict[str, int], negative: dict[str, int], toxic: int, clean: int, tested: int,
                 precision: float) -> list[str]:
    """Terms of high precision that chance among `tested` forms does not explain; of nested ones a single one."""
    rate = toxic / (toxic + clean)
    good = {}
    for term, p in positive.items():
        n = p + negative.get(term, 0)
        share = min(p / n, 1 - 1e-9)
        gain = n * (share * math.log(share / rate) + (1 - share) * math.log((1 - share) / (1 - rate))) if share > rate else 0
        if (p + 0.5) / (n + 1) >= precision and gain >= math.log(max(tested, 1) / 0.05):
            good[term] = p
    kept: dict[str, int] = {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        shorter = next((term[:k] for k in range(len(term) - 1, 0, -1) if term[:k] in kept), None)
        if shorter is None:
            kept[term] = good[term]
        elif good[term] >= 0.9 * kept[shorter]:  # the longer form says the same more precisely
            del kept[shorter]
            kept[term] = good[term]
    return sorted(kept)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, precision: float = 0.8,
          quoted_weight: float = 0.25) -> Model:
    """A model from at most `sample_rows` labelled texts; labels on the held-out side are not read."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(labelled_side()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = stored(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int")), "labelled")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    rate = (toxic + 0.5) / (toxic + clean + 1) if toxic else 0.0
    none = Model(None, None, np.array([math.log(max(rate, 1e-6) / (1 - min(rate, 1 - 1e-6))), 0.0, 0.0]), quoted_weight)
    if not toxic or not clean:
        return none

    def counted(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    counts.update(forms(text))
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())},
                                             schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

        return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    found = cut(counted(texts.where("toxic = 1")))
    tested = found.count()
    # rarer forms fail the test against chance even if no clean text has them
    least = max(3, math.floor(math.log(max(tested, 1) / 0.05) / -math.log(toxic / (toxic + clean))))
    others = counted(texts.where("toxic = 0")).select("term", F.col("n").alias("other"))
    pairs = found.where(F.col("n") >= least).join(others, "term", "left").fillna(0, ["other"])
    precise = pairs.where((F.col("n") + 0.5) / (F.col("n") + F.col("other") + 1) >= precision).collect()
    terms = chosen_terms({r["term"]: r["n"] for r in precise}, {r["term"]: r["other"] for r in precise}, toxic, clean, tested,
                         precision)
    if not terms:
        return none
    draft = Model(Automata(terms), None, np.zeros(3), quoted_weight)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labelled = batch.column(1).to_pylist()
            rows = {(i, t, min(e, 1)) for i, t, e, _ in draft.found(batch.column(0).to_pylist())}
            counts = Counter((t, e, labelled[i]) for i, t, e in rows)
            yield pa.RecordBatch.from_pylist([{"term": t, "edits": e, "toxic": y, "n": n} for (t, e, y), n in counts.items()],
                                             pa.schema([("term", pa.int32()), ("edits", pa.int32()), ("toxic", pa.int32()),
                                                        ("n", pa.int64())]))

    # a term's misspellings count only if they are not words of clean texts
    tally = texts.select("text", "toxic").mapInArrow(hits, "term int, edits int, toxic int, n long").groupBy(
        "term", "edits", "toxic").agg(F.sum("n").alias("n")).collect()
    sides = np.zeros((len(terms), 2, 2))
    for row in tally:
        sides[row["term"], row["edits"], row["toxic"]] = row["n"]
    trusted = (sides[:, :, 1] + 0.5) / (sides.sum(axis=2) + 0.6) >= precision
    draft.trusted = trusted

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = draft.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)],
                                             names=["exact", "misspelled", "toxic"])

    table = texts.select("text", "toxic").mapInArrow(rows, "exact double, misspelled double, toxic int").toArrow()
    x = np.column_stack([table.column("exact").to_numpy(), table.column("misspelled").to_numpy()])
    weights = fitted(x, table.column("toxic").to_numpy().astype(float))
    if not x[:, 1].any():  # no misspelling to learn from: somewhat weaker evidence than the term itself
        weights[2] = 0.8 * weights[1]
    return Model(draft.automaton, trusted, weights, quoted_weight)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of `docs` and the score from 0 to 1 of the whole text.

    Null texts count as empty; an empty text has the score of a text without hits. Rows stay as they are; an existing
    column of that name is refused.
    """
    if name in docs.columns:
        raise ValueError(f"column exists already: {name}")
    wide = docs.withColumn(name, F.lit(0.0))
    position, names = docs.columns.index(text), wide.columns
    sent = send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.scores([t or "" for t in batch.column(position).to_pylist()])
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(found)], names=names)

    return wide.mapInArrow(run, wide.schema)
