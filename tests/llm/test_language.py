"""Predictions equal those of a brute force; packed numbers; held-out accuracy; awkward rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, cluttered, nothing
from tillmark.llm import language, queries
from tillmark.llm.language import WORD


def grams(word, n):
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def brute(rows, longest=4, alpha=0.5):
    """(lang_pred, score) of rows (doc_id, text, lang)."""
    counts = defaultdict(Counter)
    for doc, text, lang in rows:
        if doc is not None and lang is not None and zlib.crc32(str(doc).encode()) % 3 != 1:
            for w in WORD.findall((text or "").lower()):
                counts[w][lang] += 1
    totals = Counter()
    for by_lang in counts.values():
        totals.update(by_lang)
    names = sorted(totals, key=lambda x: (-totals[x], x))
    floor = alpha * len(totals) / max(1, sum(totals.values()))
    tables = {}
    for n in range(1, longest + 1):
        own = defaultdict(Counter)
        for w, by_lang in counts.items():
            for g in grams(w, n):
                own[g].update(by_lang)
        sums = Counter()
        for by_lang in own.values():
            sums.update(by_lang)
        tables[n] = own, sums, alpha * len(sums) / max(1, sum(sums.values()))

    def score(w):
        if w in counts:
            return {x: math.log1p(c / totals[x] / floor) for x, c in counts[w].items()}
        for n in range(longest, 0, -1):
            own, sums, low = tables[n]
            known = [g for g in grams(w, n) if g in own]
            if known:
                out = Counter()
                for g in known:
                    for x, c in own[g].items():
                        out[x] += math.log1p(c / sums[x] / low) / len(known)
                return out
        return {}

    out = []
    for doc, text, _ in rows:
        if not names or not any(c.isalpha() for c in text or ""):
            out.append((doc, "und", 0.0))
            continue
        total = dict.fromkeys(names, 0.0)
        for w in WORD.findall((text or "").lower()):
            for x, v in score(w).items():
                total[x] += v
        best = max(names, key=lambda x: total[x])
        out.append((doc, best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 1e-4


def answers(df):
    return [(r["doc_id"], r["lang_pred"], r["score"]) for r in df.select("doc_id", "lang_pred", "score").collect()]


def test_packed_numbers_come_back():
    draw = random.Random(1)
    parts = [[draw.choice([0, 1, 127, 128, 300, 1 << 14, 1 << 40]) for _ in range(draw.randrange(5))] for _ in range(50)]
    values, ends = np.array([v for p in parts for v in p], np.int64), np.cumsum([len(p) for p in parts])
    back, sizes = language.unpacked(language.packed(values, ends))
    assert back.tolist() == values.tolist() and sizes.tolist() == [len(p) for p in parts]
    assert language.unpacked([b"", b""])[1].tolist() == [0, 0]


@pytest.mark.parametrize("block_chars", [1, 300, 1 << 25])
def test_predictions_equal_brute_force(spark, block_chars):
    draw = random.Random(block_chars)
    syllables = {"en": ["th", "er", "ing", "o"], "fr": ["eau", "ez", "é", "o"], "日": ["日", "本", "語"], "": ["x", "o"]}
    rows = []
    for i in range(120):
        lang = draw.choice(list(syllables))
        words = ["".join(draw.choice(syllables[lang]) for _ in range(draw.randrange(1, 5))) for _ in range(draw.randrange(12))]
        rows.append((i, " ".join(words).title(), lang if i % 7 else None))
    rows += [(200, "42 + 7", "en"), (201, None, "en"), (202, "ǆǆǆ", None), (None, "the thing", "en"), (1, rows[1][1], rows[1][2]),
             (203, "a" * 100, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    same(answers(language.identify(cluttered(docs), ["doc_id", "bucket"], block_chars=block_chars)), brute(rows))


def test_held_out_accuracy(spark, folder):
    out = queries.op13_language(spark, folder)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    joined = out.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(joined) == docs.count()
    held = [r for r in joined if r["held_out"]]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in joined)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    same(answers(language.identify(docs, ["doc_id", "source"])), brute(rows))
    assert language.identify(nothing(spark), ["doc_id"]).count() == 0
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(untaught, ["doc_id"]).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("score", F.lit(1)), ["score"])
    with pytest.raises(ValueError):
        language.identify(docs, ["doc_id"], most_langs=1)
