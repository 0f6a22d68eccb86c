"""Collocations equal those of a brute force and of the SQL; colliding fingerprints; awkward rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, cluttered, nothing
from tillmark.llm import phrases, queries


def brute(rows, least=100, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        if any(other[0] == lang and b >= a and len(other[1]) > len(words)
               and any(other[1][i : i + len(words)] == words for i in range(len(other[1]))) for other, b in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def texts(seed, rows=60):
    draw = random.Random(seed)
    out = []
    for _ in range(rows):
        words = [draw.choice(["The", "the", "red", "fox", "é", "b-c", "x"]) for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(4)):
            words += ["new", "york", "city", "hall"]
        text = "".join(w + draw.choice([" ", " ", " ", "\t", ". ", "\n", "; "]) for w in words)
        out.append((text, draw.choice(["en", "en", "fr", None, ""])))
    return out + [(None, "en"), ("", None), ("a a a a a a a", "en")] + [("Same line here again", "de")] * 9


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rows = texts(seed)
    docs = cluttered(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    for least, longest, top in ((5, 5, 2000), (8, 4, 12), (3, 2, 5)):
        got = collected(phrases.collocations(docs, least, longest, top))
        assert got == brute(rows, least, longest, top) and got


def test_phrases_of_one_fingerprint_are_counted_apart(spark, monkeypatch):
    """With fingerprints of four values nearly everything collides; the counts stay those of the texts."""
    rows = texts(3)
    batch = spark.createDataFrame(rows, "text string, lang string").toArrow().to_batches()
    monkeypatch.setattr(phrases, "PART", 700)
    want, got = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").lower()):
            words = piece.split()
            want.update(("und" if lang is None else lang, " ".join(p).encode()) for p in zip(words, words[1:]))
    for part in phrases.read(batch):
        at = np.flatnonzero(part.starts(2))
        got.update(dict(part.grouped(at, 2, part.fingerprints(at, 2) & phrases.U64(3))))
    assert got == want
    docs = spark.createDataFrame(rows, "text string, lang string")
    small = phrases.frequent_phrases(docs, 5, most_bits=1 << 8)[0]
    large = phrases.frequent_phrases(docs, 5)[0]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_whole_table_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = collected(queries.op12_collocations(spark, folder))
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.SQL['op12_collocations']})").fetchall()
    assert got == sorted(want) and got


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "PART", 16)
    text = "one two three. four five six seven eight nine ten eleven; a b c d, " * 5
    batch = pa.RecordBatch.from_pydict({"text": ["x y", text, None, ""], "lang": ["en", "fr", "en", None]})
    parts = list(phrases.read([batch]))
    assert len(parts) > 10
    words = [w for part in parts for w in part.bytes.tobytes().decode().split()]
    assert words == ["x", "y", *re.findall(r"[a-z]+", text)]
    fours = sum(int(part.starts(4).sum()) for part in parts)
    assert fours == 5 * (0 + 5 + 1)


def test_large_counts_are_exact(spark):
    whole = "CAST({} AS DECIMAL(19, 0))".format
    rows = spark.createDataFrame([(3_000_000_000_000, 9_000_000_000_000, 3_000_000_000_001, 3_000_000_000_003)],
                                 "a long, n long, l long, r long")
    got = rows.selectExpr(f"({whole('1000 * a')} * {whole('n')}) div ({whole('l')} * {whole('r')}) AS s").first()["s"]
    assert got == 1000 * 3_000_000_000_000 * 9_000_000_000_000 // (3_000_000_000_001 * 3_000_000_000_003)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert collected(phrases.collocations(cluttered(docs), least=2)) == brute(rows, 2)
    assert phrases.collocations(nothing(spark)).count() == 0
    assert phrases.collocations(docs, least=10**9).count() == 0
