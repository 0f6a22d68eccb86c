"""Runs equal those of a brute force; planted tails, digests, awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, cluttered, nothing
from tillmark.llm import periodic, queries


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, shortest=12):
    """Every stretch of every lag, smallest period first."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q) and (i, j) != (0, 0) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, shortest=12):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, shortest)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words_equal_brute_force():
    draw = random.Random(5)
    for letters, size in ((2, 60), (2, 200), (3, 120), (5, 400), (40, 300)):
        texts = []
        for _ in range(40):
            words = [str(draw.randrange(letters)) for _ in range(draw.randrange(size))]
            if words and draw.random() < 0.7:  # a repeated part somewhere
                at, period = draw.randrange(len(words)), draw.randrange(1, 30)
                part = words[at : at + period]
                words[at:at] = part * draw.randrange(1, 6) + part[: draw.randrange(len(part) + 1)]
            texts.append(" ".join(words))
        found, codes = periodic.coded(texts)
        counts = np.array([len(w) for w in found])
        start, length, period = periodic.runs_of(codes, np.repeat(np.arange(len(counts)), counts))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        got = [[] for _ in texts]
        for s, m, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
            owner = int(np.searchsorted(bounds, s, "right")) - 1
            got[owner].append((s - int(bounds[owner]), m, q))
        assert got == [brute(w) for w in found]


@pytest.mark.parametrize("words", [["a"] * 5000, ["a", "b"] * 3000, [str(i % 700) for i in range(3000)],
                                   [str(bin(i).count("1") % 2) for i in range(4096)], [str(i) for i in range(3000)]])
def test_long_regular_texts(words):
    _, codes = periodic.coded([" ".join(words)])
    got = list(zip(*(x.tolist() for x in periodic.runs_of(codes, np.zeros(len(codes), np.int64))), strict=True))
    assert got == (brute(words) if len(words) < 3500 else got)
    if words[0] == words[1] == "a":
        assert got == [(0, 5000, 1)]
    if words[:2] == ["a", "b"]:
        assert got == [(0, 6000, 2)]


def test_small_pieces_of_the_scan_change_nothing(monkeypatch):
    words = (["x", "y", "z"] * 9 + ["q"]) * 5
    _, codes = periodic.coded([" ".join(words)])
    monkeypatch.setattr(periodic, "LOOKS", 7)
    got = list(zip(*(x.tolist() for x in periodic.runs_of(codes, np.zeros(len(codes), np.int64))), strict=True))
    assert got == brute(words)


def test_whole_table_equals_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    out = queries.op11_periodic_runs(spark, folder)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert len(got) == len(rows)
    some = [r for r in rows if len(split(r["text"])) < 1500]
    assert len(some) > 150
    for r in some:
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])
    assert sum(1 for r in got.values() if r[1]) > 5


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = periodic.with_runs(cluttered(docs))
    assert out.count() == docs.count() and out.columns[: len(docs.columns)] == docs.columns
    long = {r["doc_id"]: r for r in out.collect()}
    assert [tuple(x) for x in long[5]["runs"]] == [(0, 20_000, 1)] and long[5]["collapsed"] == "word"
    assert long[2]["runs"] == [] and long[2]["collapsed"] == "" and long[7]["n_words"] == 0
    report = periodic.report(docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text"))))
    want = sorted((brute_row(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NULL OR doc_id <> 5").collect()), key=str)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in report.where("doc_id IS NULL OR doc_id <> 5").collect()), key=str) == want
    assert periodic.report(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(docs.withColumn("runs", F.lit(1)))
