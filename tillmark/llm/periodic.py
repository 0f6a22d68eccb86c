"""Periodic runs of words: recursive frequency splitting, then a lag scan of the surviving segments.

A run is a stretch of words with smallest period q that is at least max(shortest, 2 q) words long and that neither
neighbour extends. Inside a run every word occurs at least twice, so a word that occurs once in a segment belongs to no
run of it and splits the segment; the parts are counted anew until no word splits any more, and parts shorter than the
shortest run go. Most texts end there.

The segments that survive are scanned by lags. A run of period q holds a stretch of at least q positions i at which
words i and i + q agree, so one of them is a multiple of q: lag q is looked at there only, which makes m ln m looks in a
segment of m words. How far words agree around such a position is found by halving, over names of all blocks of 2^k
words (equal blocks have equal names), so the result is exact. The names take 4 bytes x words x log2(longest segment).

A text is worked on in one task, together with the other texts of its batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOOKS = 1 << 20  # positions of the lag scan that are looked at together


def coded(texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
    """(words of each text, number of each word over all texts)."""
    known: dict[str, int] = {}
    words = [WORD.findall(text) for text in texts]
    codes = [known.setdefault(w, len(known)) for own in words for w in own]
    return words, np.array(codes, dtype=np.int64)


def surviving(codes: np.ndarray, segment: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, segments) of the words left when no word occurs only once in its segment."""
    place = np.arange(len(codes))
    width = int(codes.max()) + 1 if len(codes) else 1
    while len(place):
        _, same, times = np.unique(segment * width + codes[place], return_inverse=True, return_counts=True)
        fine = times[same] >= 2
        place, segment = place[fine], segment[fine]
        # neighbours of a dropped word come to lie in different segments
        opens = np.flatnonzero(np.diff(place, prepend=-2) + np.diff(segment, prepend=-1) != 1) if len(place) else place
        sizes = np.diff(np.append(opens, len(place)))
        longer = np.repeat(sizes >= shortest, sizes)
        parts = np.repeat(np.arange(len(sizes)), sizes)
        done = fine.all() and longer.all()
        place, segment = place[longer], parts[longer]
        if done:
            break
    return place, segment


def block_names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4... codes from each place on, as far as a segment holds two such blocks."""
    names = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    while (half := 1 << (len(names) - 1)) * 2 < longest and len(names[-1]) > half:
        last = names[-1].astype(np.int64)
        pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
        found, name = np.unique(pairs, return_inverse=True)
        names.append(name.astype(np.int32))
        if len(found) == len(pairs):  # no longer block repeats
            break
    return names


def agreeing(names: list[np.ndarray], at: np.ndarray, lag: np.ndarray, step: int) -> np.ndarray:
    """How many places from `at` on (step 1), or before it (step -1), agree with those a lag later."""
    out = np.zeros(len(at), dtype=np.int64)
    for k in reversed(range(len(names))):
        own, size = names[k], 1 << k
        while True:
            x = at + out if step > 0 else at - out - size
            y = x + lag
            inside = (x >= 0) & (y < len(own))
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            equal = inside & (own[x] == own[y])
            out += size * equal
            if k < len(names) - 1 or not equal.any():  # only the largest block can fit more than once
                break
    return out


def runs_of(codes: np.ndarray, text: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts laid end to end, by start and period."""
    place, segment = surviving(codes, text, shortest)
    if not len(place):
        return place, place, place
    opens = np.flatnonzero(np.diff(segment, prepend=-1))
    sizes = np.diff(np.append(opens, len(place)))
    # segments laid end to end with a code of its own after each, so that nothing agrees across their borders
    laid = place - place[opens].repeat(sizes) + (opens + np.arange(len(opens))).repeat(sizes)
    values = int(codes.max()) + 1 + np.arange(len(place) + len(opens))
    values[laid] = codes[place]
    names = block_names(values, int(sizes.max()))
    first = opens + np.arange(len(opens))
    lags = sizes // 2
    # one row for each segment and lag, and how many places are looked at for it
    owner = np.repeat(np.arange(len(sizes)), lags)
    lag = np.arange(len(owner)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    looks = (sizes[owner] - 1) // lag
    found = []
    ends = np.cumsum(looks)
    begin = 0
    while begin < len(lag):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LOOKS, "right")))
        n, q = looks[begin:end], lag[begin:end]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(q, n)
        at = np.repeat(first[owner[begin:end]], n) + nth * q
        hit = values[at] == values[at + q]
        at, q = at[hit], q[hit]
        left = agreeing(names, at, q, -1)
        once = left < q  # otherwise the place one lag before lies in the same stretch
        at, q, left = at[once], q[once], left[once]
        size = left + agreeing(names, at, q, 1)
        good = size >= np.maximum(shortest - q, q)
        found.append(np.stack([at[good] - left[good], size[good] + q[good], q[good]]))
        begin = end
    start, length, period = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    # a multiple of the smallest period gives the same stretch
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    back = np.zeros(len(values), dtype=np.int64)
    back[laid] = place
    order = np.lexsort((period, start))
    return back[start][order], length[order], period[order]


def with_runs(docs: DataFrame, text: str = "text", shortest: int = 12, runs: str = "runs", words: str = "n_words",
              collapsed: str = "collapsed") -> DataFrame:
    """All columns of `docs` with its runs, its number of words and its collapsed text.

    `runs` is an array of (start, length, period), by start and then period, in words from 0; words are split at ASCII
    white space. The collapsed text drops every word that some run holds after its first period, and joins the others
    by one space. A null text counts as empty: no words, no runs, an empty collapsed text. Repeated rows and null ids
    are kept as they are; rows keep their order. Existing columns of the three names are refused.
    """
    if clash := {runs, words, collapsed} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    position = docs.columns.index(text)
    schema = docs.select("*", F.lit(0).cast("long").alias(words),
                         F.expr("CAST(NULL AS ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>)").alias(runs),
                         F.lit(None).cast("string").alias(collapsed)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, codes = coded([t or "" for t in batch.column(position).to_pylist()])
            counts = np.array([len(own) for own in split], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            start, length, period = runs_of(codes, np.repeat(np.arange(len(counts)), counts), shortest)
            cover = np.zeros(len(codes) + 1, dtype=np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            dropped = np.cumsum(cover) > 0
            kept = []
            for own, a, b in zip(split, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                gone = dropped[a:b]
                kept.append(" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if gone.any() else own))
            owner = np.searchsorted(bounds, start, "right") - 1
            items = pa.StructArray.from_arrays([pa.array(start - bounds[owner]), pa.array(length), pa.array(period)],
                                               names=["start", "length", "period"])
            offsets = pa.array(np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts), pa.ListArray.from_arrays(offsets, items), pa.array(kept, pa.string())],
                names=schema.names)

    return docs.mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten (by crc32 of the decimal id) its words with a repeated tail.

    h = crc32, g = floor(h / 10): where h % 10 = 0, each word i >= a = g % n becomes word a + (i - a) % p, with
    p = 1 + floor((n - a) / (3 + g % 8)). A null id is left alone.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)

    def tail(own: Column) -> Column:
        n, g = F.size(own).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.slice(own, 1, a.cast("int")), F.transform(
            F.sequence(a, n - 1), lambda i: F.get(own, (a + (i - a) % p).cast("int"))))

    replaced = F.get(F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, tail(own)).otherwise(text)), F.lit(0))
    return F.when(h % 10 == 0, replaced).otherwise(text)


def report(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of (doc_id, text).

    The run shown is the longest; ties go to the smallest start, then period. No run gives nulls.
    """
    found = with_runs(docs.select("doc_id", "text"), shortest=shortest)
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    shown = found.withColumn("best", best)
    length = -F.col("best.shortness")
    return shown.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.concat_ws("\n", lines), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
