"""Frequent phrases of two to five words and how firmly their words belong together.

Texts are cut into pieces at punctuation and line ends, pieces into words; A-Z are lower-cased. Everything is counted per
language. Each length is one pass over the texts: a prefix polynomial over the bytes of the words, modulo 2^64, gives the
fingerprint of every n-gram in numpy, and the shuffle adds up how often each fingerprint occurs. An n-gram is only counted
if both its (n-1)-grams may be frequent.

What may be frequent is a bit map over fingerprints. Its size is bounded, and it errs on one side only: a bit set by
another fingerprint lets rows through that the later counts remove, at any size of the corpus.

A last pass groups the occurrences of the frequent fingerprints, each group with a pointer to one of them in the text, and
compares the bytes of every occurrence with those at the pointer, so that phrases of one fingerprint are counted apart.
The pointers give the words of each group, and the counts are added up by language and text. So only frequent phrases ever
become texts, and the counts returned belong to texts, not to fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import cut, join_small, send
from tillmark.llm.wordhash import U64, mix, powers

#: A-Z to a-z, the characters that end a piece to a line feed, the tab to a space.
FOLDED = bytes(0x0A if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else b + 32 if 65 <= b <= 90 else b
               for b in range(256))
PART = 1 << 20  # bytes of text hashed together
HELD = 1 << 22  # n-grams a task holds before it groups them
NO_LANGUAGE = "und"


class Part:
    """Some texts, or some pieces of a long one: their words laid end to end, each with one space after it."""

    def __init__(self, data: bytes, begins: list[int], langs: list[str]):
        """`begins` are the places at which texts begin, `langs` their languages."""
        raw = np.frombuffer(data + b"\n", dtype=np.uint8)
        ends_piece = raw == 0x0A
        inside = ~(ends_piece | (raw == 0x20))
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.langs = sorted(set(langs))
        places = np.array([self.langs.index(lang) for lang in langs], dtype=np.int64)
        self.lang = places[np.searchsorted(begins, start, "right") - 1]
        self.piece = np.cumsum(ends_piece, dtype=np.int64)[start]
        self.end = np.cumsum(end - start + 1) - 1
        self.start = self.end - (end - start)
        inside[end] = True
        self.bytes = raw[inside]
        self.bytes[self.end] = 0x20
        power, self.inverse = powers(len(self.bytes) + 1)
        self.sums = np.zeros(len(self.bytes) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum((self.bytes.astype(U64) + U64(1)) * power[: len(self.bytes)], out=self.sums[1:])
        self.seeds = np.array([int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                               for lang in self.langs], dtype=U64)

    def starts(self, n: int) -> np.ndarray:
        """Is there an n-gram within one piece from each word on?"""
        out = np.zeros(len(self.start), dtype=bool)
        last = len(self.start) - n + 1
        if last > 0:
            out[:last] = self.piece[:last] == self.piece[n - 1 :]
        return out

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the bytes from the first word of each n-gram to its last, and its language."""
        first, last = self.start[at], self.end[at + n - 1]
        with np.errstate(over="ignore"):
            value = (self.sums[last] - self.sums[first]) * self.inverse[first] + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93)
            return mix(value ^ mix(self.seeds + U64(n))[self.lang[at]])

    def grouped(self, at: np.ndarray, n: int, prints: np.ndarray) -> list[tuple[tuple[str, bytes], int]]:
        """((language, phrase), count) of the n-grams at `at`: their bytes decide, fingerprints only bring them together."""
        _, pointer, group, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        first, size = self.start[at], self.end[at + n - 1] - self.start[at]
        pointed = pointer[group]
        same = (size == size[pointed]) & (self.lang[at] == self.lang[at[pointed]])
        if same.all():
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = self.bytes[np.repeat(first, size) + within] == self.bytes[np.repeat(first[pointed], size) + within]
        data = self.bytes.tobytes()

        def named(i: np.ndarray) -> list[tuple[str, bytes]]:
            spans = zip(self.lang[at[i]].tolist(), first[i].tolist(), (first[i] + size[i]).tolist(), strict=True)
            return [(self.langs[k], data[a:b]) for k, a, b in spans]

        if same.all():
            return list(zip(named(pointer), counts.tolist(), strict=True))
        return list(Counter(named(np.arange(len(at)))).items())


class Bits:
    """Which fingerprints may be frequent."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def has(self, prints: np.ndarray) -> np.ndarray:
        bit = prints & U64(len(self.cells) * 64 - 1)
        return (self.cells[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Parts of about PART bytes of the batches of (text, lang); long texts are cut at the end of a piece."""
    for batch in batches:
        held, begins, langs, size = [], [], [], 0
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, at = (text or "").encode("utf-8", "surrogatepass").translate(FOLDED), 0
            lang = NO_LANGUAGE if lang is None else lang
            while at < len(data):
                end = len(data)
                if end - at > PART:
                    end = data.rfind(b"\n", at, at + PART) + 1 or data.find(b"\n", at + PART) + 1 or len(data)
                held.append(data[at:end])
                begins.append(size)
                langs.append(lang)
                size += end - at + 1
                at = end
                if size >= PART:
                    yield Part(b"\n".join(held), begins, langs)
                    held, begins, langs, size = [], [], [], 0
        if held:
            yield Part(b"\n".join(held), begins, langs)


def counted_texts(texts: DataFrame, text: str, lang: str, bits: dict[int, Broadcast], held: int = 1 << 18) -> DataFrame:
    """(lang, phrase, f) of the n-grams whose fingerprints may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bytes], int] = {}

        def rows():
            keys = list(counts)
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([k[0] for k in keys], pa.string()),
                "phrase": pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                "f": pa.array(list(counts.values()), pa.int64())})

        for part in read(batches):
            for n, known in bits.items():
                at = np.flatnonzero(part.starts(n))
                prints = part.fingerprints(at, n)
                fine = known.value.has(prints)
                for key, f in part.grouped(at[fine], n, prints[fine]):
                    counts[key] = counts.get(key, 0) + f
                if len(counts) > held:
                    yield rows()
                    counts.clear()
        yield rows()

    found = texts.select(text, lang).mapInArrow(run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def fingerprint_counts(texts: DataFrame, text: str, lang: str, n: int, below: Broadcast | None, held: int = HELD) -> DataFrame:
    """(lang, print, f) of the n-grams whose two (n-1)-grams may be frequent; several phrases may share a fingerprint.

    Language is null there. For n = 1, rows with a language and no fingerprint count all its words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(prints, counts):
            return pa.RecordBatch.from_arrays([pa.nulls(len(prints), pa.string()), pa.array(prints.view(np.int64)),
                                               pa.array(counts)], names=["lang", "print", "f"])

        parts, counts, size, totals = [], [], 0, Counter()
        for part in read(batches):
            fine = part.starts(n)
            if below is None:
                totals.update(dict(zip(part.langs, np.bincount(part.lang, minlength=len(part.langs)).tolist(), strict=True)))
            else:
                shorter = np.zeros(len(fine) + 1, dtype=bool)
                at = np.flatnonzero(part.starts(n - 1))
                shorter[at] = below.value.has(part.fingerprints(at, n - 1))
                fine &= shorter[:-1] & shorter[1:]
            own, times = np.unique(part.fingerprints(np.flatnonzero(fine), n), return_counts=True)
            parts.append(own)
            counts.append(times)
            size += len(own)
            if size > held:
                both, place = np.unique(np.concatenate(parts), return_inverse=True)
                sums = np.bincount(place, np.concatenate(counts), len(both)).astype(np.int64)
                if 2 * len(both) > held:
                    yield rows(both, sums)
                    both, sums = both[:0], sums[:0]
                parts, counts, size = [both], [sums], len(both)
        both, place = np.unique(np.concatenate(parts or [np.empty(0, U64)]), return_inverse=True)
        yield rows(both, np.bincount(place, np.concatenate(counts or [np.empty(0)]), len(both)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()),
                                          pa.array(list(totals.values()), pa.int64())], names=["lang", "print", "f"])

    found = texts.select(text, lang).mapInArrow(run, "lang string, print long, f long")
    return found.groupBy("lang", "print").agg(F.sum("f").alias("f"))


def bit_map(prints: DataFrame, most_bits: int) -> Broadcast:
    """Bit map of the fingerprints, 32 bits for each up to `most_bits`; the driver gets one long for 64 bits."""
    bits = min(most_bits, max(1 << 16, 1 << (32 * prints.count()).bit_length()))
    bit = F.col("print").bitwiseAND(F.lit(bits - 1))
    cells = prints.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(print & 63 AS INT))")).alias("value")).toArrow()
    out = np.zeros(bits // 64, dtype=U64)
    out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy().view(U64)
    return send(prints.sparkSession, Bits(out))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang",
                     most_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of phrases with f >= least, (lang, n) words of each language).

    Phrases have one to `longest` words and are space-joined; f counts all occurrences within pieces, overlapping ones too.
    A null language counts as 'und', a null text as empty; repeated rows count as often as they stand there.
    """
    maps, below, totals = {}, None, None
    for n in range(1, longest + 1):
        found = cut(fingerprint_counts(docs, text, lang, n, below).where((F.col("f") >= least) | F.col("print").isNull()))
        if n == 1:
            totals = found.where("print IS NULL").select("lang", F.col("f").alias("n"))
        prints = found.where("print IS NOT NULL").select("print")
        if not prints.limit(1).count():
            break
        maps[n] = below = bit_map(prints, most_bits)
    phrases = counted_texts(docs, text, lang, maps).where(F.col("f") >= least)
    return cut(phrases.withColumn("words", F.size(F.split("phrase", " ")))), totals


def part(n: Column, first: bool) -> Column:
    """The first n words of a phrase, or the rest of it."""
    words = F.split("phrase", " ")
    return F.concat_ws(" ", F.slice(words, 1, n) if first else F.slice(words, n + 1, F.size(words) - n))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, descending.

    a = f(phrase), n words in the language. Each cut of the phrase into two parts has l and r, their f, and the score
    floor(1000 a n / (l r)); the cut with the lowest score counts (ties: the one with the shortest first part). A phrase
    within a longer frequent one that is as frequent is left out. Ties of the score: higher a, then the phrase in byte
    order. The arithmetic is exact (decimals of 38 digits). Tables without texts or frequent phrases give no rows.
    """
    frequent, totals = frequent_phrases(docs, least, longest, text, lang)
    phrases = frequent.where("words > 1")
    known = frequent.select("lang", "phrase", "f")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.col("k"), True).alias("head"),
                       part(F.col("k"), False).alias("rest"))
    for name, side in (("l", "head"), ("r", "rest")):
        cuts = cuts.join(known.withColumnsRenamed({"phrase": side, "f": name}), ["lang", side])
    whole = "CAST({} AS DECIMAL(19, 0))".format
    cuts = join_small(cuts, totals, "lang").withColumn(
        "score", F.expr(f"({whole('1000 * a')} * {whole('n')}) div ({whole('l')} * {whole('r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("cut"))
    # a longer phrase that is as frequent holds one more word before or after, at least
    longer = phrases.where("words > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(
        part(F.col("words") - 1, True), part(F.lit(1), False))).alias("phrase"))
    left = scored.select("lang", "phrase", "cut.*").join(longer, ["lang", "phrase", "a"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, [x for x in string_split_regex(t, '[ \x09]+') if x <> ''] AS w FROM p),
g AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS phrase
      FROM w, range(1, 6) s(m)),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS v FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT c.*, k, array_to_string(v[1:k], ' ') AS h, array_to_string(v[k + 1:m], ' ') AS t FROM c, range(1, 5) s(k) WHERE k < m),
x AS (SELECT k.lang, k.phrase, a, l.f AS l, r.f AS r, n, k, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = h JOIN f r ON r.lang = k.lang AND r.phrase = t JOIN n ON n.lang = k.lang),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM x) WHERE place = 1),
z AS (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = y.lang AND c.a = y.a AND c.phrase <> y.phrase
      AND contains(' ' || c.phrase || ' ', ' ' || y.phrase || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z)
WHERE rank <= 2000"""
