"""Language identification, words first.

A word that some text of known language holds scores each language by the logarithm of its relative frequency there. Any
other word falls back to character n-grams, padded by a space on both sides: the longest length, of `longest` letters
down to one, at which at least one of its n-grams is known; the n-grams known at that length score it by their mean.
A frequency counts with a floor that all languages share, and scores are counted from the logarithm of the floor, so
that a language that never saw a word or an n-gram scores 0 there and only what was seen has to be stored.

Texts are never shuffled. One pass cuts each partition into blocks of texts and writes, for each block, its distinct words
with the counts of those that teach, and for each text the numbers of its words within the block. Words are brought
together by the word, scored, and sent back to their blocks, where the texts are summed up. Neither a task nor the driver
ever holds more than one block; the model may be of any size and is always joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmark.llm.common import cut, join_small, labelled_side, stored

#: Scripts written without spaces are taken two letters at a time; longer words are cut into parts of 24 letters.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"[{UNSPACED}]{{1,2}}|[[\p{{L}}\p{{M}}]--[{UNSPACED}]]{{1,24}}", regex.V1)
NO_LANGUAGE = "und"
OWN = ("li_kind", "li_block", "li_code", "li_word", "li_langs", "li_counts", "li_bag", "li_times", "li_letters")


def packed(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The parts of `values` that end at `ends`, each as bytes of seven bits, the lowest first, the last one below 128."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 9):
        size += values >= np.uint64(1 << (7 * k))
    place = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(place[-1]), dtype=np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        part = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[place[:-1][own] + k] = part + np.where(size[own] > k + 1, np.uint64(128), np.uint64(0))
    data, bounds = out.tobytes(), place[np.concatenate([[0], ends])]
    return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of values of each part)."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    last = data < 128
    ends = np.flatnonzero(last)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    nth = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    bits = (data & 127).astype(np.int64) << (7 * nth)
    values = np.add.reduceat(bits, begins) if len(begins) else bits
    before = np.concatenate([[0], np.cumsum(last)])
    return values, np.diff(before[np.cumsum([0] + [len(p) for p in parts])])


class Block:
    """Texts of one block: their words are numbered in the order in which they are met."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.langs: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.teach: list[int] = []
        self.kept: list[pa.RecordBatch] = []
        self.size = 0

    def add(self, kept: pa.RecordBatch, texts: list[str | None], langs: list[str | None], teach: list[bool | None]) -> None:
        known = self.known
        for text, lang, learn in zip(texts, langs, teach, strict=True):
            words = WORD.findall((text or "").lower())
            self.codes.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64))
            self.teach.append(self.langs.setdefault(lang, len(self.langs)) if learn and lang is not None else -1)
            self.size += len(text or "")
        self.kept.append(kept)

    def words(self) -> tuple[list[str], pa.ListArray, pa.ListArray]:
        """The distinct words, with the languages that taught them in this block and how often."""
        pairs = [lang * len(self.known) + codes for lang, codes in zip(self.teach, self.codes, strict=True) if lang >= 0]
        found, counts = np.unique(np.concatenate(pairs or [np.empty(0, np.int64)]), return_counts=True)
        lang, code = np.divmod(found, max(1, len(self.known)))
        order = np.argsort(code, kind="stable")
        offsets = pa.array(np.searchsorted(code[order], np.arange(len(self.known) + 1)).astype(np.int32))
        names = pa.array(list(self.langs), pa.string()).take(pa.array(lang[order]))
        return (list(self.known), pa.ListArray.from_arrays(offsets, names),
                pa.ListArray.from_arrays(offsets, pa.array(counts[order])))

    def bags(self) -> tuple[list[bytes], list[bytes]]:
        """Of each text: the steps between its words' numbers in rising order, and how often each word occurs."""
        sizes = [len(codes) for codes in self.codes]
        width = max(1, len(self.known))
        both = np.repeat(np.arange(len(sizes)), sizes) * width + np.concatenate(self.codes or [np.empty(0, np.int64)])
        found, times = np.unique(both, return_counts=True)
        text, code = np.divmod(found, width)
        steps = np.diff(code, prepend=0)
        opens = np.searchsorted(text, np.arange(len(sizes)))
        real = opens < np.append(opens[1:], len(text))
        steps[opens[real]] = code[opens[real]]
        ends = np.append(opens[1:], len(text))
        return packed(steps, ends), packed(times, ends)


def blocks(docs: DataFrame, keep: list[str], text: str, lang: str, teach: Column, block_chars: int) -> DataFrame:
    """The blocks' words (li_kind 0) and texts (li_kind 1); a block has about `block_chars` characters."""
    held = docs.select(*keep, F.col(text).alias("li_text"), F.col(lang).alias("li_lang"), teach.alias("li_teach"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("li_letters"))
    fields = [T.StructField(f.name, f.dataType) for f in held.select(*keep).schema]
    schema = T.StructType([
        *fields, T.StructField("li_kind", T.IntegerType()), T.StructField("li_block", T.LongType()),
        T.StructField("li_code", T.IntegerType()), T.StructField("li_word", T.StringType()),
        T.StructField("li_langs", T.ArrayType(T.StringType())), T.StructField("li_counts", T.ArrayType(T.LongType())),
        T.StructField("li_bag", T.BinaryType()), T.StructField("li_times", T.BinaryType()),
        T.StructField("li_letters", T.BooleanType())])
    wide = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 33, Block()

        def out(kept: list[pa.Array], n: int, kind: int, **own: pa.Array) -> pa.RecordBatch:
            kinds = {"li_kind": pa.array(np.full(n, kind, np.int32)), "li_block": pa.array(np.full(n, number, np.int64))} | own
            shapes = {"li_code": pa.int32(), "li_word": pa.string(), "li_langs": pa.list_(pa.string()),
                      "li_counts": pa.list_(pa.int64()), "li_bag": pa.binary(), "li_times": pa.binary(), "li_letters": pa.bool_()}
            rest = [kinds.get(name, pa.nulls(n, shapes.get(name))) for name in OWN]
            return pa.RecordBatch.from_arrays([*kept, *rest], names=schema.names)

        def closed() -> Iterator[pa.RecordBatch]:
            words, langs, counts = block.words()
            for a in range(0, len(words), 1 << 16):
                part = slice(a, min(len(words), a + (1 << 16)))
                n = part.stop - part.start
                yield out([pa.nulls(n, c.type) for c in block.kept[0].columns[:wide]], n, 0,
                          li_code=pa.array(np.arange(part.start, part.stop, dtype=np.int32)), li_word=pa.array(words[part]),
                          li_langs=langs[part.start : part.stop], li_counts=counts[part.start : part.stop])
            bags, times = block.bags()
            at = 0
            for kept in block.kept:
                n = kept.num_rows
                yield out(kept.columns[:wide], n, 1, li_bag=pa.array(bags[at : at + n], pa.binary()),
                          li_times=pa.array(times[at : at + n], pa.binary()), li_letters=kept.column(wide))
                at += n

        for batch in batches:
            texts, langs, learn = (batch.column(wide + i).to_pylist() for i in range(3))
            kept = pa.RecordBatch.from_arrays([*batch.columns[:wide], batch.column(wide + 3)], names=[*keep, "li_letters"])
            block.add(kept, texts, langs, learn)
            if block.size >= block_chars:
                yield from closed()
                number, block = number + 1, Block()
        if block.kept:
            yield from closed()

    return held.mapInArrow(run, schema)


def worth(n: Column, total: Column, floor: float) -> Column:
    """Logarithm of a relative frequency plus the floor, counted from that of the floor alone."""
    return F.log1p(n / total / F.lit(floor))


def n_grams(word: Column, n: int) -> Column:
    """All n-grams of a word with a space on both sides; single letters without the spaces."""
    padded = F.concat(F.lit(" "), word, F.lit(" ")) if n > 1 else word
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)),
                       lambda i: F.substring(padded, i, F.lit(n)))


def gram_scores(unseen: DataFrame, taught: DataFrame, longest: int, alpha: float) -> DataFrame:
    """(word, lang, value) of words that were never taught, by the longest n-grams known."""
    out = None
    for n in range(longest, 0, -1):
        grams = stored(taught.select("lang", "n", F.explode(n_grams(F.col("word"), n)).alias("gram")).groupBy("gram", "lang").agg(
            F.sum("n").alias("n")), "grams")
        totals = cut(grams.groupBy("lang").agg(F.sum("n").alias("total")))
        floor = alpha / (totals.agg(F.avg("total")).first()[0] or 1.0)
        valued = join_small(grams, totals, "lang").groupBy("gram").agg(F.collect_list(F.struct(
            "lang", worth(F.col("n"), F.col("total"), floor).alias("value"))).alias("values"))
        # a row without a language counts the known n-grams of the word
        one = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(1.0).alias("value"))
        met = unseen.select("word", F.explode(n_grams(F.col("word"), n)).alias("gram")).join(valued, "gram")
        sums = met.select("word", F.explode(F.concat("values", F.array(one))).alias("v")).groupBy("word", "v.lang").agg(
            F.sum("v.value").alias("value"))
        sums = stored(sums, "backed")
        size = sums.where("lang IS NULL").select("word", F.col("value").alias("size"))
        found = sums.where("lang IS NOT NULL").join(size, "word").select("word", "lang", (F.col("value") / F.col("size")).alias("value"))
        out = found if out is None else out.unionByName(found)
        if n > 1:
            unseen = stored(unseen.join(size.select("word"), "word", "left_anti"), "unseen")
    return out


def identify(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", teach: Column | None = None,
             longest: int = 4, alpha: float = 0.5, block_chars: int = 1 << 25, most_langs: int = 10_000) -> DataFrame:
    """The columns `keep` of every row with lang_pred and score.

    Rows teach where `teach` is true (by default two thirds, by crc32 of doc_id) and the language is not null. Words are
    lower-cased runs of letters. lang_pred is the language with the largest sum over the words of the text; ties go to
    the one taught by more words, then to the name. score is its share under equal priors: exp of its sum over the sum
    of all such exps. A null text and one without a letter give 'und' and 0, and so does a table that teaches nothing.
    Repeated rows teach and are answered as often as they stand there. Columns beginning with li_, the two names of
    the result, and more than `most_langs` languages are refused.
    """
    if clash := [c for c in keep if c.startswith("li_") or c in ("lang_pred", "score")]:
        raise ValueError(f"columns exist already: {clash}")
    teach = F.coalesce(labelled_side() if teach is None else teach, F.lit(False))
    table = stored(blocks(docs, keep, text, lang, teach, block_chars), "language")
    words = table.where("li_kind = 0").withColumnRenamed("li_word", "word")
    taught = words.select("word", F.explode(F.arrays_zip("li_langs", "li_counts")).alias("t"))
    taught = stored(taught.groupBy("word", F.col("t.li_langs").alias("lang")).agg(F.sum("t.li_counts").alias("n")), "taught")
    sums = taught.groupBy("lang").agg(F.sum("n").alias("total")).limit(most_langs + 1).collect()
    if len(sums) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    sums = sorted(sums, key=lambda r: (-r["total"], r["lang"]))
    names = [r["lang"] for r in sums]
    langs = F.broadcast(docs.sparkSession.createDataFrame(
        [(r["lang"], i, r["total"]) for i, r in enumerate(sums)], "lang string, place int, total long"))
    floor = alpha * len(sums) / max(1, sum(r["total"] for r in sums))
    met = words.select("li_block", "li_code", "word").join(taught, "word", "left")
    met = stored(met.withColumn("word", F.when(F.col("lang").isNull(), F.col("word"))), "met")
    seen = met.join(langs, "lang").select("li_block", "li_code", "place", worth(F.col("n"), F.col("total"), floor).alias("value"))
    unseen = met.where("lang IS NULL").select("li_block", "li_code", "word")
    backed = gram_scores(stored(unseen.select("word").distinct(), "unseen"), taught, longest, alpha).join(langs, "lang")
    unseen = unseen.join(backed.select("word", "place", "value"), "word").drop("word")
    values = seen.unionByName(unseen).withColumn("value", F.col("value").cast("float"))
    texts = table.where("li_kind = 1").select(*keep, "li_block", "li_bag", "li_times", "li_letters")
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in texts.select(*keep).schema],
                        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def answer(own: pa.Table, known: pa.Table) -> pa.Table:
        code, place = known.column("li_code").to_numpy(), known.column("place").to_numpy()
        order = np.argsort(code, kind="stable")
        code, place, value = code[order], place[order], known.column("value").to_numpy().astype(np.float64)[order]
        bags, sizes = unpacked(own.column("li_bag").to_pylist())
        times, _ = unpacked(own.column("li_times").to_pylist())
        text = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        summed = np.cumsum(bags)
        number = summed - np.repeat(np.append(0, summed)[ends - sizes], sizes)
        first = np.searchsorted(code, number, "left")
        many = np.searchsorted(code, number, "right") - first
        at = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        width = max(1, len(names))
        total = np.bincount(np.repeat(text, many) * width + place[at], value[at] * np.repeat(times, many),
                            len(sizes) * width).reshape(len(sizes), width)
        best = total.argmax(axis=1)  # the first of equal ones: the language taught by more words
        share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        lettered = np.array(own.column("li_letters").to_pylist(), dtype=bool) & bool(names)
        pred = [names[b] if fine else NO_LANGUAGE for b, fine in zip(best.tolist(), lettered.tolist(), strict=True)]
        columns = [own.column(name) for name in keep]
        return pa.table([*columns, pa.array(pred, pa.string()), pa.array(np.where(lettered, share, 0.0))], names=out.names)

    return texts.groupBy("li_block").cogroup(values.groupBy("li_block")).applyInArrow(answer, out)
