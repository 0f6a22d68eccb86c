"""Order-independent document fingerprints: sums of wide vectors hashed from paragraphs, modulo powers of two.

A paragraph's vector has 8 identity lanes of 32 bits, hashed from its whole text, and 64 likeness lanes of 16 bits: the
sum of the random sign vectors of its word pairs (the last word stands alone). A document's fingerprint is the sum of
its paragraphs' vectors, so equal multisets of paragraphs have equal fingerprints in any order, and `merged` inserts or
deletes paragraphs without the rest of the text. Two texts' likeness is the cosine of their likeness lanes, read as
signed numbers: an estimate of the share of common word pairs, with a standard error of about 1/8.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY, SIGNS = 8, 64
WIDTH = IDENTITY * 8 + SIGNS * 4
LOW32 = 0xFFFFFFFF


def entries(paragraph: Column, words: Column) -> Column:
    """Longs of a paragraph: its identity hashes, then a hash for each word with its successor."""
    halves = []
    for seed in range(IDENTITY // 2):
        wide = F.xxhash64(F.lit(seed), paragraph)
        halves += [wide.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(wide, 32)]
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.concat(F.array(*halves), pairs)


def lanes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, lanes): the lanes of all paragraphs of each key, identity lanes first. The text must not be null."""
    paragraphs = rows.select(*keys, F.explode(F.split(text, "\n")).alias("paragraph"))
    words = paragraphs.select(*keys, "paragraph", F.split("paragraph", " ").alias("words"))
    items = words.select(*keys, F.posexplode(entries(F.col("paragraph"), F.col("words"))).alias("at", "item"))
    items = items.select(*keys, "at", "item", (F.col("at") >= IDENTITY).cast("long").alias("is_pair"),
                         F.when(F.col("at") >= IDENTITY, F.col("item")).otherwise(0).alias("bits"))
    identity = [F.sum(F.when(F.col("at") == i, F.col("item")).otherwise(0)).alias(f"lane{i}") for i in range(IDENTITY)]
    ones = [F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))).alias(f"one{i}") for i in range(SIGNS)]
    summed = items.groupBy(*keys).agg(F.sum("is_pair").alias("pairs"), *identity, *ones)
    signed = [F.pmod(2 * F.col(f"one{i}") - F.col("pairs"), F.lit(1 << 16)) for i in range(SIGNS)]
    return summed.select(*keys, F.array(*[F.pmod(f"lane{i}", F.lit(1 << 32)) for i in range(IDENTITY)], *signed).alias("lanes"))


def as_text(values: Column) -> Column:
    """Lanes as fixed-width lower-case hex."""
    wide = F.transform(F.slice(values, 1, IDENTITY), lambda x: F.lpad(F.hex(x), 8, "0"))
    narrow = F.transform(F.slice(values, IDENTITY + 1, SIGNS), lambda x: F.lpad(F.hex(x), 4, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(narrow, "")))


def from_text(fingerprint: Column) -> Column:
    """Lanes of a fingerprint string."""
    def part(width, begin, count):
        at = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(at, lambda i: F.conv(
            F.substring(fingerprint, F.lit(begin + 1) + i * width, F.lit(width)), 16, 10).cast("long"))

    return F.concat(part(8, 0, IDENTITY), part(4, IDENTITY * 8, SIGNS))


def merged(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of `a` with the paragraphs of `b` inserted (sign 1) or deleted (sign -1)."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.pmod(
        x["a"] + sign * x["b"], F.when(i < IDENTITY, F.lit(1 << 32)).otherwise(F.lit(1 << 16))))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the likeness lanes, from 0 to 1; 1 where all lanes are equal."""
    def signed(values):
        return F.transform(F.slice(values, IDENTITY + 1, SIGNS), lambda x: F.when(
            x >= 1 << 15, x - (1 << 16)).otherwise(x).cast("double"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda total, z: total + z)

    x, y = signed(a), signed(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint): all texts of a key count as one multiset of paragraphs; a null text is one empty paragraph.

    A paragraph is what stands between line feeds. Rows with a null key form one document; an empty table has none.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    return lanes(rows, [key], "text_").select(key, as_text(F.col("lanes")).alias("fingerprint"))


def ring_buckets(docs: DataFrame, key: Column, bucket_rows: int, most: int = 1 << 16) -> DataFrame:
    """`docs` with (bucket, guest): rows in ranges of the key, and each range's follower row once more as its guest.

    The bounds are keys of the table, so the range above a bound is followed, in descending order, by the rows with
    exactly that key; the lowest range is followed by the rows with the largest key. At most `most` bounds are held.
    """
    n = max(1, min(most, docs.count() // bucket_rows))
    cuts = docs.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n + 1)], 1 / (4 * n))
    bounds = sorted({int(c) for c in cuts})
    if not bounds:
        return docs.withColumn("bucket", F.lit(0)).withColumn("guest", F.lit(0))
    table = F.lit(bounds).cast("array<bigint>")
    powers = [1 << p for p in reversed(range(max(1, (len(bounds) - 1).bit_length())))]
    # how many of the bounds but the last are below the key, by bisection
    below = F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), lambda at, p: F.when(
        (at + p < len(bounds)) & (F.get(table, at + p - 1) < key), at + p).otherwise(at))
    is_bound = F.array_contains(table, key) if len(bounds) < 64 else F.get(table, below) == key
    follows = F.when(is_bound, F.pmod(below + 1, F.lit(len(bounds))))
    own = F.struct(below.alias("bucket"), F.lit(0).alias("guest"))
    places = F.when(follows.isNotNull(), F.array(own, F.struct(follows.alias("bucket"), F.lit(1).alias("guest")))
                    ).otherwise(F.array(own))
    return docs.withColumn("place", F.explode(places)).select(*docs.columns, "place.bucket", "place.guest")


def edited_documents(docs: DataFrame, bucket_rows: int = 500) -> DataFrame:
    """Each document with a fingerprint, that of its edited text, and the likeness to that and to the next document.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document in descending doc_id; the last is followed by the first. Documents of one id follow each other by
    the hash of their texts; a null id comes last; a single document follows itself. Null texts are empty.

    One shuffle: documents go to ranges of doc_id that hold the first row of the range they border on as well.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order_key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    placed = ring_buckets(rows, order_key, bucket_rows)
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    n = F.length("text").cast("long")
    lined = placed.select("bucket", "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"),
                          F.row_number().over(order).alias("row"))
    share = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.length("text") - share).cast("int")),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), share))
    both = lined.withColumn("edited", edited).select(
        "bucket", "guest", "row", "doc_id", n.alias("n_chars"), F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.lit("").alias("sha256"), F.col("text").alias("body")),
            F.struct(F.lit(1).alias("kind"), F.sha2("edited", 256).alias("sha256"), F.col("edited").alias("body")))
        ).alias("version"))
    keys = ["bucket", "guest", "row", "doc_id", "n_chars", "kind", "sha256"]
    both = both.select(*keys[:5], "version.kind", "version.sha256", "version.body")
    found = lanes(both, keys, "body")
    pairs = Window.partitionBy("bucket").orderBy("guest", "row", "kind")
    result = found.withColumn("edited_lanes", F.lead("lanes", 1).over(pairs)).withColumn(
        "next_lanes", F.lead("lanes", 2).over(pairs)).withColumn("edited_sha256", F.lead("sha256", 1).over(pairs))
    own = F.col("lanes")
    return result.where("kind = 0 AND guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(own, F.col("edited_lanes")).alias("near_edited"), likeness(own, F.col("next_lanes")).alias("near_next"))
