"""Token-id files with a minimal perfect hash index.

A file set is a Parquet folder of shards in ascending doc_id order. A shard holds the raw ids of its documents back to
back (little-endian unsigned 32-bit), its document ids, and an index: a minimal perfect hash from document key to a slot
with a stored fingerprint, an offset and a length. A lookup hashes the key once or twice and reads one slot; a key that
the shard does not hold is refused by its fingerprint (all but one in 2^32). Shards carry their first and last id, which
Parquet keeps as statistics, so a keyed read opens only the row groups that can hold the key.

Keys are (doc_id, occurrence): rows that repeat an id are numbered in the order of their texts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillmark.sources.files import run_folder

SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u4"), ("length", "<u4")])
SHARDS = (
    "part int, shard int, first_doc long, last_doc long, carried int, n_docs int, n_tokens long, doc_ids array<long>, "
    "payload binary, displacement binary, slots binary"
)
SHARD_SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
    ("carried", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary()),
    ("displacement", pa.binary()), ("slots", pa.binary())])
U64 = np.uint64
STEP = 0x9E3779B97F4A7C15
NULL_ID = STEP


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * STEP + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def keys_of(doc_ids: list[int | None], occurrences: list[int]) -> np.ndarray:
    ids = np.array([NULL_ID if d is None else d & (2**64 - 1) for d in doc_ids], dtype=U64)
    nulls = np.array([d is None for d in doc_ids], dtype=U64)
    return mix(mix(ids, 1) ^ np.array(occurrences, dtype=U64), 2) ^ nulls


def tried(keys: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys under displacements; the seeds of `mix` are steps of one constant."""
    return (mix(keys + displacement.astype(U64) * U64(STEP), 10) % U64(max(n, 1))).astype(np.int64)


def perfect_hash(keys: np.ndarray, per_bucket: int = 4, ahead: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key); a bucket of one key stores its slot directly, as a negative number.

    Buckets take their smallest free displacement, large ones first. The first `ahead` are worked out for all keys at once,
    later ones for a bucket in blocks.
    """
    n = len(keys)
    displacement = np.zeros(max(1, n // per_bucket), dtype=np.int32)
    bucket = (mix(keys, 3) % U64(len(displacement))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(len(displacement) + 1))
    sizes = np.diff(starts)

    slot = np.zeros(n, dtype=np.int64)
    early = tried(keys[order, None], np.arange(ahead), n).tolist()
    held = bytearray(n)
    for b in np.argsort(-sizes, kind="stable").tolist():
        begin, end = int(starts[b]), int(starts[b + 1])
        if end - begin < 2:
            break
        own = order[begin:end]
        fits = ((d, at) for d, at in enumerate(zip(*early[begin:end], strict=True))
                if not any(map(held.__getitem__, at)) and len(set(at)) == len(at))
        d, at = next(fits, (-1, ()))
        first, count = ahead, 256
        while d < 0:
            rows = tried(keys[own], np.arange(first, first + count)[:, None], n)
            free = rows[~np.frombuffer(held, dtype=bool)[rows].any(axis=1)].tolist()
            if at := next((r for r in free if len(set(r)) == len(r)), ()):
                d = first + int(np.flatnonzero((rows == at).all(axis=1))[0])
            first, count = first + count, min(2 * count, 4096)
        displacement[b], slot[own] = d, at
        for x in at:
            held[x] = 1
    free = iter(np.flatnonzero(~np.frombuffer(held, dtype=bool)))
    for b in np.flatnonzero(sizes == 1):
        slot[order[starts[b]]] = at = next(free)
        displacement[b] = -at - 1
    return displacement, slot


def find(keys: np.ndarray, displacement: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 for keys that are not held."""
    n = len(slots)
    if not n:
        return np.full(len(keys), -1)
    d = displacement[(mix(keys, 3) % U64(len(displacement))).astype(np.int64)].astype(np.int64)
    at = np.where(d < 0, -d - 1, tried(keys, np.maximum(d, 0), n))
    return np.where(slots["fingerprint"][at] == fingerprints(keys), at, -1)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 4) >> U64(32)).astype(np.uint32)


class PieceCache:
    """Ids of space-separated pieces of text, encoded once each by the tokenizer.

    A space between two characters that are no white space always begins a new pre-token of a byte-level tokenizer, so
    the pieces between such spaces can be encoded on their own; so can what follows a piece's leading run of letters.
    New pieces of a batch are joined and encoded in one call; the ids that begin with a space tell them apart again.
    Texts in which white space follows a space, and texts that hold an added token such as <|endoftext|>, which the
    tokenizer takes out before it splits, are encoded whole. When the cache is full, what the next batch does not use
    leaves it, which changes no result.
    """

    HEAD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([\n!-@\[-`{-~].*)", re.DOTALL)

    def __init__(self, path: str, limit: int = 900_000, joined: int = 100):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of the library only add work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, dtype=bool)
        for name, i in names.items():
            self.spaced[i] = name.startswith("Ġ")
        self.limit, self.joined, self.pieces, self.tails = limit, joined, {}, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, missing: set[str]) -> None:
        """Ids of new pieces; None for a piece that is empty or begins with white space."""
        heads = {piece for piece in missing if piece.isalpha()}
        parts = []
        for piece in missing - heads:
            if not piece or piece[0].isspace():
                self.pieces[piece] = None
            elif m := self.HEAD.fullmatch(piece):
                parts.append((piece, *m.groups()))
            else:
                heads.add(piece)
        heads.update(head for _, head, _ in parts if head not in self.pieces)
        if heads:
            new = list(heads)
            raw = b"".join(self.ids([" " + " ".join(new[i : i + self.joined]) for i in range(0, len(new), self.joined)]))
            starts = np.flatnonzero(self.spaced[np.frombuffer(raw, dtype="<u4")])
            if len(starts) != len(new):
                raise ValueError("a piece was not encoded on its own")
            begin = (starts * 4).tolist()
            self.pieces.update(zip(new, map(raw.__getitem__, map(slice, begin, [*begin[1:], len(raw)])), strict=True))
        tails = list({tail for _, _, tail in parts}.difference(self.tails))
        self.tails.update(zip(tails, self.ids(tails), strict=True))
        self.pieces.update([(piece, self.pieces[head] + self.tails[tail]) for piece, head, tail in parts])

    def encode(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """Ids of the texts, none of them null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        begin = split.offsets.to_numpy().astype(np.int64)
        begin, flat = begin - begin[0], split.flatten()
        coded = flat.dictionary_encode()
        used, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        if len(self.pieces) + len(self.tails) > self.limit:
            self.pieces = {piece: self.pieces[piece] for piece in used if piece in self.pieces}
            self.tails.clear()
        if missing := set(used).difference(self.pieces):
            self.learn(missing)
        blobs = list(map(self.pieces.__getitem__, used))
        # the first piece of a text has no space before it
        first = flat.take(pa.array(begin[:-1])).to_pylist()
        place[begin[:-1]] = np.arange(len(used), len(used) + len(first))
        unsafe = np.array([blob is None for blob in blobs] + [False] * len(first))
        whole = np.add.reduceat(unsafe[place], begin[:-1]) > 0
        whole |= (np.diff(begin) > 1) & np.array([not head for head in first])
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        joined = pa.array(blobs + self.ids(first), pa.large_binary()).take(pa.array(place))
        data, ends = memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int64)[begin].tolist()
        return [self.ids([texts[i].as_py()])[0] if w else bytes(data[a:b])
                for i, (w, a, b) in enumerate(zip(whole.tolist(), ends[:-1], ends[1:], strict=True))]


CACHES: dict[str, PieceCache] = {}


def cache_for(path: str) -> PieceCache:
    """One per Python worker; a worker serves many tasks."""
    if path not in CACHES:
        CACHES[path] = PieceCache(path)
    return CACHES[path]


def shard_row(part: int, shard: int, doc_ids: list, occurrences: list[int], blobs: list[bytes]) -> dict:
    keys = keys_of(doc_ids, occurrences)
    displacement, slot = perfect_hash(keys)
    lengths = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
    slots = np.zeros(len(keys), dtype=SLOT)
    slots["fingerprint"][slot] = fingerprints(keys)
    slots["offset"][slot] = np.cumsum(lengths) - lengths
    slots["length"][slot] = lengths
    known = [d for d in doc_ids if d is not None]
    return {"part": part, "shard": shard, "first_doc": known[0] if known else None,
            "last_doc": known[-1] if known else None, "carried": occurrences[0], "n_docs": len(keys), "n_tokens": int(lengths.sum()),
            "doc_ids": doc_ids, "payload": b"".join(blobs), "displacement": displacement.tobytes(),
            "slots": slots.tobytes()}


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 18,
                 shard_docs: int = 4096, path: str | None = None) -> str:
    """Encode all documents and write the file set; returns its folder.

    Needs doc_id and text; other columns are ignored. A null text is empty: its document holds the end id alone. A
    null doc_id sorts first. A shard closes when it holds `shard_tokens` ids or `shard_docs` documents; a text is
    never cut. An empty table gives a folder without shards.
    """
    spark = docs.sparkSession
    path = path or run_folder(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(tokenizer_path)
        part, shard, held, size = TaskContext.get().partitionId(), 0, ([], [], []), 0
        last, seen = object(), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, blob in zip(ids, cache.encode(batch.column(1)), strict=True):
                seen = seen + 1 if doc_id == last else 0
                last = doc_id
                for column, value in zip(held, (doc_id, seen, blob + end), strict=True):
                    column.append(value)
                size += len(blob) // 4 + 1
                if size >= shard_tokens or len(held[0]) >= shard_docs:
                    yield pa.RecordBatch.from_pylist([shard_row(part, shard, *held)], SHARD_SCHEMA)
                    shard, held, size = shard + 1, ([], [], []), 0
        if held[0]:
            yield pa.RecordBatch.from_pylist([shard_row(part, shard, *held)], SHARD_SCHEMA)

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(shards, SHARDS).write.option("compression", "zstd")
    writer.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", False).parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def located(row: dict, doc_ids: list, occurrences: list[int]) -> list[bytes | None]:
    """Ids of the documents from one shard, through its index; None for keys it does not hold."""
    slots = np.frombuffer(row["slots"], dtype=SLOT)
    at = find(keys_of(doc_ids, occurrences), np.frombuffer(row["displacement"], dtype=np.int32), slots)
    payload = row["payload"]
    begin = slots["offset"][at].astype(np.int64) * 4
    end = begin + slots["length"][at].astype(np.int64) * 4
    return [payload[a:b] if i >= 0 else None for i, a, b in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True)]


def numbered(doc_ids: list, carried: int) -> list[int]:
    """How often each id of a sorted list was seen before; `carried` times the first one in earlier shards."""
    out: list[int] = []
    for i, d in enumerate(doc_ids):
        out.append((out[-1] + 1 if d == doc_ids[i - 1] else 0) if i else carried)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file set, each read through the index.

    `start` is the number of ids of all documents before it. One pass over the shards: only their totals are summed
    across, per part and then over the parts.
    """
    shards = read_shards(spark, path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written partition
    parts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "shard", "n_tokens").withColumn(
        "inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "shard", (F.col("part_start") + F.col("inside")).alias("shard_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = row["doc_ids"]
                blobs = located(row, ids, numbered(ids, row["carried"]))
                counts = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids, "part": [row["part"]] * len(ids), "shard": [row["shard"]] * len(ids),
                    "inside": np.cumsum(counts) - counts, "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(b) for b in blobs]},
                    schema=pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()),
                                      ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    found = shards.select("part", "shard", "doc_ids", "payload", "displacement", "slots", "carried").mapInArrow(
        read, "doc_id long, part int, shard int, inside long, n_tokens long, ids_crc32 long")
    return found.join(places, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int, occurrence: int = 0) -> list[int] | None:
    """Ids of one document; None if the file set does not hold it."""
    near = read_shards(spark, path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for row in near.select("payload", "displacement", "slots").toLocalIterator():
        blob = located(row.asDict(), [doc_id], [occurrence])[0]
        if blob is not None:
            return np.frombuffer(blob, dtype="<u4").tolist()
    return None
