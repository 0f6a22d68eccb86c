"""Unigram piece encoding and decoding: Viterbi over a double-array trie of scored pieces.

The text gets a leading space, spaces become the marker U+2581, and the split with the largest sum of piece scores is
taken; of equal splits the one whose last differing piece is longest. Characters without a piece become one byte piece
for each of their UTF-8 bytes. Decoding joins the pieces, turns markers to spaces and takes the leading one off.

No piece of a model of this kind has a marker behind another character, so a text splits exactly where a run of spaces
begins: a part is a run of markers, which has pieces of its own, and the word after it. Models with other pieces solve
each text whole. Each distinct part is solved once per Python worker: new parts of a batch are solved together, one
numpy step for all of them per byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
PART = re.compile(f"{MARKER}+[^{MARKER}]*")
IDS = pa.list_(pa.int32())


class DoubleArray:
    """A trie of byte strings: the child of state s by byte b is base[s] + b + 1, if check there is s."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for word, value in words.items():
            node = tree
            for byte in word:
                node = node.setdefault(byte + 1, {})
            node[0] = value
        self.grow(1 << 16)
        self.taken[0] = True
        todo, lowest, pointer = [(0, tree)], 257, 257  # any byte can lead there
        while todo:
            state, node = todo.pop()
            self.value[state] = node.pop(0, -1)
            codes = np.array(sorted(node), dtype=np.int64)
            if not len(codes):
                continue
            while self.taken[lowest]:
                lowest += 1
            # nodes with one child fill gaps; the others move a pointer on past crowded places
            at = (lowest if len(codes) == 1 else pointer) - int(codes[0])
            while True:
                if at + 300 > len(self.taken):
                    self.grow(2 * len(self.taken))
                if not self.taken[at + codes].any():
                    break
                at += 1
            if len(codes) > 1:
                pointer = max(pointer, at + int(codes[0]))
            self.base[state] = at
            self.taken[at + codes] = True
            self.check[at + codes] = state
            todo += [(at + int(code), node[int(code)]) for code in codes]

    def grow(self, size: int) -> None:
        for name, fill, kind in (("base", 0, np.int32), ("check", -1, np.int32), ("value", -1, np.int32),
                                 ("taken", False, bool)):
            new = np.full(size, fill, dtype=kind)
            old = getattr(self, name, np.empty(0, kind))
            new[: len(old)] = old
            setattr(self, name, new)

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Next states; -1 where the trie has no such child."""
        to = self.base[states] + data + 1
        return np.where(self.check[to] == states, to, -1)


class PieceModel:
    """Pieces with scores from a model file; only normal pieces are matched in texts."""

    def __init__(self, path: str):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        n = source.get_piece_size()
        names = [source.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([source.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        plain = [i for i in range(n) if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i)
                                             or source.is_unused(i))]
        self.splits = not any(MARKER in names[i].lstrip(MARKER) for i in plain)
        self.scores = np.array([source.get_score(i) for i in range(n)])
        self.unknown = min(self.scores[plain], default=0.0) - 10
        self.trie = DoubleArray({names[i].encode(): i for i in plain})
        table = {i: names[i].encode() for i in plain} | {int(b): bytes([k]) for k, b in enumerate(self.byte_ids)}
        self.bytes_of = [table.get(i, b"") for i in range(n)]

    def solve(self, words: list[bytes]) -> list[bytes]:
        """Best splits of UTF-8 strings, as little-endian 32-bit ids."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[bytes] = [b""] * len(words)
        for begin in range(0, len(order), 4096):
            rows = order[begin : begin + 4096]
            if len(words[rows[-1]]) > 256:  # long ones apart: the tables are as wide as the longest
                for i in rows:
                    out[i] = self.solve_together([words[i]])[0]
            else:
                for i, ids in zip(rows, self.solve_together([words[i] for i in rows]), strict=True):
                    out[i] = ids
        return out

    def solve_together(self, words: list[bytes]) -> list[bytes]:
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max(initial=0))
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).T.astype(np.int32)
        best = np.full((width + 1, n), -np.inf)
        start, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        best[0] = 0
        for i in range(width):
            rows = np.flatnonzero((best[i] > -np.inf) & (i < sizes))
            if not len(rows):
                continue
            lead = data[i, rows]
            char = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), dtype=bool)
            live, states = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, width):
                states = self.trie.step(states, data[j, rows[live]])
                on = (states >= 0) & (j < sizes[rows[live]])
                live, states = live[on], states[on]
                if not len(live):
                    break
                ids = self.trie.value[states]
                hit = ids >= 0
                own, ids = live[hit], ids[hit]
                single[own] |= char[own] == j + 1
                score = best[i, rows[own]] + self.scores[ids]
                better = score > best[j + 1, rows[own]]
                at = rows[own[better]]
                best[j + 1, at], start[j + 1, at], piece[j + 1, at] = score[better], i, ids[better]
            alone = np.flatnonzero(~single)
            if len(alone):
                at, end = rows[alone], char[alone]
                score = best[i, at] + self.unknown
                better = score > best[end, at]
                at, end = at[better], end[better]
                best[end, at], start[end, at], piece[end, at] = score[better], i, -1
        return self.trace(words, sizes, start, piece)

    def trace(self, words, sizes, start, piece) -> list[bytes]:
        """Ids along the best paths, last one first, one step for all words at once."""
        rows, at, steps = np.arange(len(words)), sizes.copy(), []
        rows, at = rows[at > 0], at[at > 0]
        while len(rows):
            ids, came = piece[at, rows], start[at, rows]
            steps.append((rows, ids, came, at))
            rows, at = rows[came > 0], came[came > 0]
        if not steps:
            return [b""] * len(words)
        rows, ids, came, ends = (np.concatenate(column) for column in zip(*steps, strict=True))
        order = np.lexsort((came, rows))
        rows, ids = rows[order], ids[order].astype("<i4")
        raw = ids.tobytes()
        bounds = np.searchsorted(rows, np.arange(len(words) + 1))
        out = [raw[a:b] for a, b in zip((bounds[:-1] * 4).tolist(), (bounds[1:] * 4).tolist(), strict=True)]
        for k in np.unique(rows[ids < 0]).tolist():  # byte pieces for characters without a piece
            own = order[bounds[k] : bounds[k + 1]]
            parts = [[i] if i >= 0 else self.byte_ids[list(words[k][a:b])].tolist() for i, a, b in
                     zip(ids[bounds[k] : bounds[k + 1]].tolist(), came[own].tolist(), ends[own].tolist(), strict=True)]
            out[k] = np.array([i for part in parts for i in part], dtype="<i4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Remembers solved parts. When the memory is full and when a task ends, the parts met first stay, `kept` of them, as
    frequent ones are met early; a worker that goes on with other work gives the rest back. This changes no result."""

    def __init__(self, model: PieceModel, limit: int = 400_000, kept: int = 100_000):
        self.model, self.limit, self.kept, self.solved = model, limit, min(kept, limit // 2), {}

    def trim(self) -> None:
        if len(self.solved) > self.kept:
            self.solved = dict(islice(self.solved.items(), self.kept))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.solved) > self.limit:
            self.trim()
        marked = [MARKER + text.replace(" ", MARKER) for text in texts]
        split = [PART.findall(text) for text in marked] if self.model.splits else [[text] for text in marked]
        missing = list({part for own in split for part in own} - self.solved.keys())
        self.solved.update(zip(missing, self.model.solve([part.encode() for part in missing]), strict=True))
        get = self.solved.__getitem__
        return [b"".join(map(get, own)) if text else b"" for own, text in zip(split, texts, strict=True)]


@cache
def encoder_for(path: str) -> Encoder:
    """One per Python worker; a worker serves many tasks."""
    return Encoder(PieceModel(path))


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids",
                  decoded: str | None = None) -> DataFrame:
    """All columns of `docs`, the ids of the whole text, and, where a name is given, the text decoded from them.

    Rows stay as they are, repeated ones too; the new columns must not exist yet. A null text has null ids; an empty
    one has none. An empty text stays empty when decoded. A text that holds the marker itself decodes to spaces there.
    """
    added = [name for name in (ids, decoded) if name]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    wide = docs.withColumn(ids, F.lit(None).cast("array<int>"))
    if decoded:
        wide = wide.withColumn(decoded, F.lit(None).cast("string"))
    position = docs.columns.index(text)
    kept, names = len(docs.columns), wide.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_path)
        try:
            for batch in batches:
                texts = batch.column(position).to_pylist()
                blobs = encoder.encode([t or "" for t in texts])
                absent = np.array([t is None for t in texts], dtype=bool)
                ends = np.cumsum([0] + [len(b) // 4 for b in blobs])
                values = np.frombuffer(b"".join(blobs), dtype="<i4")
                new = [pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(absent, False)), pa.array(values))]
                if decoded:
                    new.append(pa.array([None if a else encoder.model.decode(values[low:high]) for a, low, high in
                                         zip(absent, ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(batch.columns[:kept] + new, names=names)
        finally:
            encoder.trim()

    return wide.mapInArrow(run, wide.schema)


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """All columns of `rows` and the text of their ids; null ids give a null text."""
    wide = rows.withColumn(text, F.lit(None).cast("string"))
    position, names = rows.columns.index(ids), wide.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_for(model_path).model
        for batch in batches:
            found = [None if x is None else model.decode(np.array(x, dtype=np.int32))
                     for x in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(found, pa.string())], names=names)

    return wide.mapInArrow(run, wide.schema)
