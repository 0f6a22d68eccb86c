"""Word and word n-gram hashes of whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True
RADIX = 0x9E3779B97F4A7C15
POWERS = np.ones(1, dtype=U64)
INVERSES = np.ones(1, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2^64, at least n of each; kept for the next batch."""
    global POWERS, INVERSES
    if len(POWERS) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("POWERS", RADIX), ("INVERSES", pow(RADIX, -1, 1 << 64))):
            values = np.full(size, base, dtype=U64)
            values[0] = 1
            with np.errstate(over="ignore"):
                globals()[name] = np.multiply.accumulate(values)
    return POWERS, INVERSES


CHUNK = 1 << 19  # bytes of text hashed at once; the arrays take some forty times as much


def chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text): A-Z lower-cased, words split at ASCII white space.

    A word's hash is a polynomial of its bytes modulo 2^64, mixed with its length.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(LOWER) + b" ", dtype=np.uint8)
    inside = ~BREAKS[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U64), np.zeros(len(texts), np.int64)
    power, inverse = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
        hashes = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return mix(hashes), np.diff(np.searchsorted(start, bounds))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one text's words; fewer words than n give one gram of them all, none give none."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out * U64(0x2545F4914F6CDD1D) + words[i : len(words) - size + 1 + i] + U64(size))
    return out


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    out = []
    for some in chunks(texts):
        words, counts = words_of(some)
        ends = np.cumsum(counts)
        out += [np.unique(grams(words[b - c : b], n)) for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    return out
