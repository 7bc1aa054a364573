"""Word shingles of whole batches of texts at once, as 64-bit hashes, in NumPy.

Words are what stands between ASCII white space, A-Z in lower case. A word's hash is a polynomial over a fixed random
table of its bytes, mixed; a shingle's hash combines those of its words. Prefix sums give all words of a batch in a few
array operations, without a Python object for each word.

Defined results: a null text counts as empty; an empty text, and one of white space, has no shingles; one with fewer words
than a shingle is one shingle of its whole sequence; repeated shingles count once; a very long text is a slice of its own and
takes some 44 times its bytes; an empty batch gives an empty list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
SLICE_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20_251))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SLICE_BYTES + 1:
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b)])) for b in (_BASE, _BACK))
    if not _powers:
        for name, b in (("on", _BASE), ("back", _BACK)):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SLICE_BYTES, b)]))
    return _powers["on"][:n], _powers["back"][:n]


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES together; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def _sets_of(texts: list[bytes], words: int) -> list[np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # a line feed ends each text, so no word spans two
    ends = np.cumsum(sizes + 1)
    full = ~_SPACE[data]
    edge = np.diff(full.astype(np.int8), prepend=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return [np.empty(0, np.uint64)] * len(texts)
    on, back = _power(len(data))
    sums = np.cumsum(_TABLE[data] * on)
    word = sums[after - 1] - np.where(first > 0, sums[first - 1], np.uint64(0))
    word = mix(word * back[first] + (after - first).astype(np.uint64))
    owner = np.searchsorted(ends, first, side="right")
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = len(word) - words + 1
    if n > 0:
        gram = word[:n] * _ODD[0]
        for k in range(1, words):
            gram = gram + word[k : k + n] * _ODD[k]
        gram = mix(gram)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:  # fewer words: the whole sequence is one shingle
            out.append(mix((word[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles."""
    return [s for a, b in slices(texts) for s in _sets_of(texts[a:b], words)]
