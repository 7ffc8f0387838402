"""Vectorised kernels over the UTF-8 bytes of many texts at once.

A ``Block`` holds whole texts, each followed by one line feed that belongs to no
text, so that words never run across texts. All sizes stay within the bytes of
one block; a text longer than ``BLOCK_BYTES`` makes a block of its own.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_P = U64(0x5851F42D4C957F2D)


def _table(seed: int, kind=np.uint64) -> np.ndarray:
    """256 fixed random values from a seed (splitmix steps)."""
    x = (np.arange(1, 257, dtype=U64) * _MULT) + U64(seed)
    return mix(x).astype(kind)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = _table(17)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


LOWER_VALUES = BYTE_VALUES[LOWER]
#: Bytes that are hashed at once.
STRETCH = 1 << 20


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base, up to a stretch, and their inverses."""
    powers, inverse = np.full(STRETCH + 1, _P, U64), np.full(STRETCH + 1, U64(pow(int(_P), -1, 1 << 64)), U64)
    powers[0] = inverse[0] = 1
    return np.cumprod(powers), np.cumprod(inverse)


class Block:
    """Words of some texts: ``starts``/``ends`` are byte places, ``words`` where each text's words begin."""

    def __init__(self, raws: list[bytes]):
        self.n = len(raws)
        self.raws = raws
        self.data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, self.n)
        self.ends_of = np.cumsum(sizes + 1) - 1
        self.starts_of = self.ends_of - sizes

    def find_words(self, apart: np.ndarray = SPACE) -> None:
        """Words are runs of bytes that ``apart`` (which must have the line feed) doesn't set apart."""
        inside = ~apart[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside.size and inside[0]:
            edge = np.concatenate(([0], edge))
        self.inside = inside
        self.starts, self.ends = edge[0::2], edge[1::2]  # the last byte is a space
        self.words = np.searchsorted(self.starts, np.append(self.starts_of, self.data.size))
        self.n_words = np.diff(self.words)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges, sorted and apart, equal for equal bytes wherever they are.

        Ranges are hashed by stretches of ``STRETCH`` bytes, so a very long text takes no more memory than they do.
        """
        values, powers, inverse = (LOWER_VALUES if lower else BYTE_VALUES), *_powers()
        out, lo = np.empty(len(starts), U64), 0
        while lo < len(starts):
            base = int(starts[lo])
            hi = int(np.searchsorted(ends, base + STRETCH, "right"))
            if hi <= lo:  # one range longer than a stretch
                total, scale = 0, 1
                for at in range(base, int(ends[lo]), STRETCH):
                    part = self.data[at : min(at + STRETCH, int(ends[lo]))]
                    total = (total + int((values[part] * powers[: part.size]).sum(dtype=U64)) * scale) % (1 << 64)
                    scale = scale * pow(int(_P), STRETCH, 1 << 64) % (1 << 64)
                out[lo] = total
                lo += 1
                continue
            part = self.data[base : int(ends[hi - 1])]
            sums = np.zeros(part.size + 1, U64)
            np.cumsum(values[part] * powers[: part.size], out=sums[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = (sums[e] - sums[s]) * inverse[s]
            lo = hi
        return mix(out + (ends - starts).astype(U64) * _MULT)

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k words in a row within a text, and the text of each."""
        of = np.repeat(np.arange(self.n), self.n_words)
        if h.size < k:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        out = np.zeros(h.size - k + 1, U64)
        for j in range(k):
            out = out * _P + h[j : h.size - k + 1 + j]
        whole = of[: out.size] == of[k - 1 :]
        self.window_at = np.flatnonzero(whole)
        return mix(out[whole]), of[: out.size][whole]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, Block]]:
    """Blocks of ``texts`` in order, each with the place of its first text; null counts as empty."""
    at, raws, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if raws and size + len(raw) > BLOCK_BYTES:
            yield at, Block(raws)
            at, raws, size = i, [], 0
        raws.append(raw)
        size += len(raw)
    if raws:
        yield at, Block(raws)


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``bounds``."""
    total = np.zeros(values.size + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


GEAR = _table(29, np.uint32)
GEAR[0] = 0
_GAP = b"\0" * 16


def gear_cuts(raws: list[bytes], bits: int, window: int = 16) -> list[np.ndarray]:
    """Cut places of each text: after a byte whose gear hash has ``bits`` leading zeros.

    The hash covers the last ``window`` (a power of two, 16 or less) bytes, so a
    cut depends on these alone and an insertion moves no cut beyond them.
    Texts are set apart by bytes of value zero.
    """
    data = np.frombuffer(_GAP.join(raws) + _GAP, np.uint8)
    h = GEAR[data]
    step = 1
    while step < window:
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
        step *= 2
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    starts = np.cumsum(sizes + len(_GAP)) - sizes - len(_GAP)
    lo, hi = np.searchsorted(at, starts, "right"), np.searchsorted(at, starts + sizes, "left")
    return [at[a:b] - s for a, b, s in zip(lo, hi, starts, strict=True)]


def row_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows ``h[first:end]``, equal for equal values wherever they are."""
    powers = np.full(h.size + 1, _P, U64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    inverse = np.full(h.size + 1, U64(pow(int(_P), -1, 1 << 64)), U64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(h.size + 1, U64)
    np.cumsum(h * powers[:-1], out=sums[1:])
    return mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(U64) * _MULT)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: What a worker process remembers from task to task, by kind: how to forget it.
MEMORIES: dict[str, Callable[[], None]] = {}


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20, memory: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text.

    A task names the ``memory`` it uses; what other operators' tasks have left in its worker goes.
    """
    for kind, forget in MEMORIES.items():
        if kind != memory:
            forget()
    for batch in batches:
        n = batch.num_rows
        step = max(1, int(n * limit / max(1, batch.column(batch.schema.get_field_index(text)).nbytes))) if n else 1
        for at in range(0, n, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as a worker process outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
