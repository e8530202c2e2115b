"""Words and word-sequence hashes of whole texts, vectorised over a block of rows.

A block is an Arrow string array; its UTF-8 bytes are read in place. Hashes are
polynomial sums modulo 2**64 over random byte values, finished by a mixing step, so the
hash of every run of k words comes from two prefix sums, without a loop over words.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

#: ASCII white space: the bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64)
_BYTE_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once; only a longer single text makes a longer block.
BLOCK_BYTES = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def return_freed_memory() -> None:
    """Have this process give large freed arrays and Arrow buffers back to the system at once, instead of keeping them for a later
    task: a worker that is used again by another operator then holds what it works on, not its greatest size so far."""
    if sys.platform == "linux" and pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
        mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc: a fixed size from which an allocation is a mapping of its own
        if mallopt is not None:
            mallopt(-3, 1 << 18)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and its inverses modulo 2**64 (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * len(have[0]) if have is not None else 0)
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (a bijection that spreads every bit)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null reads as empty text."""
    return_freed_memory()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and n+1 offsets that say which words belong to which row."""
    raw, at = string_bytes(column)
    n = len(at) - 1
    out, counts = [], np.zeros(n + 1, np.int64)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK_BYTES, "right")) - 1)
        block, starts_at = raw[at[row]:at[end]], at[row:end + 1] - at[row]
        row_first = row
        row = end
        if not len(block):
            continue
        if lower:
            block = LOWER[block]
        word = ~SPACE[block]
        before, after = np.empty_like(word), np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        inner = starts_at[1:-1]
        inner = inner[(inner > 0) & (inner < len(block))]
        before[inner] = False
        after[inner - 1] = False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = powers(_BYTE_BASE, len(block))
        with np.errstate(over="ignore"):
            sums = np.empty(len(block) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUES[block] * up, out=sums[1:])
            out.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        counts[row_first + 1:end + 1] = np.diff(np.searchsorted(first, starts_at))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def run_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i with i+k <= len(words). A run may cross rows: the caller drops those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words))
    with np.errstate(over="ignore"):
        sums = np.empty(len(words) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(words * up, out=sums[1:])
        return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
