"""Content-defined cuts by a gear hash: a shift and an addition for each byte.

The hash at a position depends on the last 32 bytes only, so it needs no state across
chunks: a whole buffer is hashed at once by doubling, h over 2n bytes from h over n.

A bit of the hash depends on no higher ones, and its lower 16 on the last 16 bytes only. So
hits are sought with 16-bit words, half as wide and one doubling less, and only where these
fit the mask is the whole hash computed."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from . import fixed

REACH = 32  # bytes that a 32-bit hash remembers
HALF_REACH = 16  # bytes that its lower half remembers
TILE = 1 << 15  # bytes hashed at a time, so that they stay in the cache


@functools.cache
def gear_table() -> np.ndarray:
    """256 words by a rule that SQL can state too: the first eight hex digits of the MD5
    of the byte written as two upper-case hex digits."""
    return np.array([int(hashlib.md5(f"{b:02X}".encode()).hexdigest()[:8], 16) for b in range(256)], np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """The hash after each byte, from the zero state.

    Works through tiles that stay in the cache; each tile starts REACH - 1 bytes early."""
    table = gear_table()
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(len(raw), np.uint32)
    tile = 1 << 16
    for at in range(0, len(raw), tile):
        lead = min(at, REACH - 1)
        v = table[raw[at - lead : at + tile]]
        for k in (1, 2, 4, 8, 16):
            v[k:] = v[k:] + (v[:-k] << np.uint32(k))
        out[at : at + tile] = v[lead:]
    return out


def span_mask(span: int, least: int = fixed.SPAN_MIN) -> int:
    """The mask that hits about every ``span`` bytes: a power of two, rounded up, less one."""
    return (1 << (min(max(span, least), fixed.SPAN_MAX) - 1).bit_length()) - 1


def _low_hits(data: bytes, mask: int) -> np.ndarray:
    """Positions whose hash is zero under the mask's lower 16 bits."""
    raw = np.frombuffer(data, np.uint8)
    table, low, out = gear_table().astype(np.uint16), np.uint16(mask & 0xFFFF), []
    most = min(TILE, len(raw)) + HALF_REACH
    hashes, shifted = np.empty(most, np.uint16), np.empty(most, np.uint16)
    for at in range(0, len(raw), TILE):
        lead = min(at, HALF_REACH - 1)
        part = raw[at - lead : at + TILE]
        v = hashes[: len(part)]
        np.take(table, part, out=v, mode="clip")  # faster than indexing; bytes need no clipping
        for k in (1, 2, 4, 8):
            v[k:] += np.left_shift(v[:-k], k, out=shifted[: max(len(v) - k, 0)])
        out.append(np.flatnonzero((v[lead:] & low) == 0) + at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def hashes_at(data: bytes, positions: np.ndarray) -> np.ndarray:
    """The hash after each of these positions, a bounded number of them at a time."""
    raw, table, back = np.frombuffer(data, np.uint8), gear_table(), np.arange(REACH)
    out = np.empty(len(positions), np.uint32)
    for k in range(0, len(positions), TILE // REACH):
        at = positions[k : k + TILE // REACH, None] - back
        words = table[raw[np.maximum(at, 0)]] << back.astype(np.uint32)
        if at[0, -1] < 0:  # the zero state before the first byte; positions ascend
            words[at < 0] = 0
        words.sum(axis=1, dtype=np.uint32, out=out[k : k + TILE // REACH])
    return out


def hits(data: bytes, mask: int) -> np.ndarray:
    """Positions whose hash is zero under the mask."""
    found = _low_hits(data, mask)
    return found if mask <= 0xFFFF else found[(hashes_at(data, found) & np.uint32(mask)) == 0]


def content_cuts(data: bytes, block: int, least_span: int = fixed.SPAN_MIN) -> list[tuple[int, int, str]]:
    """(offset, length, kind) of content-defined chunks.

    From a chunk's start no cut lies before half a block; the strict mask decides up to a
    block, the loose one up to two, where a cut is forced. Kinds: strict, loose, forced,
    end (what is left)."""
    size = len(data)
    if not size:
        return []
    # Whatever the strict mask hits, the loose one, with fewer bits, hits as well.
    loose = hits(data, span_mask(block // 8, least_span))
    strict = loose[(hashes_at(data, loose) & np.uint32(span_mask(4 * block, least_span))) == 0]
    half = max(block // 2, 1)

    def first(of: np.ndarray, a: int, b: int) -> int | None:
        k = int(np.searchsorted(of, a))
        return int(of[k]) if k < len(of) and of[k] < b else None

    out, at = [], 0
    while at < size:
        if (p := first(strict, at + half - 1, min(at + block, size))) is not None:
            end, kind = p + 1, "strict"
        elif (p := first(loose, at + block, min(at + 2 * block, size))) is not None:
            end, kind = p + 1, "loose"
        elif at + 2 * block <= size:
            end, kind = at + 2 * block, "forced"
        else:
            end, kind = size, "end"
        out.append((at, end - at, kind))
        at = end
    return out


def fixed_cuts(size: int, block: int) -> list[tuple[int, int, str]]:
    return [(at, min(block, size - at), "forced" if at + block <= size else "end") for at in range(0, size, block)]
