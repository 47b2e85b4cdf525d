"""What one task does to bytes: deflate blocks, cut segments, inflate and classify them.

Plain functions over bytes; the operators run them in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions import fixed
from ..functions.gear import content_cuts, fixed_cuts, hits
from ..functions.gzip_format import Header, NotGzip, build_header, parse_header, trailer

STEP = 1 << 20  # bytes handed to zlib at a time
BGZF_PAYLOAD = 0xFF00

# How a segment ended.
FULL, END, SHORT, OVERFLOW, ERROR = "FULL", "END", "SHORT", "OVERFLOW", "ERROR"
# Error codes as zlib names them.
DATA_ERROR, BUF_ERROR = "Z_DATA_ERROR", "Z_BUF_ERROR"


# -- deflate --------------------------------------------------------------------------


def deflate_block(data: bytes, level: int, strategy: int, last: bool) -> bytes:
    """One independent block: ends in a marker pair, or ends the stream if it is the last."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15, 8, strategy)
    body = z.compress(data)
    if last:
        return body + z.flush(zlib.Z_FINISH)
    return body + z.flush(zlib.Z_SYNC_FLUSH) + z.flush(zlib.Z_FULL_FLUSH)


def deflate_stream(data: bytes, level: int, strategy: int, sync: bool) -> bytes:
    """A single stream; with ``sync``, flushed wherever the content's hash hits."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15, 8, strategy)
    if not sync:
        return z.compress(data) + z.flush(zlib.Z_FINISH)
    out, at = [], 0
    for p in hits(data, fixed.STREAM_SYNC_SPAN - 1):
        out += [z.compress(data[at : p + 1]), z.flush(zlib.Z_SYNC_FLUSH)]
        at = int(p) + 1
    return b"".join([*out, z.compress(data[at:]), z.flush(zlib.Z_FINISH)])


@dataclass(frozen=True)
class Settings:
    """How to encode; the engine's counterpart of the command line's options."""

    layout: str = "blocks"  # stream, blocks, bgzf, migz or raw
    block_size: int = fixed.DEFAULT_BLOCK
    cdc: bool = True
    level: int = fixed.DEFAULT_LEVEL
    strategy: str = "default"
    sync_points: bool = False
    least_span: int = fixed.SPAN_MIN

    def __post_init__(self):
        if self.layout not in ("stream", "blocks", "bgzf", "migz", "raw"):
            raise ValueError(f"unknown layout {self.layout!r}")
        if self.strategy not in fixed.STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if not 0 <= self.level <= 9:
            raise ValueError("level must be 0 to 9")
        if not 0 < self.block_size <= fixed.MAX_BLOCK:
            raise ValueError("block_size must be 1 byte to 256 MiB")

    def cuts(self, data: bytes) -> list[tuple[int, int, str]]:
        if self.cdc:
            return content_cuts(data, self.block_size, self.least_span)
        return fixed_cuts(len(data), self.block_size)


def split_at(cuts: list[tuple[int, int, str]], flushes: list[int]) -> list[tuple[int, int, str]]:
    """Chunks that end at the flush points as well (the caller's own cuts)."""
    out, points = [], sorted(set(flushes))
    for at, size, kind in cuts:
        for p in [p for p in points if at < p < at + size]:
            out.append((at, p - at, "flush"))
            size, at = at + size - p, p
        out.append((at, size, kind))
    return out


def encode(data: bytes, s: Settings, mtime: int = 0, name: bytes | None = None) -> bytes:
    """A whole value in the layout that ``s`` names."""
    if s.layout == "raw":
        return data
    strategy = fixed.STRATEGIES[s.strategy]
    if s.layout in ("bgzf", "migz"):
        return b"".join(_sized_members(data, s, mtime, name))
    head = build_header(s.level, strategy, mtime, name)
    if s.layout == "stream":
        body = deflate_stream(data, s.level, strategy, s.sync_points)
    else:
        cuts = s.cuts(data) or [(0, 0, "end")]
        body = b"".join(deflate_block(data[a : a + n], s.level, strategy, k + 1 == len(cuts)) for k, (a, n, _) in enumerate(cuts))
    return head + body + trailer(zlib.crc32(data), len(data))


def _sized_members(data: bytes, s: Settings, mtime: int, name: bytes | None) -> Iterator[bytes]:
    bgzf = s.layout == "bgzf"
    size = min(s.block_size, BGZF_PAYLOAD) if bgzf else s.block_size
    strategy = fixed.STRATEGIES[s.strategy]
    for at in range(0, max(len(data), 1), size):
        part = data[at : at + size]
        body = deflate_block(part, s.level, strategy, True)
        first = name if at == 0 else None
        if bgzf:
            whole = len(build_header(s.level, strategy, mtime, first, b"BC\2\0\0\0")) + len(body) + fixed.TRAILER_LEN
            extra = b"BC\2\0" + (whole - 1).to_bytes(2, "little")
        else:
            extra = b"MZ\4\0" + len(body).to_bytes(4, "little")
        yield build_header(s.level, strategy, mtime, first, extra) + body + trailer(zlib.crc32(part), len(part))


# -- planning -------------------------------------------------------------------------


def pair_ends(data: bytes, start: int) -> Iterator[int]:
    """Ends of marker pairs, each with all empty blocks that follow it."""
    at = data.find(fixed.MARKER_PAIR, start)
    while at >= 0:
        end = at + len(fixed.MARKER_PAIR)
        while data.startswith(fixed.EMPTY_BLOCK, end):
            end += len(fixed.EMPTY_BLOCK)
        yield end
        at = data.find(fixed.MARKER_PAIR, end)


def coalesce(lengths: list[int], target: int) -> list[int]:
    """Group number of each of a run of chunks: a group closes when it has ``target`` bytes."""
    out, group, size = [], 0, 0
    for n in lengths:
        out.append(group)
        size += n
        if size >= target:
            group, size = group + 1, 0
    return out


def cut_segments(data: bytes, start: int, target: int = fixed.COALESCE_TARGET) -> list[tuple[int, int]]:
    """(offset, length) of candidate segments from ``start`` to the end of ``data``."""
    bounds = [start, *pair_ends(data, start)]
    if bounds[-1] < len(data):
        bounds.append(len(data))
    lengths = [b - a for a, b in zip(bounds, bounds[1:])]
    out: list[tuple[int, int]] = []
    last = -1
    for g, a, n in zip(coalesce(lengths, target), bounds, lengths):
        if g == last:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((a, n))
        last = g
    return out


def layout_of(data: bytes, header: Header | None, at: int = 0) -> str:
    """How the member at ``at`` is best decoded: sized, blocks or stream."""
    if header is None or header.length > fixed.HEADER_BUFFER_MAX:
        return "stream"
    if header.member_size and header.member_size >= header.length + fixed.TRAILER_LEN:
        return "sized" if at + header.member_size <= len(data) else "stream"
    body = at + header.length
    probe = data.find(fixed.MARKER_PAIR, body, body + fixed.PROBE_WINDOW)
    return "blocks" if probe >= 0 else "stream"


# -- inflate --------------------------------------------------------------------------


@dataclass
class Piece:
    """What one segment holds of one member."""

    data: bytes
    crc: int
    ended: bool = False  # the member ends here, and its trailer says:
    want_crc: int | None = None
    want_size: int | None = None


@dataclass
class Segment:
    pieces: list[Piece] = field(default_factory=list)
    status: str = FULL
    used: int = 0
    done: bool = False  # nothing after this belongs to the data


def inflate_segment(seg: bytes, last: bool, limit: int = fixed.MAX_BLOCK) -> Segment:
    """Inflate all that starts at a block boundary of a member.

    Members that end inside are closed with their trailers and the next one's header is
    read. FULL: ends just past a block, on a byte boundary; which zlib tells by accepting
    a final empty block there. END: the data ends here. SHORT: ends inside a block, or
    inside a trailer or header."""
    out, pos = Segment(), 0
    while True:
        z = zlib.decompressobj(-15)
        try:
            data = z.decompress(memoryview(seg)[pos:], limit + 1)
        except zlib.error:
            out.status, out.used = ERROR, pos
            return out
        if len(data) > limit:
            out.status, out.used = OVERFLOW, pos
            return out
        piece = Piece(data, zlib.crc32(data))
        if not z.eof:
            out.pieces.append(piece)
            probe = z.copy()
            try:
                more = probe.decompress(fixed.FINAL_EMPTY_BLOCK)
                whole = probe.eof and not more and not probe.unused_data
            except zlib.error:
                whole = False
            out.status, out.used = (FULL if whole else SHORT), len(seg)
            return out
        pos = len(seg) - len(z.unused_data)
        tail = z.unused_data[: fixed.TRAILER_LEN]
        if len(tail) < fixed.TRAILER_LEN:
            out.pieces.append(piece)
            out.status, out.used = SHORT, pos
            return out
        piece.ended = True
        piece.want_crc, piece.want_size = int.from_bytes(tail[:4], "little"), int.from_bytes(tail[4:], "little")
        out.pieces.append(piece)
        pos += fixed.TRAILER_LEN
        rest = len(seg) - pos
        if last and rest == 0 or rest >= 2 and not seg.startswith(fixed.MAGIC, pos):
            out.status, out.used, out.done = END, pos, True
            return out
        try:
            head = parse_header(seg, pos) if rest >= 2 else None
        except NotGzip:
            out.status, out.used = ERROR, pos
            return out
        if head is None:
            if last and rest < 2:  # a byte of garbage
                out.status, out.used, out.done = END, pos, True
            else:
                out.status, out.used = SHORT, pos
            return out
        pos += head.length


@dataclass
class Decoded:
    parts: list[bytes]
    members: int = 0
    code: str | None = None
    message: str | None = None
    used: int = 0
    layout: str = "stream"
    size: int = 0  # decoded bytes, kept or not

    @property
    def data(self) -> bytes:
        return b"".join(self.parts)


def decode(data: bytes, keep: bool = True) -> Decoded:
    """A whole value, member after member, checked against their trailers.

    What isn't gzip passes unchanged; garbage after a member is ignored. With ``keep``
    false nothing is kept but the verdict. What was good before an error is returned."""
    out, pos = Decoded([]), 0

    def fail(code: str, message: str) -> Decoded:
        out.code, out.message, out.used = code, message, pos
        return out

    view = memoryview(data)
    while pos < len(data):
        if not data.startswith(fixed.MAGIC, pos):
            if not out.members:
                out.layout, out.size = "passthru", len(data)
                if keep:
                    out.parts.append(data)
            break
        try:
            head = parse_header(data, pos)
        except NotGzip:
            return fail(DATA_ERROR, "not in gzip format")
        if head is None:
            return fail(BUF_ERROR, "unexpected end of file")
        if not out.members:
            out.layout = layout_of(data, head, pos)
        at, crc, size, z = pos + head.length, 0, 0, zlib.decompressobj(-15)
        while not z.eof:
            more = z.unconsumed_tail or view[at : at + STEP]
            if not more:
                return fail(BUF_ERROR, "unexpected end of file")
            if not z.unconsumed_tail:
                at += len(more)
            try:
                part = z.decompress(more, STEP)
            except zlib.error:
                return fail(DATA_ERROR, "corrupt deflate data")
            crc, size = zlib.crc32(part, crc), size + len(part)
            out.size += len(part)
            if keep:
                out.parts.append(part)
        at -= len(z.unused_data)
        if at + fixed.TRAILER_LEN > len(data):
            return fail(BUF_ERROR, "unexpected end of file")
        want = (int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little"))
        if crc != want[0]:
            return fail(DATA_ERROR, "crc mismatch")
        if size & fixed.U32 != want[1]:
            return fail(DATA_ERROR, "length mismatch")
        pos = at + fixed.TRAILER_LEN
        out.members += 1
    out.used = pos
    return out
