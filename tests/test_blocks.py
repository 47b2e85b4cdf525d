"""Cuts, encode, decode, repair, verdicts; held against plain Python."""

import gzip
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import fixed
from blockloom.functions.checksum import combine_crc, shifted
from blockloom.functions.gear import content_cuts, gear_hashes, gear_table, hashes_at, hits, span_mask
from blockloom.operators import codec
from blockloom.operators.codec import Settings, decode, encode
from blockloom.operators.decode import concat_blocks, decode_blocks
from blockloom.operators.decode import decode as decode_rows
from blockloom.operators.encode import assemble, chunks, deflate_chunks
from blockloom.operators.views import listing, listing_totals, members, verdicts


def varied(n, seed=11):
    """Printable bytes that don't repeat."""
    return bytes(random.Random(seed).choices(range(32, 96), k=n))


LAYOUTS = [Settings(k, 4096, cdc=c, least_span=32) for k in ("stream", "blocks", "bgzf", "migz") for c in (True, False)] + [
    Settings("stream", sync_points=True),
    *(Settings("blocks", 1000, strategy=s, level=n) for s in fixed.STRATEGIES for n in (0, 1, 9)),
]


def brute_hashes(data):
    g, h, out = gear_table(), 0, []
    for b in data:
        h = ((h << 1) + int(g[b])) & fixed.U32
        out.append(h)
    return out


def brute_cuts(data, block, least):
    h, out, at = brute_hashes(data), [], 0
    strict, loose = span_mask(4 * block, least), span_mask(block // 8, least)
    while at < len(data):
        end, kind = len(data), "end"
        for p in range(at, len(data)):
            n = p + 1 - at
            if block // 2 <= n <= block and h[p] & strict == 0:
                end, kind = p + 1, "strict"
            elif block < n <= 2 * block and h[p] & loose == 0:
                end, kind = p + 1, "loose"
            elif n == 2 * block:
                end, kind = p + 1, "forced"
            else:
                continue
            break
        out.append((at, end - at, kind))
        at = end
    return out


@pytest.mark.parametrize("data", [b"", b"a", varied(70000), bytes(5000), varied(900) + bytes(3000)])
def test_gear_and_cuts_equal_the_plain_recurrence(data):
    assert list(gear_hashes(data)) == brute_hashes(data)
    for block in (64, 1024):
        assert content_cuts(data, block, 32) == brute_cuts(data, block, 32)


@pytest.mark.parametrize("size", [0, 1, 15, 16, 31, 32, 32767, 32768, 32800, 200_001])
def test_hits_equal_those_of_whole_hashes(size):
    for data in (varied(size), bytes(size), bytes(random.Random(size).choices(range(3), k=size))):
        assert list(hashes_at(data, np.arange(size))) == list(gear_hashes(data))
        for mask in (0, 1, 255, 4095, 0xFFFF, 0x1FFFF, (1 << 20) - 1):
            assert list(hits(data, mask)) == [p for p, h in enumerate(gear_hashes(data)) if h & mask == 0]


def test_cuts_survive_an_edit():
    data = varied(400_000)
    edited = data[:100_000] + b"U" * 100 + data[100_000:]
    s = Settings("blocks", 4096)
    a, b = encode(data, s), encode(edited, s)
    common = next(k for k, (x, y) in enumerate(zip(a[-9::-1], b[-9::-1])) if x != y)
    assert common > min(len(a), len(b)) / 4


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(LAYOUTS))
def test_every_layout_is_ordinary_gzip(data, s):
    packed = encode(data, s)
    assert gzip.decompress(packed) == data
    d = decode(packed)
    assert d.data == data and d.code is None


def test_structure():
    data = varied(30_000)
    assert fixed.MARKER_PAIR not in encode(data, Settings("stream", sync_points=True))
    assert len(encode(b"", Settings("blocks"))) == 20
    assert len(encode(data, Settings("blocks", level=1))) > len(encode(data, Settings("blocks", level=9)))
    with pytest.raises(ValueError):
        Settings(block_size=0)
    with pytest.raises(ValueError):
        Settings(level=10)


def test_damage_and_neighbours():
    data, s = varied(50_000), Settings("bgzf", 0x8000)
    packed = encode(data, s)
    for cut in (14, 500, len(packed) // 2, len(packed) - 9, len(packed) - 1):
        assert decode(packed[:cut]).code == codec.BUF_ERROR
    one = encode(data, Settings("blocks", 4096))
    assert decode(one + one).data == data + data
    assert decode(one + b"\0junk").data == data
    assert decode(one[:-8] + bytes(4) + one[-4:]).code == codec.DATA_ERROR
    assert decode(one[:-4] + bytes(4)).message == "length mismatch"
    assert decode(b"plain").data == b"plain" and decode(b"").data == b""


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8))
def test_crc_shift(parts):
    import numpy as np

    whole, got = b"".join(parts), 0
    for k, p in enumerate(parts):
        after = len(b"".join(parts[k + 1 :]))
        got ^= int(shifted(np.array([zlib.crc32(p)]), np.array([after]))[0])
    assert got == zlib.crc32(whole)


def values():
    """Key, packed and what it decodes to, with false boundaries and odd layouts."""
    rng, plain = random.Random(5), varied(60_000)
    planted = plain[:20_000] + fixed.MARKER_PAIR + plain[20_000:40_000] + fixed.MARKER_PAIR * 2 + plain[40_000:]
    stored = encode(planted, Settings("blocks", 8192, cdc=False, level=0))
    blocks = encode(plain, Settings("blocks", 4096))
    lone = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = b"".join(lone.compress(plain[k : k + 5000]) + lone.flush(zlib.Z_SYNC_FLUSH) for k in range(0, 60_000, 5000)) + lone.flush()
    bgzf = encode(plain, Settings("bgzf", 4096))
    out = {
        "planted": (stored, planted), "blocks": (blocks, plain), "two": (blocks + stored, plain + planted), "lone": (flushed, plain),
        "bgzf": (bgzf, plain), "migz": (encode(plain, Settings("migz", 4096)), plain), "mixed": (bgzf + blocks, plain * 2),
        "raw": (plain, plain), "empty": (b"", b""), "nothing": (encode(b"", Settings("blocks")), b""),
        "garbage": (blocks + b"\0\0rest", plain),
    }
    noise = bytes(rng.randrange(256) for _ in range(3000))
    out["noise"] = (encode(noise + fixed.MARKER_PAIR + noise, Settings("blocks", 512, cdc=False, level=0)), noise + fixed.MARKER_PAIR + noise)
    return out


def test_parallel_decode_repairs_false_boundaries(spark):
    rows = [(k, bytearray(p)) for k, (p, _) in values().items()]
    df = spark.createDataFrame(rows, "key string, packed binary")
    blocks, seen = decode_blocks(df, "key", target=512)
    got = {r.key: bytes(r.data) for r in concat_blocks(blocks, "key").collect()}
    assert got == {k: d for k, (_, d) in values().items()}
    assert {r.key: r.status for r in seen.collect()} == dict.fromkeys(values(), "ok")
    whole = {r.key: (bytes(r.data), r.status) for r in decode_rows(df).collect()}
    assert whole == {k: (d, "ok") for k, (_, d) in values().items()}


def test_parallel_decode_finds_damage(spark):
    one = encode(varied(30_000), Settings("blocks", 2048))
    half = len(one) // 2
    rows = [
        ("cut", one[:half], codec.BUF_ERROR), ("crc", one[:-8] + bytes(4) + one[-4:], codec.DATA_ERROR),
        ("size", one[:-4] + bytes(4), codec.DATA_ERROR), ("good", one, None),
    ]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b, _ in rows], "key string, packed binary")
    _, seen = decode_blocks(df, "key", target=1024)
    assert {r.key: r.err_code for r in seen.collect()} == {k: c for k, _, c in rows}
    assert {r.key: r.err_code for r in verdicts(df).collect()} == {k: c for k, _, c in rows}


def test_blocks_as_rows_assemble_to_the_same_bytes(spark):
    data = {k: varied(n, 7 + n) for k, n in enumerate((0, 1, 900, 30_000))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "key int, data binary")
    s = Settings("blocks", 1024, least_span=32)
    cut = chunks(df, "key", "data", s)
    packed = {r.key: bytes(r.packed) for r in assemble(deflate_chunks(cut, "key", s), "key").collect()}
    assert packed == {k: encode(v, s) for k, v in data.items()}
    sums = {r.key: (r.crc32, r.total) for r in combine_crc(deflate_chunks(cut, "key", s), ["key"], ["block_idx"]).collect()}
    assert sums == {k: (zlib.crc32(v), len(v)) for k, v in data.items()}


def test_flush_points_and_nulls(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdef"), [2, 4]), (2, None, None)], "key int, data binary, at array<long>")
    got = chunks(df, "key", "data", Settings("blocks", 100), flush="at").orderBy("chunk_idx").collect()
    assert [(r.offset, r.length, r.cut) for r in got] == [(0, 2, "flush"), (2, 2, "flush"), (4, 2, "end")]


def test_listing_members_and_totals(spark):
    one = encode(b"x" * 1000, Settings("bgzf", 400), 7, b"stored")
    df = spark.createDataFrame([("a.gz", bytearray(one)), ("b.gz", bytearray(b"short")), ("c.gz", bytearray(encode(b"yy", Settings("stream"))))], "path string, packed binary")
    assert [(r.member_idx, r.isize) for r in members(df.filter("path = 'a.gz'"), "path").collect()] == [(0, 400), (1, 400), (2, 200)]
    assert {r.name: (r.uncompressed, r.status) for r in listing(df).collect()} == {"a": (200, "ok"), "b": (None, "error"), "c": (2, "ok")}
    exact = listing(df, stored_names=True, exact=True)
    assert {r.name: r.uncompressed for r in exact.collect()} == {"stored": 1000, "b": None, "c": 2}
    assert [(r.name, r.uncompressed) for r in listing_totals(exact).filter("is_total").collect()] == [("(totals)", 1002)]
    assert listing_totals(exact.filter("name = 'c'")).filter("is_total").isEmpty()


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, "keep", bytearray(b"abc"))], "id int, other string, packed binary")
    r = decode_rows(df).first()
    assert (r.id, r.other, bytes(r.data), r.layout) == (1, "keep", b"abc", "passthru")
    assert decode_rows(df.filter(F.lit(False))).count() == 0


def test_null_keys_and_values(spark):
    raw = {None: varied(3000, 5), "a": varied(2000), "b": None, "c": b""}
    rows = [(k, None if v is None else encode(v, Settings("blocks", 500, cdc=False))) for k, v in raw.items()]
    df = spark.createDataFrame(rows, "key string, packed binary")
    blocks, seen = decode_blocks(df, "key", target=1)
    assert {r.key: (r.status, r.total) for r in seen.collect()} == {None: ("ok", 3000), "a": ("ok", 2000), "b": ("ok", 0), "c": ("ok", 0)}
    assert {r.key: bytes(r.data) for r in concat_blocks(blocks, "key").collect()} == {k: v for k, v in raw.items() if v is not None}
    strict = {r.key: (r.status, r.message) for r in verdicts(df).collect()}
    assert strict["b"] == ("error", "not in gzip format") and strict[None] == ("ok", None)
    assert {r.key: r.status for r in verdicts(df, strict=False).collect()}["b"] == "ok"


def test_large_blocks_are_decoded_as_streams(spark):
    data = varied(60_000)
    rows = [("large", encode(data, Settings("blocks", 20_000, cdc=False))), ("small", encode(data, Settings("blocks", 900, cdc=False)))]
    blocks, seen = decode_blocks(spark.createDataFrame(rows, "key string, packed binary"), "key", target=1, limit=5000)
    assert {r.key: (r.status, r.total) for r in seen.collect()} == {"large": ("ok", 60_000), "small": ("ok", 60_000)}
    assert all(bytes(r.data) == data for r in concat_blocks(blocks, "key").collect())


def test_the_test_mode_keeps_nothing():
    packed = gzip.compress(bytes(50 << 20))
    d = decode(packed, keep=False)
    assert d.parts == [] and d.size == 50 << 20 and d.members == 1 and d.code is None


def test_columns_named_like_the_outcome_are_replaced(spark):
    df = spark.createDataFrame([(encode(b"abc", Settings("stream")), "x", "y", 7)], "packed binary, members string, status string, other int")
    row = decode_rows(df).first()
    assert (row.members, row.status, row.other, bytes(row.data)) == (1, "ok", 7, b"abc")
    assert len(row) == len(set(row.__fields__))
