"""The engine's queries over the driver's tables, and the SQL they are held against.

Compressed bytes differ between builds of zlib, so SQL-checked queries return decoded
bytes, lengths, checksums and structure. Small block sizes give the short texts of the
test tables several blocks each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.checksum import combine_crc
from ..functions.gzip_format import header_column, le_number, trailer_fields
from ..functions.names import derive_paths, parse_size, path_from_stored, ratio, worst
from ..operators.arrow import join_bytes
from ..operators.codec import Settings
from ..operators.decode import concat_blocks, decode, decode_blocks, plan
from ..operators.encode import assemble, chunks, deflate_chunks, encode, sync_points
from ..operators.views import headers, listing, listing_totals, members, verdicts
from ..sources import gzip_files
from ..sources.ranges import read_files
from ..storage import materialise, shared_dir

BLOCK = 512
SMALL = Settings("blocks", BLOCK, cdc=False, least_span=32)
CONTENT = Settings("blocks", 1024, least_span=32)
SAME_TEXT = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the text's bytes; null is empty."""
    raw = F.coalesce("text", F.lit("")).cast("binary").alias("data")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", raw)


def _round_trip(settings: Settings) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", settings)
        return decode(packed).select("doc_id", F.col("data").cast("string").alias("text"))

    return run


def roundtrip_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks deflate as rows of their own and are assembled; the values are cut into
    segments, which inflate as rows of their own."""
    cut = chunks(texts(spark, sf_dir), "doc_id", "data", CONTENT)
    packed = assemble(deflate_chunks(cut, "doc_id", CONTENT), "doc_id")
    blocks, _ = decode_blocks(packed.select("doc_id", "packed"), "doc_id", target=1024)
    return concat_blocks(blocks, "doc_id").select("doc_id", F.col("data").cast("string").alias("text"))


def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as gzip files by the data source and read again: bytes and characters."""
    gzip_files.register(spark)
    where = f"{shared_dir(spark)}/blockloom/files-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    lines.write.format("blockloom").mode("append").save(where)
    back = spark.read.format("blockloom").load(where)
    return back.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("n_bytes"))


def ranged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a few gzip files of small blocks, each read by many ranges: bytes
    and line feeds."""
    gzip_files.register(spark)
    where = f"{shared_dir(spark)}/blockloom/files-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    lines.write.format("blockloom").option("block_size", "8192").mode("append").save(where)
    back = read_files(spark, where, split=128 << 10, target=16 << 10)
    feeds = F.octet_length("payload") - F.octet_length(F.replace(F.col("payload").cast("string"), F.lit("\n"), F.lit("")))
    return back.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.sum(feeds), F.lit(0)).cast("long").alias("n_feeds"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers built in Catalyst and parsed again."""
    docs = texts(spark, sf_dir)
    name = F.concat(F.lit("dir/"), F.col("source"), F.lit(".txt"))
    built = docs.select("doc_id", header_column(F.lit(9), F.lit(0), F.col("doc_id") + 1, name.cast("binary")).alias("packed"))
    return headers(built).select("doc_id", "hdr_state", "hdr_len", "flags", "hdr_mtime", "hdr_name", "xfl", "os")


def trailer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", SMALL)
    t = trailer_fields(F.col("packed"))
    return packed.select("doc_id", t["isize"].alias("isize"), le_number(F.col("packed"), 1, 2).alias("magic"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunks(texts(spark, sf_dir), "doc_id", "data", SMALL, payload=False)
    return cut.select("doc_id", "chunk_idx", "offset", "length", "is_last")


def coalesce_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of at least 2048 raw bytes: stored blocks make their sizes exact."""
    stored = Settings("blocks", BLOCK, cdc=False, level=0)
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", stored)
    planned = plan(packed, "doc_id", target=4 * BLOCK)
    return planned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"))


def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(texts(spark, sf_dir), "doc_id", "data", CONTENT, payload=False)


def gear_sync_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_points(texts(spark, sf_dir), "doc_id", "data", 512, least=32)


def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks cover each text once, none over two blocks."""
    cut = cdc_chunks(spark, sf_dir)
    return cut.groupBy("doc_id").agg(F.sum("length").alias("n_bytes"), (F.max("length") <= 2 * CONTENT.block_size).alias("bounded"))


def block_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = deflate_chunks(chunks(texts(spark, sf_dir), "doc_id", "data", CONTENT), "doc_id", CONTENT)
    return blocks.select("doc_id", "block_idx", "raw_offset", "raw_len", "crc32")


def crc_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums combined from blocks equal those of whole texts."""
    docs = texts(spark, sf_dir)
    whole = docs.select("doc_id", F.crc32("data").alias("whole"))
    both = combine_crc(block_crc32(spark, sf_dir), ["doc_id"], ["block_idx"]).join(whole, "doc_id")
    return both.select("doc_id", "total", (F.col("crc32") == F.col("whole")).alias("same"))


def concat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation, each a member, back to back: one value, decoded whole."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    packed = encode(turns, "data", SMALL)
    parts = F.sort_array(F.collect_list(F.struct("turn", "packed")))["packed"]
    joined = packed.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", join_bytes("parts").alias("packed"))
    return decode(joined).select("conv_id", "members", F.col("data").cast("string").alias("text"))


def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = texts(spark, sf_dir).select("doc_id", F.col("data").alias("packed"))
    return decode(raw).select("doc_id", F.col("data").cast("string").alias("text"))


def trailing_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", SMALL)
    junk = packed.select("doc_id", F.concat("packed", F.lit(bytearray(b"\0\0garbage"))).alias("packed"))
    return decode(junk).select("doc_id", "members", F.col("data").cast("string").alias("text"))


def integrity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value gets one of four fates by its id: whole, cut short, a wrong checksum,
    no gzip at all."""
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", SMALL)
    size = F.octet_length("packed")
    fate = F.pmod("doc_id", F.lit(4))
    damaged = (
        F.when(fate == 0, F.col("packed"))
        .when(fate == 1, F.substring("packed", F.lit(1), size - 9))
        .when(fate == 2, _flipped_crc(F.col("packed"), size))
        .otherwise(F.lit(bytearray(b"not gzip")))
    )
    seen = verdicts(packed.select("doc_id", damaged.alias("packed")))
    return seen.select("doc_id", "status", "err_code", "message")


def _flipped_crc(packed, size):
    """The value with all bits of its stored checksum turned over."""
    crc = (F.lit(fixed.U32) - le_number(packed, -8, 4)).cast("long")
    h = F.lpad(F.hex(crc), 8, "0")
    turned = F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(3, -1, -1)]))
    return F.concat(F.substring(packed, F.lit(1), size - 8), turned, F.substring(packed, -4, 4))


def null_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", SMALL)
    return verdicts(packed).select("doc_id", "members", "total_out", "status")


def sized_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", Settings("bgzf", BLOCK))
    found = members(packed, "doc_id")
    return found.select("doc_id", "member_idx", "isize", "layout")


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker pairs found again: as many segments as there are blocks."""
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", SMALL)
    return plan(packed, "doc_id", target=1).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"))


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".gz"))
    return encode(texts(spark, sf_dir).select(name.alias("path"), "data"), "data", SMALL)


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(_archive(spark, sf_dir)).select("name", "method", "uncompressed", "status")


def listing_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing_totals(materialise(listing(_archive(spark, sf_dir)), "listing"))
    return found.select("name", "uncompressed", "is_total")


def path_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from suppliers and parts; brands that end in an even digit carry the suffix."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("in/"), "p_brand", F.when(F.col("p_size") % 2 == 0, F.lit(".gz")).otherwise("")).alias("path"))
    p = parts.select("p_partkey", "path", derive_paths(F.col("path"), F.lit(True)).alias("d"), derive_paths(F.col("path"), F.lit(False)).alias("c"))
    stored = path_from_stored(F.col("d.out_path"), F.col("d.in_path"), F.lit("else/where.txt"))
    return p.select("p_partkey", F.col("d.in_path").alias("from_path"), F.col("d.out_path").alias("to_path"), F.col("c.out_path").alias("packed_path"), stored.alias("stored_path"))


def size_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("M"), F.lit("G"), F.lit("KB")), (F.col("p_partkey") % 5 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), unit)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("size_text"), parse_size(text).alias("n_bytes"))


def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", fixed.WARNING).when(F.col("value") > 99, fixed.ERROR).otherwise(fixed.OK)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(worst(status).cast("int").alias("exit_status"))


def ratio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    r = ratio(F.col("l_discount"), F.col("l_quantity"))
    return lines.select("l_orderkey", "l_linenumber", F.round(r, 6).alias("saved"))


def segment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks decoded in segments, verdict by verdict."""
    packed = encode(texts(spark, sf_dir).select("doc_id", "data"), "data", SMALL)
    _, seen = decode_blocks(packed, "doc_id", target=1)
    return seen.select("doc_id", "members", "total", "status")


def false_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blocks whose data holds marker pairs, decoded in segments: cut at the false
    boundaries, merged again."""
    planted = F.concat("data", F.lit(bytearray(2 * fixed.MARKER_PAIR)), "data")
    packed = encode(texts(spark, sf_dir).select("doc_id", planted.alias("data")), "data", Settings("blocks", 4096, cdc=False, level=0))
    blocks, _ = decode_blocks(packed, "doc_id", target=1)
    back = concat_blocks(blocks, "doc_id")
    half = F.substring("data", F.lit(1), ((F.octet_length("data") - 2 * len(fixed.MARKER_PAIR)) / 2).cast("int"))
    return back.select("doc_id", half.cast("string").alias("text"))


def shared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition: how many chunks of the corpus are there more than once, and their bytes."""
    cut = chunks(texts(spark, sf_dir), "doc_id", "data", CONTENT)
    per = cut.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    return per.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_chunks"), F.sum((F.col("n") - 1) * F.col("length")).alias("saved_bytes"))


def compression_ratio_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition: saved per cent by language at two levels."""
    docs = texts(spark, sf_dir).select("lang", F.octet_length("data").cast("long").alias("raw"), F.col("data"))
    both = [encode(docs, "data", Settings("stream", level=n)).select("lang", "raw", F.lit(n).alias("level"), F.octet_length("packed").cast("long").alias("packed")) for n in (1, 9)]
    sums = both[0].unionByName(both[1]).groupBy("lang", "level").agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"))
    return sums.withColumn("saved", ratio(F.col("packed_bytes"), F.col("raw_bytes")))


def decoded_lang_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: texts encoded as blocks, decoded, verified and summed by language."""
    packed = encode(texts(spark, sf_dir).select("doc_id", "lang", "data"), "data", CONTENT)
    good = decode(packed).filter(F.col("status") == fixed.OK)
    return good.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("total_out").alias("n_bytes"), F.sum(F.char_length(F.col("data").cast("string"))).cast("long").alias("n_chars"))


def decoded_event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition: JSON payloads decoded, then aggregated by plain Spark."""
    events = table(spark, sf_dir, "events").select("event_type", F.coalesce("props", F.lit("")).cast("binary").alias("data"))
    back = decode(encode(events, "data", Settings("stream")))
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("total_out").alias("n_bytes"))


LAYOUTS = {
    "roundtrip_stream": Settings("stream"),
    "roundtrip_sync_stream": Settings("stream", sync_points=True),
    "roundtrip_blocks": SMALL,
    "roundtrip_content_blocks": CONTENT,
    "roundtrip_bgzf": Settings("bgzf", 4096),
    "roundtrip_migz": Settings("migz", 4096),
    "roundtrip_raw": Settings("raw"),
    "roundtrip_filtered": Settings("blocks", 4096, strategy="filtered"),
    "roundtrip_huffman": Settings("blocks", 4096, strategy="huffman"),
    "roundtrip_rle": Settings("blocks", 4096, strategy="rle"),
    "roundtrip_fixed": Settings("blocks", 4096, strategy="fixed"),
    "roundtrip_stored": Settings("blocks", 4096, level=0),
}
PLAIN = [
    roundtrip_parallel, file_roundtrip, ranged_files, header_fields, trailer_sizes, fixed_chunks, coalesce_groups, cdc_chunks,
    gear_sync_points, chunk_cover, block_crc32, crc_combine, concat_members, passthrough, trailing_garbage,
    integrity_verdicts, false_pairs, null_sink, sized_members, segment_counts, segment_status, listing_rows, listing_with_totals,
    path_derive, size_strings, worst_status, ratio_rows, shared_chunks, compression_ratio_by_lang, decoded_lang_totals,
    decoded_event_totals,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _round_trip(s) for name, s in LAYOUTS.items()} | {f.__name__: f for f in PLAIN}


# Gear words by their rule, and the bytes of each text. A mask of m low bits sees the words
# of the last m bytes only.
BYTES = """g AS (SELECT printf('%02X', i) AS hh, i AS b, ('0x' || left(md5(printf('%02X', i)), 8))::BIGINT AS w FROM range(256) t(i)),
    x AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS hhs FROM documents),
    spots AS (SELECT doc_id, unnest(hhs) AS hh, unnest(range(len(hhs))) AS pos FROM x)"""


def _hash(bits: int) -> str:
    """The low bits of the hash at each position: doc_id, pos, h."""
    terms = " + ".join(f"{1 << k} * coalesce(lag(w, {k}) OVER o, 0)" for k in range(1, bits))
    return f"SELECT doc_id, pos, (w + {terms}) & {(1 << bits) - 1} AS h FROM spots JOIN g USING (hh) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)"


# Content-defined chunks of 1024 bytes: the strict mask has 12 bits, the loose one 7.
CUTS = f"""{BYTES}, hashed AS ({_hash(12)}),
    d AS (SELECT x.doc_id, len(any_value(hhs)) AS n, list(pos ORDER BY pos) FILTER (h = 0) AS strict, list(pos ORDER BY pos) FILTER (h & 127 = 0) AS loose
        FROM x LEFT JOIN hashed USING (doc_id) GROUP BY x.doc_id),
    c(doc_id, chunk_idx, a, b, cut) AS (
        SELECT doc_id, -1, 0::BIGINT, 0::BIGINT, '' FROM d
        UNION ALL
        SELECT doc_id, k, s, CASE WHEN p IS NOT NULL THEN p + 1 WHEN q IS NOT NULL THEN q + 1 ELSE least(s + 2048, n) END,
            CASE WHEN p IS NOT NULL THEN 'strict' WHEN q IS NOT NULL THEN 'loose' WHEN s + 2048 <= n THEN 'forced' ELSE 'end' END
        FROM (SELECT d.doc_id, c.chunk_idx + 1 AS k, c.b AS s, n,
                list_filter(strict, lambda v: v >= c.b + 511 AND v < c.b + 1024)[1] AS p,
                list_filter(loose, lambda v: v >= c.b + 1024 AND v < c.b + 2048)[1] AS q
            FROM c JOIN d USING (doc_id) WHERE c.b < n OR c.chunk_idx < 0 AND n = 0)),
    cuts AS (SELECT c.doc_id, chunk_idx, a, b - a AS length, cut, b = n AS is_last FROM c JOIN d USING (doc_id) WHERE chunk_idx >= 0)"""
# A checksum is linear: each byte adds its table word, moved on by the bytes that follow.
CRC = """t(b, k, v) AS (
        SELECT i, -8, i FROM range(256) r(i)
        UNION ALL
        SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 0),
    t0 AS (SELECT b, v FROM t WHERE k = 0),
    moved(b, k, v) AS (
        SELECT b, 0, v FROM t0 UNION ALL SELECT -1, 0, 4294967295
        UNION ALL
        SELECT m.b, m.k + 1, xor(m.v >> 8, t0.v) FROM moved m JOIN t0 ON t0.b = m.v & 255 WHERE m.k < 2048)"""
RAW = "octet_length(encode(coalesce(text, '')))"
MANY = f"greatest(1, ({RAW} + {BLOCK - 1}) // {BLOCK})"
ORACLES = {
    "roundtrip_parallel": SAME_TEXT,
    "file_roundtrip": f"SELECT coalesce(sum({RAW}), 0)::BIGINT AS n_bytes FROM documents",
    "ranged_files": f"""SELECT coalesce(sum({RAW}), 0)::BIGINT AS n_bytes,
        coalesce(sum(length(text) - length(replace(text, chr(10), ''))), 0)::BIGINT AS n_feeds FROM documents""",
    "header_fields": """SELECT doc_id, 'ok' AS hdr_state, (10 + octet_length(encode('dir/' || source || '.txt')) + 1)::INT AS hdr_len,
        8 AS flags, doc_id + 1 AS hdr_mtime, 'dir/' || source || '.txt' AS hdr_name, 2 AS xfl, 3 AS os FROM documents""",
    "trailer_sizes": f"SELECT doc_id, {RAW}::BIGINT AS isize, 35615::BIGINT AS magic FROM documents",
    "fixed_chunks": f"""SELECT doc_id, k::INT AS chunk_idx, (k * {BLOCK})::BIGINT AS "offset",
        least({BLOCK}, n - k * {BLOCK})::BIGINT AS length, k = m - 1 AS is_last
        FROM (SELECT doc_id, {RAW} AS n, {MANY} AS m, unnest(range(0, {MANY})) AS k FROM documents)""",
    # Stored blocks are a little larger than their 512 bytes, so four reach 2048.
    "coalesce_groups": f"SELECT doc_id, (({MANY} + 3) // 4)::BIGINT AS n_segments FROM documents",
    "false_pairs": SAME_TEXT,
    "segment_counts": f"SELECT doc_id, {MANY}::BIGINT AS n_segments FROM documents",
    "segment_status": f"SELECT doc_id, 1::BIGINT AS members, {RAW}::BIGINT AS total, 'ok' AS status FROM documents",
    "chunk_cover": f"SELECT doc_id, {RAW}::BIGINT AS n_bytes, true AS bounded FROM documents",
    "gear_sync_points": f"WITH {BYTES} SELECT doc_id, pos FROM ({_hash(9)}) WHERE h = 0",
    "cdc_chunks": f"""WITH RECURSIVE {CUTS} SELECT doc_id, chunk_idx::INT AS chunk_idx, a AS "offset", length, cut, is_last FROM cuts""",
    "shared_chunks": f"""WITH RECURSIVE {CUTS}, per AS (
            SELECT count(*) AS n, any_value(length) AS length FROM cuts JOIN x USING (doc_id)
            GROUP BY array_to_string(hhs[a + 1 : a + length], ''))
        SELECT count(*) AS n_distinct, sum(n)::BIGINT AS n_chunks, sum((n - 1) * length)::BIGINT AS saved_bytes FROM per""",
    "block_crc32": f"""WITH RECURSIVE {CUTS}, {CRC}, bits AS (
            SELECT cuts.doc_id, chunk_idx, bit_xor(v) AS v FROM cuts
            JOIN spots ON spots.doc_id = cuts.doc_id AND pos >= a AND pos < a + length JOIN g USING (hh)
            JOIN moved ON moved.b = g.b AND moved.k = a + length - 1 - pos GROUP BY ALL)
        SELECT cuts.doc_id, cuts.chunk_idx::INT AS block_idx, a AS raw_offset, length AS raw_len,
            xor(xor(z.v, coalesce(bits.v, 0)), 4294967295)::BIGINT AS crc32
        FROM cuts JOIN moved z ON z.b = -1 AND z.k = length LEFT JOIN bits ON bits.doc_id = cuts.doc_id AND bits.chunk_idx = cuts.chunk_idx""",
    "crc_combine": f"SELECT doc_id, {RAW}::BIGINT AS total, true AS same FROM documents",
    "concat_members": """SELECT conv_id, count(*)::INT AS members, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    "passthrough": SAME_TEXT,
    "trailing_garbage": "SELECT doc_id, 1 AS members, coalesce(text, '') AS text FROM documents",
    "integrity_verdicts": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ok' ELSE 'error' END AS status,
        CASE doc_id % 4 WHEN 1 THEN 'Z_BUF_ERROR' WHEN 2 THEN 'Z_DATA_ERROR' WHEN 3 THEN 'Z_DATA_ERROR' END AS err_code,
        CASE doc_id % 4 WHEN 1 THEN 'unexpected end of file' WHEN 2 THEN 'crc mismatch' WHEN 3 THEN 'not in gzip format' END AS message
        FROM documents""",
    "null_sink": f"SELECT doc_id, 1 AS members, {RAW}::BIGINT AS total_out, 'ok' AS status FROM documents",
    "sized_members": f"""SELECT doc_id, k::INT AS member_idx, least({BLOCK}, n - k * {BLOCK})::BIGINT AS isize, 'sized' AS layout
        FROM (SELECT doc_id, {RAW} AS n, unnest(range(0, {MANY})) AS k FROM documents)""",
    "listing_rows": f"SELECT 'doc-' || doc_id AS name, 'defla' AS method, {RAW}::BIGINT AS uncompressed, 'ok' AS status FROM documents",
    "listing_with_totals": f"""SELECT 'doc-' || doc_id AS name, {RAW}::BIGINT AS uncompressed, false AS is_total FROM documents
        UNION ALL SELECT '(totals)', sum({RAW})::BIGINT, true FROM documents HAVING count(*) >= 2""",
    "path_derive": """SELECT p_partkey, CASE WHEN z THEN path ELSE path || '.gz' END AS from_path,
        CASE WHEN z THEN left(path, length(path) - 3) ELSE path END AS to_path, path || '.gz' AS packed_path,
        'in/where.txt' AS stored_path
        FROM (SELECT p_partkey, p_size % 2 = 0 AS z, 'in/' || p_brand || CASE WHEN p_size % 2 = 0 THEN '.gz' ELSE '' END AS path FROM part)""",
    "size_strings": """SELECT p_partkey, size_text, CASE WHEN u = 4 OR n > 268435456 THEN 0 ELSE n END AS n_bytes
        FROM (SELECT p_partkey, p_partkey % 5 AS u, p_size || ['', 'k', 'M', 'G', 'KB'][p_partkey % 5 + 1] AS size_text,
            p_size::BIGINT * [1024, 1024, 1048576, 1073741824, 0][p_partkey % 5 + 1] AS n FROM part)""",
    "worst_status": """SELECT user_id, CASE max(CASE WHEN event_type = 'purchase' THEN 1 WHEN value > 99 THEN 2 ELSE 0 END)
        WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS exit_status FROM events GROUP BY user_id""",
    "ratio_rows": """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity = 0 THEN 0.0
        ELSE 100.0::DOUBLE * (1.0::DOUBLE - l_discount / l_quantity) END, 6) AS saved FROM lineitem""",
    "decoded_lang_totals": f"""SELECT lang, count(*) AS n, sum({RAW})::BIGINT AS n_bytes, sum(length(coalesce(text, '')))::BIGINT AS n_chars
        FROM documents GROUP BY lang""",
    "decoded_event_totals": """SELECT event_type, count(*) AS n, sum(octet_length(encode(coalesce(props, ''))))::BIGINT AS n_bytes
        FROM events GROUP BY event_type""",
}


def oracle_sql() -> dict[str, str]:
    return {name: SAME_TEXT for name in LAYOUTS} | ORACLES
