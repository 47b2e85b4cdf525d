"""The data source and the stream over files."""

import gzip
import hashlib

import pytest

from blockloom.functions import fixed
from blockloom.operators.codec import Settings, encode
from blockloom.sources import gzip_files, ranges
from blockloom.sources.ranges import list_files, read_files, segments
from blockloom.streaming.files import decoded_stream


def test_files_round_trip(spark, tmp_path):
    gzip_files.register(spark)
    rows = [(f"line {k}\n" * (k % 50),) for k in range(500)]
    where = str(tmp_path / "out")
    df = spark.createDataFrame(rows, "payload string").repartition(3)
    df.write.format("blockloom").option("block_size", "1024").mode("append").save(where)
    files = sorted((tmp_path / "out").glob("*.gz"))
    assert files and not list((tmp_path / "out").glob(".part*"))
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert sorted(plain.splitlines()) == sorted("".join(r[0] for r in rows).encode().splitlines())
    back = spark.read.format("blockloom").load(where).orderBy("path", "piece_idx").collect()
    assert b"".join(bytes(r.payload) for r in back) == plain
    df.limit(1).write.format("blockloom").mode("overwrite").save(where)
    assert len(list((tmp_path / "out").glob("*.gz"))) < 3


def test_files_of_any_kind(spark, tmp_path):
    gzip_files.register(spark)
    one = encode(b"abc" * 1000, Settings("blocks", 512))
    (tmp_path / "two.gz").write_bytes(one + one + b"\0junk")
    (tmp_path / "plain").write_bytes(b"not gzip")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.gz").write_bytes(encode(b"deep", Settings("bgzf")))

    def read(**options):
        rows = spark.read.format("blockloom").options(**options).load(str(tmp_path)).orderBy("path", "piece_idx").collect()
        out = {}
        for r in rows:
            out[r.path.rsplit("/")[-1]] = out.get(r.path.rsplit("/")[-1], b"") + bytes(r.payload)
        return out

    assert read() == {"two.gz": b"abc" * 2000, "plain": b"not gzip"}
    assert read(recursive="true", suffix=".gz", taskBytes="1") == {"two.gz": b"abc" * 2000, "deep.gz": b"deep"}
    (tmp_path / "bad.gz").write_bytes(one[:-9])
    with pytest.raises(Exception, match="unexpected end of file"):
        read()
    assert read(mode="keep")["bad.gz"] == b"abc" * 1000


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(encode(b"abc", Settings("blocks")))
    (tmp_path / "in" / "b").write_bytes(b"plain")
    q = decoded_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True)
    run = q.option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination()
    assert sorted(bytes(r.data) for r in spark.table("seen").collect()) == [b"abc", b"plain"]


def _by_file(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.raw_offset)):
        name = r.path.rsplit("/")[-1]
        assert len(out.get(name, b"")) == r.raw_offset
        out[name] = out.get(name, b"") + bytes(r.payload)
    return out


def test_ranges_give_what_one_task_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "MOST_TASKS", 8)
    text = b"".join(b"%d apples and %d pears\n" % (k, k * k) for k in range(9000))
    noise = hashlib.shake_128(b"ranges").digest(60_000)
    planted = noise[:20_000] + fixed.MARKER_PAIR * 3 + noise[20_000:40_000] + fixed.MARKER_PAIR + noise[40_000:]
    blocks = encode(text, Settings("blocks", 2048))
    want = {
        "blocks.gz": (blocks, text),
        "two.gz": (blocks + encode(noise, Settings("blocks", 512, cdc=False)), text + noise),
        "garbage.gz": (blocks + b"\0" + noise, text),
        "false.gz": (encode(planted, Settings("blocks", 8192, cdc=False, level=0)), planted),
        "bgzf.gz": (encode(text, Settings("bgzf", 4096)), text),
        "migz.gz": (encode(text, Settings("migz", 4096)), text),
        "nested.gz": (encode(encode(text, Settings("bgzf", 512)), Settings("bgzf", 8192, level=0)), encode(text, Settings("bgzf", 512))),
        "mixed.gz": (encode(text, Settings("bgzf", 4096)) + gzip.compress(noise), text + noise),
        "stream.gz": (gzip.compress(text + noise), text + noise),
        "plain": (noise, noise),
        "empty": (b"", b""),
        "none.gz": (encode(b"", Settings("blocks")), b""),
    }
    for name, (packed, _) in want.items():
        (tmp_path / name).write_bytes(packed)
    for split in (700, 9000):
        found = _by_file(read_files(spark, str(tmp_path), split=split, target=1500))
        assert found == {name: data for name, (_, data) in want.items() if data}
    listing = {r.name: r for r in list_files(spark, str(tmp_path)).collect()}
    assert listing["blocks"].uncompressed == len(text) and listing["blocks"].compressed == len(blocks)
    assert listing["plain"].status == listing["empty"].status == "error"


def test_ranges_find_damage(spark, tmp_path):
    text = b"".join(b"%d apples and %d pears\n" % (k, k * k) for k in range(5000))
    blocks = encode(text, Settings("blocks", 2048))
    (tmp_path / "crc.gz").write_bytes(blocks[:-8] + b"abcd" + blocks[-4:])
    with pytest.raises(Exception, match="mismatch"):
        read_files(spark, str(tmp_path), split=5000, target=1).collect()
    (tmp_path / "crc.gz").write_bytes(blocks[:-20])
    with pytest.raises(Exception, match="unexpected end"):
        read_files(spark, str(tmp_path), split=5000, target=1).collect()
    got = _by_file(read_files(spark, str(tmp_path), split=5000, target=1, strict=False))["crc.gz"]
    assert text.startswith(got) and len(got) > len(text) - 4096


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    text = b"".join(b"%d apples and %d pears\n" % (k, k * k) for k in range(9000))
    for layout in ("blocks", "bgzf"):
        path = tmp_path / f"{layout}.gz"
        path.write_bytes(encode(text, Settings(layout, 2048)))
        cut, good = segments(spark, [(str(path), path.stat().st_size)], 5000, 1, 1 << 20)
        assert good.count() == 1
        assert len({r.offset // 5000 for r in cut.collect()}) > 5
