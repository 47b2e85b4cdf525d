"""Files to files by options."""

import gzip

from blockloom.operators.codec import Settings, encode
from blockloom.plans.commands import run
from blockloom.plans.options import parse_args
from blockloom.sources.gzip_files import packed


def outcome(df):
    return {r.path.rsplit("/")[-1]: r for r in df.collect()}


def test_there_and_back(spark, tmp_path):
    text = b"".join(b"%d apples\n" % k for k in range(30_000))
    (tmp_path / "a.txt").write_bytes(text)
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "old.gz").write_bytes(b"not gzip")
    made = outcome(run(spark, parse_args(["-r", "-b", "4K", str(tmp_path)])))
    assert {k: r.status for k, r in made.items()} == {"a.txt": "ok", "b.txt": "ok"}
    assert gzip.decompress((tmp_path / "a.txt.gz").read_bytes()) == text and made["a.txt"].total_in == len(text)
    again = outcome(run(spark, parse_args([str(tmp_path / "a.txt"), str(tmp_path), str(tmp_path / "none")])))
    assert {k: r.status for k, r in again.items()} == {"a.txt": "warning", tmp_path.name: "warning", "none": "error"}
    (tmp_path / "c.gz").write_bytes((tmp_path / "a.txt.gz").read_bytes()[:-9])
    tested = outcome(run(spark, parse_args(["-t", "-r", str(tmp_path)])))
    assert {k: r.status for k, r in tested.items()} == {"a.txt.gz": "ok", "b.txt.gz": "ok", "c.gz": "error", "old.gz": "error"}
    assert tested["a.txt.gz"].total_out == len(text) and not (tmp_path / "c").exists()
    (tmp_path / "a.txt.gz").rename(tmp_path / "moved.gz")
    (tmp_path / "a.txt").unlink()
    back = outcome(run(spark, parse_args(["-d", "-N", str(tmp_path / "moved.gz"), str(tmp_path / "c.gz")]), replace=True))
    assert back["moved.gz"].out_path.endswith("/a.txt") and (tmp_path / "a.txt").read_bytes() == text
    assert not (tmp_path / "moved.gz").exists() and (tmp_path / "c.gz").exists() and back["c.gz"].status == "error"
    assert not list(tmp_path.glob(".*"))
    shown = run(spark, parse_args(["-dc", str(tmp_path / "b.txt.gz"), str(tmp_path / "old.gz")])).collect()
    assert b"".join(bytes(r.payload) for r in shown) == b"not gzip"
    assert [r.uncompressed for r in run(spark, parse_args(["-l", str(tmp_path / "b.txt.gz")])).collect()] == [0]


def test_files_with_one_output_take_turns(spark, tmp_path):
    """The first whole one makes it; no other replaces it, is lost or hides its damage."""
    from blockloom.functions.gzip_format import parse_header

    made = {}
    for k, body in enumerate((b"pears\n" * 9000, b"plums\n" * 9000, b"figs\n" * 9000)):
        made[k] = b"".join(packed(iter([body]), Settings("stream"), 0, b"same.txt"))
        assert parse_header(made[k]).name == b"same.txt"
    for force in ("-dN", "-dNf"):
        names = []
        for k, data in {"cut": made[0][:-9], "one": made[1], "two": made[2], "end": made[0][:-9]}.items():
            (tmp_path / f"{k}.gz").write_bytes(data)
            names.append(str(tmp_path / f"{k}.gz"))
        back = outcome(run(spark, parse_args([force, *names, names[1]]), replace=True))
        assert {k: r.status for k, r in back.items() if k != "one.gz"} == {"cut.gz": "error", "two.gz": "warning", "end.gz": "error"}
        assert (tmp_path / "same.txt").read_bytes() == b"plums\n" * 9000
        assert {p.name for p in tmp_path.iterdir()} == {"cut.gz", "two.gz", "end.gz", "same.txt"}
        (tmp_path / "same.txt").unlink()


def test_streams_equal_whole_values():
    data = b"".join(b"%d apples and %d pears\n" % (k, k * k) for k in range(9000))
    parts = [data[a : a + 10_007] for a in range(0, len(data), 10_007)]
    for s in (Settings("stream"), Settings("stream", sync_points=True), Settings("raw")):
        assert gzip.decompress(b"".join(packed(iter(parts), s))) == data if s.layout != "raw" else b"".join(packed(iter(parts), s)) == data
    s = Settings("stream", sync_points=True)
    marks = lambda packed_: packed_.count(b"\0\0\xff\xff")
    assert marks(b"".join(packed(iter(parts), s))) == marks(encode(data, s)) > 10
