"""A Python Data Source, ``spark.read.format("blockloom")`` and ``df.write.format("blockloom")``.

Reading gives decoded pieces of every file under a path, in bounded memory whatever a
file's size: path, piece_idx, raw_offset, payload. Files are dealt to tasks by size. What
isn't gzip passes unchanged and garbage after a member is ignored; damage raises, unless
``mode`` is ``keep``, where what was good before it is returned.

Writing turns each task's payloads, in the order of its rows, into one file of one gzip
member, under a hidden name until the job commits."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import fixed
from ..functions.gear import REACH, hits
from ..functions.gzip_format import NotGzip, build_header, parse_header, trailer
from ..operators.codec import Settings, deflate_block

SCHEMA = "path string, piece_idx int, raw_offset long, payload binary"
STEP = 1 << 20
TASK_BYTES = 128 << 20  # compressed bytes dealt to one task


def open_path(path: str):
    """The file system of a path or URI and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def find_files(path: str, recursive: bool = False, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the file at ``path``, or of the visible files in it, by name."""
    from pyarrow import fs

    where, inner = open_path(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = where.get_file_info(fs.FileSelector(inner, recursive=recursive))
        found = [f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and f.base_name.endswith(suffix)]
    elif info.is_file:
        found = [info]
    else:
        raise FileNotFoundError(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found)


class DamagedFile(ValueError):
    """Corrupt or truncated data; the message names the file."""


def pieces(stream, path: str, strict: bool) -> Iterator[bytes]:
    """Decoded pieces of at most STEP bytes, member after member, verified at each end."""
    buf = stream.read(STEP)
    if not buf.startswith(fixed.MAGIC):
        while buf:
            yield buf
            buf = stream.read(STEP)
        return

    def fail(why: str) -> None:
        if strict:
            raise DamagedFile(f"{path}: {why}")

    while buf.startswith(fixed.MAGIC):
        try:
            while (head := parse_header(buf)) is None:
                more = stream.read(STEP)
                if not more:
                    return fail("unexpected end of file")
                buf += more
        except NotGzip:
            return fail("not in gzip format")
        z, crc, size, feed = zlib.decompressobj(-15), 0, 0, buf[head.length :]
        while not z.eof:
            feed = feed or stream.read(STEP)
            if not feed:
                return fail("unexpected end of file")
            try:
                part = z.decompress(feed, STEP)
            except zlib.error:
                return fail("corrupt deflate data")
            feed, crc, size = z.unconsumed_tail, zlib.crc32(part, crc), size + len(part)
            if part:
                yield part
        buf = z.unused_data
        while len(buf) < fixed.TRAILER_LEN + len(fixed.MAGIC) and (more := stream.read(STEP)):
            buf += more
        if len(buf) < fixed.TRAILER_LEN:
            return fail("unexpected end of file")
        if buf[: fixed.TRAILER_LEN] != trailer(crc, size):
            return fail("checksum or length mismatch")
        buf = buf[fixed.TRAILER_LEN :]


def packed(parts: Iterator[bytes], s: Settings, mtime: int = 0, name: bytes | None = None) -> Iterator[bytes]:
    """One member of blocks or one stream (or the bytes as they are), as its data comes.
    What isn't yet cut is at most a few blocks, so memory stays bounded."""
    if s.layout == "raw":
        yield from parts
        return
    strategy = fixed.STRATEGIES[s.strategy]
    yield build_header(s.level, strategy, mtime, name)
    crc = size = 0
    rest, before = bytearray(), b""
    z = zlib.compressobj(s.level, zlib.DEFLATED, -15, 8, strategy)

    def cut(everything: bool) -> Iterator[bytes]:
        # The last chunk may still grow, so it waits for more or for the end.
        ready = s.cuts(bytes(rest))
        last = ready if everything else ready[:-1]
        for at, n, _ in last:
            yield deflate_block(bytes(rest[at : at + n]), s.level, strategy, False)
        if last:
            del rest[: last[-1][0] + last[-1][1]]

    for part in parts:
        crc, size = zlib.crc32(part, crc), size + len(part)
        if s.layout == "stream":
            at = 0
            if s.sync_points:
                for p in hits(before + part, fixed.STREAM_SYNC_SPAN - 1) - len(before) + 1:
                    if p > 0:
                        yield z.compress(part[at:p]) + z.flush(zlib.Z_SYNC_FLUSH)
                        at = int(p)
                before = (before + part)[1 - REACH :]
            yield z.compress(part[at:])
            continue
        rest += part
        if len(rest) >= 8 * s.block_size:
            yield from cut(False)
    if s.layout == "stream":
        yield z.flush(zlib.Z_FINISH)
    else:
        yield from cut(True)
        yield deflate_block(b"", s.level, strategy, True)
    yield trailer(crc, size)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class GzipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.suffix = options.get("suffix", "")
        self.strict = options.get("mode", "fail") != "keep"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        """Files in order of their names, dealt to tasks of about ``taskBytes``."""
        out, now, size = [], [], 0
        for path, n in find_files(self.path, self.recursive, self.suffix):
            now.append(path)
            size += n
            if size >= self.task_bytes:
                out, now, size = [*out, Files(tuple(now))], [], 0
        return [*out, Files(tuple(now))] if now or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            where, inner = open_path(path)
            with where.open_input_stream(inner, compression=None) as stream:
                at = 0
                for k, part in enumerate(pieces(stream, path, self.strict)):
                    yield path, k, at, part
                    at += len(part)


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class GzipWriter(DataSourceWriter):
    """Options block_size, cdc, level, strategy as in ``Settings``."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.settings = Settings(
            "blocks",
            int(options.get("block_size", fixed.DEFAULT_BLOCK)),
            options.get("cdc", "true").lower() == "true",
            int(options.get("level", fixed.DEFAULT_LEVEL)),
            options.get("strategy", "default"),
        )
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        """One file. What isn't yet cut is at most a few blocks, so memory stays bounded."""
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.gz"
        where, inner = open_path(self.path)
        where.create_dir(inner, recursive=True)
        hidden = f"{inner}/.{name}-{context.taskAttemptId()}"
        parts = (p.encode() if isinstance(p, str) else bytes(p) for row in rows if (p := row["payload"]) is not None)
        with where.open_output_stream(hidden, compression=None) as out:
            for part in packed(parts, self.settings):
                out.write(part)
        return Written(hidden, f"{inner}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        where, inner = open_path(self.path)
        from pyarrow import fs

        # Old files go last: a failure in between leaves both, never neither.
        old = []
        if self.overwrite and where.get_file_info(inner).type == fs.FileType.Directory:
            old = [f.path for f in where.get_file_info(fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith(".")]
        for m in messages:
            if m is not None:
                where.move(m.hidden, m.final)
        for path in old:
            where.delete_file(path)
        self._sweep(where, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*open_path(self.path))

    def _sweep(self, where, inner: str) -> None:
        """Removes this job's hidden files, also those of tasks that failed."""
        from pyarrow import fs

        for f in where.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if f.is_file and f.base_name.startswith(".") and self.job in f.base_name:
                where.delete_file(f.path)


class GzipFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GzipReader:
        return GzipReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> GzipWriter:
        return GzipWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GzipFiles)
