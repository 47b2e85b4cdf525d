"""Files to files, as a command line asks for it: each file is one task, in bounded memory.

``run`` takes parsed options. Inputs are kept unless the caller sets ``replace``; times and
owners of files have no counterpart on object stores and are left as they fall."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.gzip_format import NotGzip, parse_header
from ..operators.arrow import map_value
from ..operators.codec import Settings
from ..operators.views import listing_totals
from ..sources.gzip_files import STEP, DamagedFile, find_files, open_path, packed, pieces
from ..sources.ranges import MOST_TASKS, list_files
from ..storage import materialise
from .options import Options

OUTCOME = "out_path string, status string, message string, total_in long, total_out long"


def _names(path: str, gzipped: bool) -> tuple[str, str]:
    """Where to read and where to write."""
    suffixed = path.endswith(fixed.SUFFIX) and len(path) > len(fixed.SUFFIX)
    if not gzipped:
        return path, path + fixed.SUFFIX
    return (path, path[: -len(fixed.SUFFIX)]) if suffixed else (path + fixed.SUFFIX, path)


def targets(o: Options) -> list[tuple[str, str | None, str | None, str | None]]:
    """(in_path, out_path, status, message) of each file named, or found in a folder; a
    status where nothing is to be done. In folders, visible files are taken: those with the
    suffix to decode or list, the others to encode."""
    from pyarrow import fs

    out, gzipped = [], o.decompress or o.list
    for name in o.files:
        where, inner = open_path(name)
        kind = where.get_file_info(inner).type
        if kind == fs.FileType.Directory:
            if not o.recursive:
                out.append((name, None, fixed.WARNING, "a directory, and recursion wasn't asked for"))
                continue
            pairs = [_names(p, gzipped) for p, _ in find_files(name, True) if (len(p) > 3 and p.endswith(fixed.SUFFIX)) == gzipped]
        else:
            pairs = [_names(name, gzipped)]
        for source, target in pairs:
            where, inner = open_path(source)
            if not where.get_file_info(inner).is_file:
                out.append((source, None, fixed.ERROR, "no such file"))
            else:
                out.append((source, target, None, None))
    return out


def _header_name(path: str) -> str:
    """The name stored in a file's header; NotGzip if it has no header."""
    where, inner = open_path(path)
    with where.open_input_file(inner) as f:
        head = parse_header(f.read_at(fixed.HEADER_BUFFER_MAX, 0))
    if head is None:
        raise NotGzip
    return (head.name or b"").decode("utf-8", "replace").rpartition("/")[2]


def _parts(path: str, o: Options, s: Settings, count: list[int]) -> Iterator[bytes]:
    """The file's bytes, encoded or decoded; ``count`` gets the bytes read."""
    where, inner = open_path(path)
    info = where.get_file_info(inner)
    count[0] = info.size
    with where.open_input_stream(inner, compression=None) as f:
        if o.decompress:
            yield from pieces(f, path, True)
            return
        name = path.rpartition("/")[2].encode() if o.name_mode != 0 else None
        mtime = int(info.mtime_ns // 10**9) & fixed.U32 if o.time_mode != 0 and info.mtime_ns else 0
        yield from packed(iter(lambda: f.read(STEP), b""), s, mtime, name)


def _stored_targets(good: DataFrame) -> dict[str, str]:
    """Where files go that are named by their headers, if these hold a name."""

    def look(row: dict) -> list[dict]:
        try:
            return [{"stored": _header_name(row["path"])}]
        except (NotGzip, OSError):  # told when the file itself is handled
            return []

    seen = map_value(good, "path", look, "stored string", ["path"]).filter("stored != ''").collect()
    return {r["path"]: "/".join([*r["path"].split("/")[:-1], r["stored"]]) for r in seen}


def _turns(found: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """(in_path, out_path) by output, in the order given."""
    out: dict[str, list[tuple[str, str]]] = {}
    for path, to in found:
        where, inner = open_path(to)
        out.setdefault(os.path.abspath(inner) if where.type_name == "local" else to, []).append((path, to))
    return list(out.values())


def _one(row: dict, o: Options, s: Settings, job: str, made: bool) -> dict:
    """``made``: another file of this run has made the same output."""
    path, to, count, size = row["path"], row["out_path"], [0], 0
    seen = {"out_path": to, "status": fixed.OK, "total_in": 0, "total_out": 0}
    where, inner = open_path(to)
    hidden = "/".join([*inner.split("/")[:-1], f".{job}-{uuid.uuid4().hex}"])
    try:
        if o.decompress:
            _header_name(path)
        if o.test:
            for part in _parts(path, o, s, count):
                size += len(part)
            return seen | {"out_path": None, "total_in": count[0], "total_out": size}
        if not made and not o.force and where.get_file_info(inner).is_file:
            return seen | {"status": fixed.WARNING, "message": "exists already, not overwritten without force"}
        with where.open_output_stream(hidden, compression=None) as out:
            for part in _parts(path, o, s, count):
                out.write(part)
                size += len(part)
        if made:
            where.delete_file(hidden)
            return seen | {"status": fixed.WARNING, "message": "another file of this run has this output, not overwritten"}
        where.move(hidden, inner)
        return seen | {"total_in": count[0], "total_out": size}
    except NotGzip:
        return seen | {"status": fixed.ERROR, "message": "not in gzip format"}
    except (DamagedFile, OSError) as e:
        if where.get_file_info(hidden).is_file:
            where.delete_file(hidden)
        return seen | {"status": fixed.ERROR, "message": str(e)}


def run(spark: SparkSession, o: Options, replace: bool = False) -> DataFrame:
    """What the options ask for.

    To encode, decode or test: path, out_path, status, message, total_in, total_out. To
    list: the listing's rows and totals. To standard output: path, payload, in order within
    a path. A file that can't be handled has a status and doesn't stop the others; outputs
    appear whole or not at all. Files with the same output are handled one after the other
    in the order given: the first that is whole makes it, others get a status, also with
    force. A task that runs again after it had finished finds its own
    output and, without force, reports it as one that exists already."""
    found = targets(o)
    tasks = max(1, min(len(found), MOST_TASKS))
    todo = spark.createDataFrame(found, "path string, out_path string, status string, message string")
    if o.list:
        rows = [list_files(spark, p, stored_names=o.name_mode == 1) for p, _, status, _ in found if status is None]
        if not rows:
            return todo
        listed = rows[0]
        for more in rows[1:]:
            listed = listed.unionByName(more)
        return listing_totals(materialise(listed, "listing"))
    settings, job = o.settings(), uuid.uuid4().hex
    good = todo.filter("status IS NULL").select("path", "out_path").repartition(tasks)
    if o.stdout:
        return map_value(good, "path", lambda row: ({"payload": p} for p in _parts(row["path"], o, settings, [0])), "payload binary", ["path"])
    named = _stored_targets(good) if o.decompress and o.name_mode == 1 and not o.test else {}
    pairs = [(p, named.get(p, to)) for p, to, status, _ in found if status is None]
    turns = [[x] for x in pairs] if o.test else _turns(pairs)

    def handle(row: dict) -> Iterator[dict]:
        made = False
        for file in row["files"]:
            seen = _one(file, o, settings, job, made)
            made |= seen["status"] == fixed.OK
            yield {"path": file["path"]} | seen

    files = spark.createDataFrame([(x,) for x in turns], "files array<struct<path string, out_path string>>").repartition(tasks)
    done = map_value(files, "files", handle, "path string, " + OUTCOME, [])
    rest = todo.filter("status IS NOT NULL").withColumn("total_in", F.lit(0).cast("long")).withColumn("total_out", F.lit(0).cast("long"))
    seen = materialise(done.unionByName(rest), "outcomes")
    if replace and not (o.keep or o.test):
        # Only once all outcomes are written; a file that is gone already is no error.
        def drop(row: dict) -> list[dict]:
            where, inner = open_path(row["path"])
            if where.get_file_info(inner).is_file:
                where.delete_file(inner)
            return []

        map_value(seen.filter(F.col("status") == fixed.OK), "path", drop, "gone boolean", ["path"]).count()
    return seen
