"""Spectrum text files as Spark data sources: MGF to read, write and stream.

One partition a file, since a gzip file can't be split and a block may be anywhere; many files make many tasks. Paths
are opened with ``pyarrow.fs``, so the folder may be any store that it knows.
"""

from __future__ import annotations

import gzip
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "id string, mz array<double>, intensity array<double>, precursor_mz double, meta map<string,string>"


class MgfError(ValueError):
    """A block that can't be read; names it."""


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def files_of(path: str) -> list[str]:
    """The .mgf and .mgf.gz files below a path, or the file itself, by name."""
    from pyarrow import fs

    store, at = _filesystem(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    prefix = path[: len(path) - len(at)] if "://" in path and path.endswith(at) else ""
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".mgf", ".mgf.gz")) and not os.path.basename(f.path).startswith(("_", ".")))


def lines_of(path: str) -> Iterator[str]:
    store, at = _filesystem(path)
    with store.open_input_stream(at, compression=None) as raw:
        source = gzip.open(raw) if path.lower().endswith(".gz") else raw
        rest = b""
        while block := source.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x.decode("utf-8", "replace").rstrip("\r") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace").rstrip("\r")


def _number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def parse(lines: Iterator[str], strict: bool = True) -> Iterator[tuple]:
    """(id, mz, intensity, precursor_mz, meta) of each block.

    The id is TITLE, else NAME, else SCANS unless it is empty or -1, else spectrum_<number from 1>. Strict: nested or open
    blocks, blocks without peaks or a positive precursor are errors; otherwise such blocks are left out.
    """
    number, meta, peaks = 0, None, []

    def finish() -> tuple | None:
        scans = meta.get("SCANS", "")
        name = meta.get("TITLE") or meta.get("NAME") or (scans if scans not in ("", "-1") else f"spectrum_{number}")
        first = (meta.get("PEPMASS") or meta.get("PRECURSOR_MZ") or "").replace(",", " ").split()
        precursor = _number(first[0]) if first else None
        if not peaks or precursor is None or precursor <= 0:
            if strict:
                raise MgfError(f"{name}: {'no peaks' if not peaks else 'no positive precursor m/z'}")
            return None
        return name, [p[0] for p in peaks], [p[1] for p in peaks], precursor, meta

    for raw in lines:
        line = raw.strip()
        if not line or line[0] in "#;!":
            continue
        upper = line.upper()
        if upper == "BEGIN IONS":
            if meta is not None and strict:
                raise MgfError(f"block {number} isn't closed before the next begins")
            number, meta, peaks = number + 1, {}, []
        elif upper == "END IONS":
            if meta is None:
                if strict:
                    raise MgfError(f"END IONS without a block after block {number}")
                continue
            row = finish()
            meta = None
            if row:
                yield row
        elif meta is not None:
            key, equals, value = line.partition("=")
            if equals and not (line[0].isdigit() or line[0] in "+-."):
                meta[key.strip().upper()] = value.strip()
                continue
            parts = line.split()
            pair = [_number(x) for x in parts[:2]]
            if len(pair) == 2 and None not in pair:
                peaks.append(pair)
            elif strict:
                raise MgfError(f"block {number}: {line!r} is no peak")
    if meta is not None and strict:
        raise MgfError(f"block {number} isn't closed")


@dataclass
class FilePartition(InputPartition):
    path: str


class MgfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("mode", "FAILFAST").upper() != "PERMISSIVE"

    def partitions(self):
        return [FilePartition(p) for p in files_of(self.path)]

    def read(self, partition):
        yield from parse(lines_of(partition.path), self.strict)


#: Files this much older than the newest are taken as read and leave the log.
MAX_AGE_DAYS = 7


class MgfStreamReader(DataSourceStreamReader):
    """Each file once, whatever its name.

    The offset is a log: the files that are there with their times, and the time before which files are taken as read, which only
    rises. A batch reads what its end has and its start doesn't, so that it reads the same files when it runs again. The log
    holds only files of the last ``MAX_AGE_DAYS`` before the newest; one that arrives with an older time isn't read. A file that changes isn't
    read again, and one that is gone before it was read is an error.
    """

    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.age = float(options.get("maxfileagedays", MAX_AGE_DAYS)) * 86_400
        self.after = 0.0

    def initialOffset(self):
        return {"after": 0.0, "files": {}}

    def latestOffset(self):
        times = {p: _modified(p) for p in files_of(self.path)}
        self.after = max(self.after, max(times.values(), default=0.0) - self.age)
        return {"after": self.after, "files": {p: t for p, t in times.items() if t >= self.after}}

    def partitions(self, start, end):
        self.after = max(self.after, start["after"])
        return [FilePartition(p) for p, t in sorted(end["files"].items()) if p not in start["files"] and t >= start["after"]]

    def read(self, partition):
        yield from parse(lines_of(partition.path), self.strict)

    def commit(self, end):
        pass


def _modified(path: str) -> float:
    store, at = _filesystem(path)
    return store.get_file_info(at).mtime.timestamp()


@dataclass
class Written(WriterCommitMessage):
    path: str


def block_text(row) -> str:
    """One MGF block: TITLE first, one PEPMASS, other keys in upper case, peaks by m/z."""
    known = row.asDict()
    meta = {k.upper(): v for k, v in (known.get("meta") or {}).items() if k.upper() not in ("TITLE", "PEPMASS")}
    peaks = sorted(zip(row["mz"], row["intensity"]))
    lines = ["BEGIN IONS", f"TITLE={row['id']}", f"PEPMASS={row['precursor_mz']!r}", *(f"{k}={v}" for k, v in meta.items()), *(f"{m!r} {i!r}" for m, i in peaks), "END IONS", ""]
    return "\n".join(lines) + "\n"


class MgfWriter(DataSourceWriter):
    """A file a task under a name no other attempt uses; only committed files stay."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]

    def write(self, iterator):
        store, at = _filesystem(self.path)
        store.create_dir(at, recursive=True)
        name = f"{at}/part-{uuid.uuid4().hex}.mgf"
        with store.open_output_stream(name, compression=None) as out:
            for row in iterator:
                out.write(block_text(row).encode())
        return Written(name)

    def abort(self, messages):
        store, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class MgfSource(DataSource):
    """``spark.read.format("mgf")``, ``df.write.format("mgf")`` and ``spark.readStream.format("mgf")``; option mode: FAILFAST or PERMISSIVE."""

    @classmethod
    def name(cls):
        return "mgf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MgfReader(dict(self.options))

    def writer(self, schema, overwrite):
        return MgfWriter(dict(self.options), overwrite)

    def streamReader(self, schema):
        return MgfStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MgfSource)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """MGF or mzML by suffix; others are an error."""
    low = path.lower().removesuffix(".gz")
    if low.endswith(".mgf"):
        register(spark)
        return spark.read.format("mgf").load(path).select("id", "mz", "intensity", "precursor_mz")
    if low.endswith(".mzml"):
        from .mzml import read_mzml

        return read_mzml(spark, path)
    raise ValueError(f"{path}: not an .mgf or .mzML file")
