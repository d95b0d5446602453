"""A sink that writes a file for each text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .mgf import _filesystem

#: What a file name may be made of.
NAME = r"[A-Za-z0-9_.+-]+"


@dataclass
class Files(WriterCommitMessage):
    names: int


class TextFileWriter(DataSourceWriter):
    """Rows (name, text), each to the file of that name. A task that runs again, or twice at once, writes the same files anew."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        store, at = _filesystem(self.path)
        store.create_dir(at, recursive=True)
        n = 0
        for row in iterator:
            if not row["name"] or not re.fullmatch(NAME, row["name"]):
                raise ValueError(f"{row['name']!r} is no file name")
            with store.open_output_stream(f"{at}/{row['name']}", compression=None) as out:
                out.write((row["text"] or "").encode())
            n += 1
        return Files(n)

    def commit(self, messages):
        store, at = _filesystem(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/_SUCCESS") as out:
            out.write(b"")


class TextFiles(DataSource):
    """``df.select("name", "text").write.format("textfiles").mode("append").save(folder)``."""

    @classmethod
    def name(cls):
        return "textfiles"

    def schema(self):
        return "name string, text string"

    def writer(self, schema, overwrite):
        return TextFileWriter(dict(self.options))


def write_text_files(df: DataFrame, path: str) -> None:
    """Write each row (name, text) of ``df`` to a file below ``path``; equal names are an error, before anything is written."""
    twice = df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['name']!r} names {twice[0]['n']} texts")
    df.sparkSession.dataSource.register(TextFiles)
    df.select("name", "text").write.format("textfiles").mode("append").save(path)
