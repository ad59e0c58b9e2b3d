"""Raw sources kept as files, one a source, written and read back in tasks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackwise.session import saved, ship

#: Files of a folder.
FOLDER = 1000


def file_system(path: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def written(sources: DataFrame, folder: str) -> DataFrame:
    """Each row's ``text`` as a file under ``folder``; the other columns with ``path``, relative to it, written as a table.

    Rows are written where they are, in folders of a task attempt's own: an attempt that fails or is run twice leaves files that no
    path names, and rows of equal keys have files of their own. A null text has no file and a null path.
    """
    ship(sources.sparkSession)
    at = sources.columns.index("text")
    kept = [c for c in sources.columns if c != "text"]

    def run(batches):
        store, root = file_system(folder)
        mine, n = uuid.uuid4().hex, 0
        for b in batches:
            paths = []
            for text in b.column(at):
                if not text.is_valid:
                    paths.append(None)
                    continue
                if n % FOLDER == 0:
                    store.create_dir(f"{root}/{mine}/{n // FOLDER}", recursive=True)
                paths.append(f"{mine}/{n // FOLDER}/{n}.txt")
                with store.open_output_stream(f"{root}/{paths[-1]}") as out:
                    out.write(text.as_py().encode())
                n += 1
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(c)) for c in kept] + [pa.array(paths, pa.string())], names=[*kept, "path"])

    schema = sources.select(*kept, F.lit("").alias("path")).schema
    return saved(sources.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)), "raw-paths")


def read(paths: DataFrame, folder: str) -> DataFrame:
    """``paths`` as ``written`` returns them, with ``content``: the bytes of each file."""
    ship(paths.sparkSession)

    def run(batches):
        store, root = file_system(folder)
        for b in batches:
            content = []
            for path in b.column(b.schema.names.index("path")).to_pylist():
                if path is None:
                    content.append(None)
                    continue
                with store.open_input_stream(f"{root}/{path}") as source:
                    content.append(source.read())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(content, pa.binary())], names=[*b.schema.names, "content"])

    return paths.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema) + ", content binary")
