"""Scans: text files, raw files, directory lists, page stores and catalogs."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions.clean import decode_bytes
from tomeweave.functions.names import file_name_of, parent_name_of, parent_path_of
from tomeweave.functions.text import strip
from tomeweave.sources.workspace import materialise
from tomeweave.vocab import SHELVES


def client_in_tasks():
    """For use inside tasks: a function from a URI to a file-system client and its path.

    The built-in file reader passes over empty files and names that begin with ``_`` or ``.``;
    directories are therefore listed, and contents read, by a client in the tasks, for I/O only.
    Defined as a closure, so that executors need not have this package.
    """

    def open_at(uri: str):
        from pyarrow import fs

        if "://" in uri and not uri.startswith("file:"):
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")

    return open_at


_LISTED = "path STRING, directory BOOLEAN, length BIGINT, modificationTime TIMESTAMP"


def listing_in_tasks(at_once: int = 5000):
    """For use inside tasks: a function from a URI to batches of what it holds.

    A local directory is read entry by entry, so a task holds ``at_once`` of them however many
    there are. Other file systems list a directory in one answer, which is passed on in batches.
    """
    open_at = client_in_tasks()

    def entries(client, place):
        import os
        import stat

        from pyarrow import fs

        if not isinstance(client, fs.LocalFileSystem):
            for f in client.get_file_info(fs.FileSelector(place)):
                at = f.mtime and int(f.mtime.timestamp()) * 1_000_000 + f.mtime.microsecond
                yield f.base_name, f.type == fs.FileType.Directory, f.size, at
            return
        with os.scandir(place) as found:
            for f in found:
                try:
                    s = f.stat()
                except FileNotFoundError:  # a link to nothing
                    yield f.name, False, None, None
                    continue
                yield f.name, f.is_dir(), s.st_size if stat.S_ISREG(s.st_mode) else None, s.st_mtime_ns // 1000

    def listing(uri):
        import itertools

        import pyarrow as pa
        from pyarrow import fs

        types = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["path", "directory", "length", "modificationTime"]
        client, place = open_at(uri)
        own = client.get_file_info(place)
        if own.type == fs.FileType.File:
            at = int(own.mtime.timestamp()) * 1_000_000 + own.mtime.microsecond
            rows = iter([(uri, False, own.size, at)])
        else:
            rows = ((f"{uri.rstrip('/')}/{name}", *rest) for name, *rest in entries(client, place))
        while part := list(itertools.islice(rows, at_once)):
            columns = [pa.array(c, t) for c, t in zip(zip(*part), types)]
            columns[3] = columns[3].cast(pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return listing


def _list_level(directories: DataFrame) -> DataFrame:
    """What the directories of a ``path`` column hold; a file stands for itself."""
    listing = listing_in_tasks()

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                yield from listing(uri)

    return directories.select("path").mapInArrow(run, _LISTED)


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, dir, file_name, length, modificationTime`` of every file; contents are not opened.

    One round per level of directories, each dealt out over the tasks; the listing is stored.
    """
    start = root if "://" in root or root.startswith("file:") else f"file:{root}"
    level = spark.createDataFrame([(start.rstrip("/"),)], "path STRING")
    levels = []
    while True:
        found = materialise(_list_level(level), "listing")
        levels.append(found.filter("NOT directory"))
        level = found.filter("directory").select("path")
        if not recursive or level.isEmpty():
            break
        level = level.repartition("path")
    files = functools.reduce(DataFrame.unionByName, levels)
    path = F.col("path")
    return files.select(
        path,
        parent_path_of(path).alias("dir"),
        file_name_of(path).alias("file_name"),
        "length",
        "modificationTime",
    )


def read_contents(files: DataFrame) -> DataFrame:
    """``files`` with the ``content`` of each ``path``; an empty file has an empty one."""
    open_at = client_in_tasks()
    carried = [c for c in files.columns if c != "content"]
    schema = files.select(*carried).schema.add("content", "binary")
    at = carried.index("path")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, uri in enumerate(batch.column(at).to_pylist()):
                client, place = open_at(uri)
                with client.open_input_stream(place, compression=None) as stream:
                    content = stream.read()
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([content], pa.binary())], names=[*carried, "content"]
                )

    return files.select(*carried).mapInArrow(run, schema)


def read_raw_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, dir, file_name, content``."""
    listed = list_files(spark, root, recursive).select("path", "dir", "file_name")
    return read_contents(listed.repartition("path"))


def read_labelled_corpus(
    spark: SparkSession,
    root: str,
    categories: Sequence[str] | None = SHELVES,
    charset: str | None = "ISO-8859-1",
) -> DataFrame:
    """``path, label, text``: one row per file, labelled by its directory.

    Without a ``charset`` it is decided per file. Only files of the categories are opened.
    """
    files = list_files(spark, root).select("path", parent_name_of(F.col("path")).alias("label"))
    if categories is not None:
        files = files.filter(F.col("label").isin(list(categories)))
    content = F.col("content")
    text = decode_bytes(content) if charset is None else F.decode(content, charset)
    return read_contents(files.repartition("path")).select("path", "label", text.alias("text"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``text, path``: each file as one value, as UTF-8 where it is that, else ISO-8859-1."""
    raw = read_raw_files(spark, path)
    return raw.select(decode_bytes(F.col("content")).alias("text"), "path")


def read_directory_list(spark: SparkSession, path: str, root: str) -> DataFrame:
    """``entry, dir, pos``: the lines of a directory list in order, with the root put before.

    ``pos`` orders lines within and across the splits of the list file.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("entry"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("pos"),
    )
    return lines.withColumn("dir", strip(F.concat(F.lit(root), F.col("entry"))))


def existing_directories(directories: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of one side whose directory the other side holds."""
    return directories.join(files.select("dir"), "dir", "left_semi")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
