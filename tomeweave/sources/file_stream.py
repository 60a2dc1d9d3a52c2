"""A streaming source that sees every file below a directory, whatever its name or size.

The built-in file stream passes over empty files and names that begin with ``_`` or ``.``. This one
lists the tree with the client that the batch scans use and writes what is new to a log of
manifests, one per batch. An offset is the number of the last manifest, so a batch that is run
again after a failure reads the files it was planned with, and a file that arrives late, or with an
old time, is in the next one. Files are opened by the tasks, some ``BYTES`` of them each.

As with the built-in stream the paths, not the contents, are listed on the driver; a file counts
once, by its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeweave.sources.files import client_in_tasks

SCHEMA = "path STRING, content BINARY"
# Bytes of files that one task reads, at most about; a larger file is read alone.
BYTES = 64 * 1024 * 1024


def every_file_source():
    """The source's class, defined here so that executors need not have this package."""
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    open_at, most = client_in_tasks(), BYTES

    class Files(InputPartition):
        def __init__(self, paths):
            self.paths = paths

    class Reader(DataSourceStreamReader):
        def __init__(self, root: str, log: str):
            self.root, self.log = root.rstrip("/"), log.rstrip("/")

        def _manifests(self) -> list[int]:
            from pyarrow import fs

            client, place = open_at(self.log)
            found = client.get_file_info(fs.FileSelector(place, allow_not_found=True))
            return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

        def _manifest(self, number: int) -> list[tuple[str, int]]:
            import json

            client, place = open_at(f"{self.log}/{number}")
            with client.open_input_stream(place, compression=None) as stream:
                return [tuple(x) for x in json.loads(stream.read())]

        def _tree(self) -> list[tuple[str, int]]:
            """Path and size of every file, in order of their paths."""
            from pyarrow import fs

            client, place = open_at(self.root)
            found = client.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
            start = place.rstrip("/")
            return sorted((self.root + f.path.removeprefix(start), f.size or 0) for f in found if f.type == fs.FileType.File)

        def initialOffset(self) -> dict:
            return {"manifest": -1}

        def latestOffset(self) -> dict:
            import json

            held = self._manifests()
            seen = {path for n in held for path, _ in self._manifest(n)}
            new = [f for f in self._tree() if f[0] not in seen]
            last = held[-1] if held else -1
            if new:
                last += 1
                client, place = open_at(f"{self.log}/{last}")
                client.create_dir(place.rpartition("/")[0], recursive=True)
                # Under another name until it is whole.
                with client.open_output_stream(place + ".part", compression=None) as stream:
                    stream.write(json.dumps(new).encode())
                client.move(place + ".part", place)
            return {"manifest": last}

        def partitions(self, start: dict, end: dict) -> list:
            files = [f for n in range(start["manifest"] + 1, end["manifest"] + 1) for f in self._manifest(n)]
            groups, size = [[]], 0
            for path, length in files:
                if groups[-1] and size + length > most:
                    groups.append([])
                    size = 0
                groups[-1].append(path)
                size += length
            return [Files(paths) for paths in groups if paths]

        def read(self, partition):
            for path in partition.paths:
                client, place = open_at(path)
                with client.open_input_stream(place, compression=None) as stream:
                    yield path, stream.read()

        def commit(self, end: dict) -> None:
            pass  # manifests stay: they say what has been seen

    class EveryFile(DataSource):
        @classmethod
        def name(cls) -> str:
            return "every_file"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> Reader:
            return Reader(self.options["root"], self.options["log"])

    return EveryFile


def stream_every_file(spark: SparkSession, root: str, log: str) -> DataFrame:
    """``path, content`` of each file below ``root``, once; ``log`` belongs to the stream as its
    checkpoint does, and outlives it."""
    spark.dataSource.register(every_file_source())
    here = [p if "://" in p or p.startswith("file:") else f"file:{p}" for p in (root, log)]
    return spark.readStream.format("every_file").option("root", here[0]).option("log", here[1]).load()
