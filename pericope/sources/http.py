"""An HTTP source for spark.read: one row per path, fetched where the partition runs.

    spark.dataSource.register(HttpFiles)
    spark.read.format("httpfiles").option("base", url).option("paths", "a.json,b.json").load()
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pericope.errors import RepositoryError
from pericope.sources.repository import Repository


class HttpFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "httpfiles"

    def schema(self) -> str:
        return "path string, content binary, error string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.base, self.version = options["base"], options.get("version", "v2")
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.width = max(1, int(options.get("pathsPerPartition", "16")))
        self.most = int(options.get("maxResponseBytes", str(128 << 20)))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.paths[i : i + self.width]) for i in range(0, len(self.paths), self.width)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with Repository(self.base, self.version, max_response_bytes=self.most) as r:
            for path in partition.paths:
                try:
                    yield path, r.fetch_bytes(path), None
                except RepositoryError as e:
                    yield path, None, f"{type(e).__name__}: {e}"
