"""An archive played again as a stream: ``spark.readStream.format("replay")`` after ``spark.dataSource.register(ReplaySource)``.

Options: ``path`` of the archive (partitioned by variable and month), ``start`` and ``end`` of the window in archive time (ISO, UTC; from
start up to, but not with, end), ``begin``, the wall-clock time at which the replay starts, ``speed``, how many times as fast time goes by
in it, ``variables``, a comma-separated list (all without it), and ``now``, a fixed wall-clock time instead of the real one.

The offset is the archive time up to which readings are due, so a query that starts again from its checkpoint goes on where
it stopped, without repeats. Each batch has a partition for each file of the months that its span touches; files are read
batch by batch with the span pushed down to their row groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "entity string, variable string, ts timestamp, value double, unit string, source string"


def micros(text: str) -> int:
    moment = datetime.fromisoformat(text)
    return round((moment if moment.tzinfo else moment.replace(tzinfo=UTC)).timestamp() * 1_000_000)


@dataclass
class Span(InputPartition):
    """A file of the archive and the archive times that are due of it, in microseconds, the last not with them."""

    file: str
    variable: str
    first: int
    end: int


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReplayReader(self.options)


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.start, self.end = micros(options["start"]), micros(options["end"])
        self.begin, self.speed = micros(options["begin"]), float(options.get("speed", "1"))
        self.variables = {v.strip() for v in options["variables"].split(",")} if "variables" in options else None
        self.now = options.get("now")

    def initialOffset(self) -> dict:
        return {"at": self.start}

    def latestOffset(self) -> dict:
        now = micros(self.now) if self.now else round(datetime.now(UTC).timestamp() * 1_000_000)
        return {"at": min(self.end, max(self.start, self.start + round((now - self.begin) * self.speed)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        if start["at"] >= end["at"]:
            return []
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        month = lambda at: datetime.fromtimestamp(at / 1_000_000, UTC).strftime("%Y-%m")
        first, last = month(start["at"]), month(end["at"] - 1)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
            wanted = info.path.endswith(".parquet") and (self.variables is None or parts.get("variable") in self.variables)
            if wanted and first <= parts.get("month", "") <= last:
                found.append(Span(info.path, parts["variable"], start["at"], end["at"]))
        return found

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        data = ds.dataset(partition.file, format="parquet", filesystem=store)
        stamp = lambda at: pa.scalar(at, pa.timestamp("us", "UTC"))
        ts = ds.field("ts").cast(pa.timestamp("us", "UTC"))
        kinds = {"entity": pa.string(), "ts": pa.timestamp("us", "UTC"), "value": pa.float64(), "unit": pa.string(), "source": pa.string()}
        names = ["entity", "variable", "ts", "value", "unit", "source"]
        for batch in data.to_batches(columns=list(kinds), filter=(ts >= stamp(partition.first)) & (ts < stamp(partition.end))):
            if len(batch):
                columns = {c: batch.column(c).cast(t) for c, t in kinds.items()} | {"variable": pa.array([partition.variable] * len(batch), pa.string())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    def commit(self, end: dict) -> None:
        pass
