"""A feed as a streaming source: instruments come and go while it runs.

What is subscribed stands in a small file that the driver reads before each micro-batch; the
batch's offset holds it, so a batch that is made again has the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tickloom.sources import mock
from tickloom.sources.wal import file_system

ROWS = "instrument_token long, value long"


def _read(path: str) -> dict:
    from pyarrow import fs

    store, where = file_system(path)
    if store.get_file_info(where).type != fs.FileType.File:
        return {"connected": False, "tokens": []}
    with store.open_input_stream(where) as f:
        return json.loads(f.read())


def _write(path: str, state: dict) -> None:
    store, where = file_system(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{where}.tmp") as f:
        f.write(json.dumps(state).encode())
    store.move(f"{where}.tmp", where)


class FeedSource(DataSource):
    """Running numbers of each subscribed instrument; options: path of the subscriptions, rows a micro-batch and instrument."""

    @classmethod
    def name(cls) -> str:
        return "mock_feed"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("rows", 100)))


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.last = path, rows, None

    def initialOffset(self) -> dict:
        return {"value": 0, "tokens": []}

    def latestOffset(self) -> dict:
        state = _read(self.path)
        at = (self.last or self.initialOffset())["value"]
        tokens = sorted(state["tokens"]) if state["connected"] else []
        self.last = {"value": at + self.rows if tokens else at, "tokens": tokens}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(end, self.last or end, key=lambda o: o["value"])
        return [InputPartition((t, start["value"], end["value"])) for t in end["tokens"]] or [InputPartition((0, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        token, a, b = partition.value
        for at in range(a, b, 10_000):
            n = np.arange(at, min(b, at + 10_000))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n.size, token)), pa.array(n)], names=["instrument_token", "value"])

    def commit(self, end: dict) -> None:
        pass


class Feed:
    """connect, subscribe and unsubscribe in any order; listeners get each micro-batch of snapshots."""

    def __init__(self, spark: SparkSession, folder: str, rows: int = 100):
        self.spark, self.path, self.rows = spark, f"{folder}/subscriptions.json", rows
        self.queries: list = []
        spark.dataSource.register(FeedSource)
        _write(self.path, {"connected": False, "tokens": []})

    def _change(self, **more) -> None:
        _write(self.path, _read(self.path) | more)

    def connect(self) -> DataFrame:
        """The stream of snapshots; nothing comes before this, nor of instruments that are not subscribed."""
        self._change(connected=True)
        rows = self.spark.readStream.format("mock_feed").option("path", self.path).option("rows", self.rows).load()
        return mock.feed(rows, token=F.col("instrument_token"))

    def disconnect(self) -> None:
        """Stop the listeners and the flow of rows; subscriptions stay."""
        self._change(connected=False)
        for q in self.queries:
            q.stop()
        self.queries = []

    def subscribe(self, tokens: Iterable[int]) -> None:
        self._change(tokens=sorted({*_read(self.path)["tokens"], *map(int, tokens)}))

    def unsubscribe(self, tokens: Iterable[int]) -> None:
        self._change(tokens=sorted({*_read(self.path)["tokens"]} - {*map(int, tokens)}))

    def listen(self, listener: Callable[[DataFrame, int], None], checkpoint: str, pace: str = "100 milliseconds"):
        """Give each micro-batch to the listener. Returns the query."""
        q = self.connect().writeStream.foreachBatch(listener).option("checkpointLocation", checkpoint).trigger(processingTime=pace).start()
        self.queries.append(q)
        return q
