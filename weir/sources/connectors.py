"""Named sources and sinks. Brokers need a client library; without it they refuse by name.

Sources give payload frames (seq, time, payload) or rows; sinks take frames of rows or payloads.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PAYLOADS = "__seq long, __ts timestamp, payload binary"


class Topics:
    """In-process topics, of payloads or of rows, for tests and small reference data on the driver."""

    def __init__(self):
        self.payloads: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
        self.rows: dict[str, DataFrame] = {}

    def publish(self, topic: str, payloads: Iterable[bytes]) -> None:
        kept = self.payloads[topic]
        kept += [(time.time_ns() // 1000, p) for p in payloads]

    def publish_rows(self, topic: str, rows: DataFrame) -> None:
        self.rows[topic] = rows if topic not in self.rows else self.rows[topic].unionByName(rows)

    def read(self, spark: SparkSession, topic: str) -> DataFrame:
        if topic in self.rows:
            return self.rows[topic]
        found = [(i, t, p) for i, (t, p) in enumerate(self.payloads[topic])]
        return spark.createDataFrame(found, "__seq long, us long, payload binary").select("__seq", F.timestamp_micros("us").alias("__ts"), "payload")

    def sink(self, topic: str) -> Callable[[DataFrame], None]:
        """Encoded batches as payloads; the number of batches is small by nature."""
        return lambda df: self.publish(topic, [r.payload.encode() for r in df.select("payload").toLocalIterator()])


def nop(df: DataFrame) -> None:
    """Works the rows out and forgets them."""
    df.write.format("noop").mode("overwrite").save()


def files(path: str, form: str = "parquet") -> Callable[[DataFrame], None]:
    return lambda df: df.write.format(form).mode("append").save(path)


class _Spot(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(start)
        self.start, self.end = start, end


class _BrokerReader(DataSourceStreamReader):
    """Messages of a broker's topic, numbered by arrival at one connection."""

    def __init__(self, options: dict):
        self.options, self.held = options, []
        self.client = connect(options, lambda payload: self.held.append((time.time_ns() // 1000, payload)))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": len(self.held)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = _Spot(start["at"], end["at"])
        found.rows = self.held[start["at"] : end["at"]]
        return [found]

    def read(self, partition: _Spot):
        import datetime

        for i, (at, payload) in enumerate(partition.rows, partition.start):
            yield i, datetime.datetime.fromtimestamp(at / 1e6, datetime.timezone.utc), payload


def connect(options: dict, receive: Callable[[bytes], None]):
    """Subscribes to an MQTT topic; the client library is optional."""
    try:
        from paho.mqtt import client as mqtt
    except ImportError as e:
        raise RuntimeError("the mqtt source needs the paho-mqtt library") from e
    host, _, port = options["broker_url"].rpartition("://")[2].partition(":")
    found = mqtt.Client()
    found.on_message = lambda c, data, message: receive(message.payload)
    found.on_connect = lambda c, *rest: c.subscribe(options["topic"], int(options.get("qos", 0)))
    found.connect(host, int(port or 1883))
    found.loop_start()
    return found


class Mqtt(DataSource):
    """``spark.readStream.format("weir_mqtt").option("broker_url", ...).option("topic", ...)``, after ``spark.dataSource.register(Mqtt)``."""

    @classmethod
    def name(cls) -> str:
        return "weir_mqtt"

    def schema(self) -> str:
        return PAYLOADS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _BrokerReader(self.options)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of a video that were written as files: payload and time."""
    return spark.read.format("binaryFile").load(folder).select(F.col("content").alias("payload"), F.col("modificationTime").alias("timestamp"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("format"))
