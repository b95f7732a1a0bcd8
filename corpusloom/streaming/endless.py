"""An endless source of generated rows, and a sink that writes it in blocks of exactly 100.

The source is a Python data source whose offset is the number of rows handed out. It keeps a stock: when fewer than a trigger's rows are
left, it grows by whole refills. A row is a function of its number and the seed alone, so a lost task or a restart gives the same
rows again, and what a row is made of is joined to it from a table by that number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

BLOCK = 100
SPAN = 64  # blocks of a task, so that tasks, and what each tells the driver, are few


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        number = lambda name, other: int(options.get(name, other))
        self.refill, self.per_trigger, self.total, self.seed = number("refill", 250), number("rowspertrigger", 300), number("total", 0), number("seed", 7)
        self.stock, self.at = 0, 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        """A trigger's rows further on, in whole blocks; ``total`` ends the source, for tests and bounded runs."""
        wanted = self.at + self.per_trigger
        while self.stock < wanted:
            self.stock += self.refill
        end = min(self.stock, wanted)
        if self.total:
            end = min(end, self.total)
        self.at = max(self.at, end - end % BLOCK)
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["row"])  # after a restart
        return [_Rows(low, min(low + SPAN * BLOCK, end["row"])) for low in range(start["row"], end["row"], SPAN * BLOCK)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        for row in range(partition.start, partition.end):
            yield row, row // BLOCK, int.from_bytes(hashlib.sha256(f"{self.seed}:{row}".encode()).digest()[:7], "big")


class EndlessSource(DataSource):
    """``spark.readStream.format("endless")``: (row, block, draw) without end. Options: ``refill``, ``rowsPerTrigger``, ``seed``, ``total``."""

    @classmethod
    def name(cls) -> str:
        return "endless"

    def schema(self) -> str:
        return "row long, block long, draw long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


def endless(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(EndlessSource)
    return spark.readStream.format("endless").options(**{k: str(v) for k, v in options.items()}).load()


def drawn(stream: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Each row of the stream with a row of ``seeds``: those come first in order of ``key``, once each, then they are drawn by hash without end."""
    from corpusloom.operators.sets import numbered

    one = F.lit(1).alias("_all")
    placed = numbered(seeds.select(one, "*"), "_all", [key], "_place").drop("_all")
    n = placed.count()
    at = F.when(F.col("row") < n, F.col("row")).otherwise(F.pmod("draw", F.lit(max(1, n))))
    return stream.withColumn("_place", at + 1).join(placed, "_place").drop("_place")


def flush_blocks(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch as JSON lines, a file for each block of 100 rows in order; a repeated batch replaces its own folder, so
    each row is written once. A task writes whole blocks, some ``SPAN`` of them."""

    def write(batch: DataFrame, number: int) -> None:
        blocks = batch.select("block").distinct().count()
        dealt = batch.repartitionByRange(max(1, -(-blocks // SPAN)), "block").sortWithinPartitions("block", "row")
        dealt.write.mode("overwrite").option("maxRecordsPerFile", BLOCK).json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
