"""Live logs: dense positions for what arrives, a filter on it, and the recent past of each address."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hitlore import sinks
from hitlore.filterlang import where
from hitlore.operators import ipstats
from hitlore.operators.positions import numbered
from hitlore.schema import BLOCK_ROWS, COLUMNS, STORED
from hitlore.session import hadoop_path, place
from hitlore.sources.entries import parsed, stored_rows
from hitlore.sources.requests import valid_rows


_LIVE = T.StructType([*STORED.fields, T.StructField("block_start", T.LongType()), T.StructField("batch", T.LongType())])


def stream(spark: SparkSession, path: str, *, files_at_once: int = 64) -> DataFrame:
    """A stream over Parquet files as they arrive in a folder (or over one file); at most `files_at_once` a batch, which is
    the back-pressure."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    fs, at = hadoop_path(spark, path)
    if fs.isFile(at):
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def lines(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """A stream of the well-formed requests that arrive as JSON lines from a socket (host, port) or Kafka (kafka.bootstrap.servers,
    subscribe), in the columns of request_entries; other lines are skipped."""
    read = spark.readStream.format(source).options(**options).load().select(F.col("value").cast("string").alias("value"))
    return parsed(read, "value").drop("value")


def _noted(spark: SparkSession, path: str) -> int | None:
    """The number in a small file, None where there is no file."""
    fs, where = hadoop_path(spark, path)
    if not fs.exists(where):
        return None
    file = fs.open(where)
    try:
        return int(file.readLine())
    finally:
        file.close()


def _note(spark: SparkSession, path: str, number: int) -> None:
    fs, where = hadoop_path(spark, path)
    file = fs.create(where, True)
    file.writeBytes(str(number))
    file.close()


def ingest(entries: DataFrame, out: str, checkpoint: str, *, block_rows: int = BLOCK_ROWS, once: bool = True):
    """Start storing a stream of request_entries rows with dense positions, within each batch in the order of entry_id, or as the
    source gives them where there is none. once=False goes on until it is stopped.

    A batch writes a folder of its own, replaced if the batch is run again, and a note of the end of the log after it, which is
    where the next one begins: a restart from the checkpoint continues without gap or repetition, and no batch reads what was
    stored before.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _noted(spark, f"{out}/_ends/{number - 1}") or 0
        known = batch if "entry_id" in batch.columns else batch.withColumn("entry_id", F.monotonically_increasing_id())
        rows = numbered(stored_rows(valid_rows(known)), ["entry_id"], start=before)
        placed = rows.withColumn("block_start", F.col("position") - F.col("position") % block_rows)
        placed.select(*COLUMNS, "block_start").write.mode("overwrite").parquet(f"{out}/batch={number}")
        _note(spark, f"{out}/_ends/{number}", before + spark.read.parquet(f"{out}/batch={number}").count())

    writer = entries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stop(query, spark: SparkSession, out: str, store: str, *, block_rows: int = BLOCK_ROWS) -> int:
    """Shut an ingest down: what has arrived is stored, the stream ends, and the open block is flushed."""
    query.processAllAvailable()
    query.stop()
    return seal(spark, out, store, block_rows=block_rows, flush=True)


def end_of(spark: SparkSession, out: str) -> int:
    """The end of a live log, from the notes of its batches."""
    fs, where = hadoop_path(spark, f"{out}/_ends")
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(where)] if fs.exists(where) else []
    return _noted(spark, f"{out}/_ends/{max(numbers)}") if numbers else 0


def live_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_LIVE).option("basePath", out).parquet(out).drop("batch")


def seal(spark: SparkSession, out: str, store: str, *, block_rows: int = BLOCK_ROWS, flush: bool = False) -> int:
    """Write the full blocks of a live log that are not sealed yet to a stored log, with flush the open block as well; how many rows.

    What a flush has sealed of a block stays; the block goes on with the rows after it. Nothing to seal is no error. Stop a
    stream, wait for its batch and flush to shut down without loss.
    """
    sealed, end = _noted(spark, f"{store}/_sealed") or 0, end_of(spark, out)
    beyond = end if flush else end - end % block_rows
    if beyond <= sealed:
        return 0
    rows = live_rows(spark, out).where((F.col("position") >= sealed) & (F.col("position") < beyond))
    sinks.write_blocks(rows, store, block_rows=block_rows)
    _note(spark, f"{store}/_sealed", beyond)
    return beyond - sealed


def attach(spark: SparkSession, out: str, *, block_rows: int = BLOCK_ROWS, backlog: int = 1000) -> DataFrame:
    """A live log as a stream that begins with the open block and at least `backlog` rows before it, and goes on with what comes."""
    end = end_of(spark, out)
    first = max(end - end % block_rows - backlog, 0)
    return spark.readStream.schema(_LIVE).option("basePath", out).parquet(out).where(F.col("position") >= first).drop("batch")


def follow(log: DataFrame, f, out: str, checkpoint: str, *, now: int | None = None):
    """Start writing the rows of a live log that a filter keeps. Relative times refer to `now`, by default the time of each batch."""

    def keep(batch: DataFrame, number: int) -> None:
        where(batch, f, now=now).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return log.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "times array<bigint>, uris array<string>, agents array<string>, statics array<boolean>"
#: Columns of an arriving row; rows of an address that are worked on at once.
_KINDS = {"position": "int64", "time": "int64", "u": "object", "a": "object", "s": "bool"}
PIECE = 10_000
_OUT = "position bigint, ip binary, " + ", ".join(f"{n} double" for n in ipstats.NAMES)


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState, most: int, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    memory = ipstats.Recent(most)
    if state.exists:
        for event in zip(*state.get, strict=True):
            memory.remember(*event)
    # Order needs all rows of the batch; what is made of them is made in pieces.
    columns = {n: [] for n in _KINDS}
    for batch in batches:
        for n, kind in _KINDS.items():
            columns[n].append(batch[n].to_numpy(kind))
    position, time, uri, agent, static = (np.concatenate(columns.pop(n)) for n in _KINDS)
    order = np.argsort(position, kind="stable")
    for at in range(0, len(order), PIECE):
        own = order[at : at + PIECE]
        numbers = [memory.add(*row) for row in zip(*(x[own].tolist() for x in (time, uri, agent, static)), strict=True)]
        yield pd.DataFrame({"position": position[own], "ip": [key[0]] * len(own)} | {n: [x[i] for x in numbers] for i, n in enumerate(ipstats.NAMES)})
    columns = list(zip(*memory.events, strict=True)) or [(), (), (), ()]
    state.update(tuple(list(c) for c in columns))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)


def live_ip_stats(log: DataFrame, *, most: int = ipstats.MOST, idle_ms: int | None = None) -> DataFrame:
    """ipstats.exact over a stream: the memory of an address is kept state of at most `most` events.

    The rows that one micro-batch brings of one address are held in one task, because they may come in any order.
    idle_ms forgets addresses that are silent for so long; None keeps them. Late rows are neither dropped nor moved.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    rows = ipstats._prepared(log)

    def run(key, batches, state):
        yield from _advance(key, batches, state, most, idle_ms)

    return rows.groupBy("ip").applyInPandasWithState(run, _OUT, _STATE, "append", timeout)


def to_table(frame: DataFrame, name: str):
    """Run a stream over what is there now and read what it wrote."""
    spark = frame.sparkSession
    out = place(spark, name)
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", place(spark, name)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)
