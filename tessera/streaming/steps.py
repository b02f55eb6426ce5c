"""Streaming twins of the event-log operators, over any streaming DataFrame.

State is per key and bounded. Sink and checkpoint lie in one folder of shared storage; a query that
is started again with the same folder goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vector import latest
from ..sources.shared import path_in, scratch


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet files, or of the files in the tables, of this name (or pattern) in a folder."""
    path = f"{folder}/{name}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    place, store = path_in(spark, path)
    if any(s.isDirectory() for s in store.globStatus(place) or ()):  # a filter by name would leave out the files in it
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what there is now into Parquet files (append mode) and read all that it has written.

    With a folder (in shared storage) the stream goes on where the last run with that folder
    stopped; without one it starts anew in the shared folder.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_updates(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """As drain(), in update mode: of each key the row of its last batch. A batch that is run again replaces its own files."""
    spark = stream.sparkSession
    folder = folder or scratch(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    put(spark.createDataFrame([], stream.schema), -1)  # so that there is a table even without a batch
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return latest(spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out"), keys, "batch").drop("batch")


def streaks(events: DataFrame, key: str, failed: Column, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """key, tie, streak for each event: failures in a row, carried over batches by state. Late rows count when they come."""

    def step(k, batches, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["_ts", "_tie"])
        now, out = (state.get[0] if state.exists else 0), []
        for bad in rows["_bad"]:
            now = now + 1 if bad else 0
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({key: [k[0]] * len(out), tie: rows["_tie"].to_numpy(), "streak": out})

    rows = events.select(key, F.col(ts).cast("timestamp").alias("_ts"), F.col(tie).alias("_tie"), failed.alias("_bad"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {tie} long, streak long", "n long", "append", GroupStateTimeout.NoTimeout)


#: The store that keeps the state of transformWithState: on local disks, with its changes in the checkpoint.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, returns: str, mode: str, clock: str = "None") -> DataFrame:
    """Sets the session's state store to the one that the operator needs, for queries that start after it.

    Names of columns may not begin with an underscore: the processor would see others.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(processor, returns, mode, clock)


class _Circuit(StatefulProcessor):
    """State: failures in a row and the circuit's name, and a timer while it is open."""

    def __init__(self, key: str, limit: int, rest_ms: int, by_event: bool):
        self.key, self.limit, self.rest_ms, self.by_event = key, limit, rest_ms, by_event

    def init(self, handle) -> None:
        self.handle, self.now = handle, handle.getValueState("now", "n long, name string")

    def _out(self, key, names):
        import pandas as pd

        return pd.DataFrame({self.key: [key[0]] * len(names), "state": pd.Series(names, dtype=object)})

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        tables = [t for t in rows if len(t)]
        if not tables:  # a key that comes for its timer only
            return
        table = pd.concat(tables).sort_values(["at", "tie"])
        count, name = self.now.get() if self.now.exists() else (0, "closed")
        out = []
        for bad in table["bad"]:
            count = count + 1 if bad else 0
            new = "closed" if not bad else "open" if count >= self.limit else name
            if new != name:
                out.append(new)
            name = new
        self.now.update((count, name))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if name == "open" and self.by_event:
            self.handle.registerTimer(max(int(table["at"].iloc[-1].timestamp() * 1000) + self.rest_ms, timerValues.getCurrentWatermarkInMs() + 1))
        elif name == "open":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.rest_ms)
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.now.update((self.now.get()[0], "half_open"))
        yield self._out(key, ["half_open"])

    def close(self) -> None:
        pass


def circuits(events: DataFrame, key: str, failed: Column, limit: int = 5, rest_ms: int = 60_000, late: str | None = None) -> DataFrame:
    """key, state for each change: opens after `limit` failures in a row, half-opens by a timer, closes on success.

    The timer runs by the wall clock, or, with `late`, by event time as far as the watermark (`late`
    behind the newest event) has come. A wall clock never ends, so only the latter can be drained.
    """
    rows = events.select(key, F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie"), failed.alias("bad"))
    if late is not None:
        rows = rows.withWatermark("at", late)
    return _stateful(rows, key, _Circuit(key, limit, rest_ms, late is not None), f"{key} long, state string", "Append", "ProcessingTime" if late is None else "EventTime")


#: Characters of a guidance that are kept.
GUIDANCE = 1000


class _Mailbox(StatefulProcessor):
    """State: the advice that waits, which may expire, and the last guidance."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.box = handle.getValueState("box", "text string", self.ttl_ms) if self.ttl_ms else handle.getValueState("box", "text string")
        self.guide = handle.getValueState("guide", "text string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        table = pd.concat(list(rows)).sort_values("seq")
        box = self.box.get()[0] if self.box.exists() else None
        guide = self.guide.get()[0] if self.guide.exists() else ""
        before, out = box, []
        for seq, kind, text in table[["seq", "kind", "text"]].itertuples(index=False):
            if kind == "put":
                box = text or ""
            elif kind == "clear":
                box = None
            elif kind == "guide":
                guide = (text or "")[:GUIDANCE]
            elif kind == "has":
                out.append((seq, kind, "true" if box is not None else "false"))
            elif kind == "guidance":
                out.append((seq, kind, guide))
            elif box is not None:
                out.append((seq, kind, box))
                box = None if kind == "consume" else box
        if box is None:
            self.box.clear()
        elif box != before or "put" in set(table["kind"]):
            self.box.update((box,))
        if guide:
            self.guide.update((guide,))
        plain = lambda values: pd.Series(values, dtype=object)  # noqa: E731  # Spark takes no other strings here
        yield pd.DataFrame({"session": plain([key[0]] * len(out)), "seq": [o[0] for o in out], "kind": plain([o[1] for o in out]), "answer": plain([o[2] for o in out])})

    def close(self) -> None:
        pass


def mailbox(messages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """session, seq, kind, answer of each message that asks. messages: session, seq, kind, text.

    put leaves an advice, the last one counts; consume answers with it and takes it out, peek
    leaves it, clear drops it, and the first two say nothing if there is none; has answers true or
    false. guide sets the guidance (cut to GUIDANCE characters), guidance answers with the last one, empty before the
    first. With ttl_ms an advice that waits longer, by the wall clock, is gone.
    """
    return _stateful(messages, "session", _Mailbox(ttl_ms), "session string, seq long, kind string, answer string", "Append", "ProcessingTime" if ttl_ms else "None")


class _LastRows(StatefulProcessor):
    """State: a list of n values at most."""

    def __init__(self, key: str, order: str, value: str, n: int):
        self.key, self.order, self.value, self.n = key, order, value, n

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", "v double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        old = [r[0] for r in self.kept.get()] if self.kept.exists() else []
        new = [float(v) for v in pd.concat(list(rows)).sort_values(self.order)[self.value].tail(self.n)]
        if len(old) + len(new) > self.n:
            self.kept.put([(v,) for v in (old + new)[-self.n :]])
        else:
            self.kept.appendList([(v,) for v in new])
        yield pd.DataFrame({self.key: [key[0]], "kept": [(old + new)[-self.n :]]})

    def close(self) -> None:
        pass


def last_rows(events: DataFrame, key: str, order: str, value: str, n: int = 100) -> DataFrame:
    """key, kept: the newest n values of each key after each batch that has rows of it."""
    return _stateful(events.select(key, order, F.col(value).cast("double").alias(value)), key, _LastRows(key, order, value, n), f"{key} long, kept array<double>", "Update")


def window_counts(events: DataFrame, keys: list[str], size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """keys, start, n: events in windows of event time, closed by the watermark in streams."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", size, slide) if slide else F.window("_ts", size), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), "n")
