"""Stateful flows over change events, and what they do to a finished table.

The streams read files with ``availableNow`` and keep their state and progress in the shared checkpoint folder.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.core.storage import checkpoint_dir, cut, remove


def change_stream(spark: SparkSession, base: str, table: str = "events") -> DataFrame:
    """The rows of a table (a folder of files, or one file) as a stream of its files."""
    place = f"{base}/{table}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(place).schema)
    return reader.parquet(place) if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(base)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream holds now, processed once and read back."""
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = cut(spark.read.parquet(f"{place}/out"))
    remove(spark, place)
    return found


def debounced(events: DataFrame, key: str, gap: str = "5 minutes", most: str | None = None) -> DataFrame:
    """``key, start, stop, n``: events of a key that follow each other within ``gap`` as one batch.

    With ``most`` a batch isn't held back longer: while a key stays busy, one is flushed every ``most`` from its first
    event on. ``stop`` is then the batch's last event, else the end of the gap behind it.
    """
    if most is None:
        grouped = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
        return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.coalesce(F.col("ts") >= F.lag("ts").over(order) + F.expr(f"interval {gap}"), F.lit(True))
    busy = events.select(key, "event_id", "ts", fresh.cast("int").alias("_fresh")).withColumn("_busy", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.timestamp_diff("MICROSECOND", F.min("ts").over(Window.partitionBy(key, "_busy")), F.col("ts"))
    width = F.timestamp_diff("MICROSECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz") + F.expr(f"interval {most}"))
    flushed = busy.withColumn("_flush", F.floor(since / width))
    return flushed.groupBy(key, "_busy", "_flush").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).select(key, "start", "stop", "n")


def _in_order(rows: DataFrame, key: str, start, step, out: str, columns: list[str]) -> DataFrame:
    """Every row of a key in the order of its events, through ``step(state, row) -> (state, values)``; ``columns``: what is given out before the values.

    A key's rows come in order to one task, which keeps nothing but the state of the key that it is at.
    """
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for b in batches:
            found = []
            for row in b.itertuples(index=False):
                now = getattr(row, key)
                if now != at:
                    at, state = now, start
                state, values = step(state, row)
                found.append((*(getattr(row, c) for c in columns), *values))
            yield pd.DataFrame(found, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, out)


def folded(rows: DataFrame, key: str, start, step, out: str, columns: list[str]) -> DataFrame:
    """``_in_order`` for a finished table; for a stream the same with the state of each key kept between its batches."""
    if not rows.isStreaming:
        return _in_order(rows, key, start, step, out, columns)
    names = [x.split()[0] for x in out.split(", ")]

    def fold(_, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else start
        found = []
        for row in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (r.ts, r.event_id)):
            state, values = step(state, row)
            found.append((*(getattr(row, c) for c in columns), *values))
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(found, columns=names)

    return rows.groupBy(key).applyInPandasWithState(fold, out, "state binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """``start, event_type, n``: events by time and kind; with ``late`` rows that come later than that are dropped."""
    rows = events if late is None else events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def rate_limited(events: DataFrame, key: str = "user_id", seconds: int = 3600) -> DataFrame:
    """``key, event_id, kept``: an event passes if the last passed one of its key that completed is at least ``seconds`` ago.

    An event of type error fails: it passes, but doesn't start the wait.
    """

    def step(last, row):
        at = int(pd.Timestamp(row.ts).value // 1000)
        passed = last is None or at - last >= seconds * 1_000_000
        return (at if passed and row.event_type != "error" else last), (passed,)

    return folded(events.where(F.col(key).isNotNull()).select(key, "event_id", "ts", "event_type"), key, None, step, f"{key} long, event_id long, kept boolean", [key, "event_id"])


def signature_changes(events: DataFrame, key: str = "user_id", signature: str = "event_type") -> DataFrame:
    """Events whose signature differs from the one before of the same key; of a stream ``key, event_id`` of these."""
    if events.isStreaming:
        step = lambda last, row: (getattr(row, signature), (last is None or last != getattr(row, signature),))
        marked = folded(events.select(key, "event_id", "ts", signature), key, None, step, f"{key} long, event_id long, changed boolean", [key, "event_id"])
        return marked.where("changed").select(key, "event_id")
    before = F.lag(signature).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(signature))).drop("_before")


def in_flight(events: DataFrame, key: str = "user_id") -> DataFrame:
    """``event_id, state``: a click starts work, a view while it runs is dropped, a purchase or error ends it."""
    if events.isStreaming:

        def step(running, row):
            dropped = running and row.event_type in ("click", "view")
            running = True if row.event_type == "click" else False if row.event_type in ("purchase", "error") else running
            return running, ("dropped" if dropped else "taken",)

        return folded(events.select(key, "event_id", "ts", "event_type"), key, False, step, "event_id long, state string", ["event_id"])
    work = F.when(F.col("event_type") == "click", 1).when(F.col("event_type").isin("purchase", "error"), 0)
    running = F.last(work, ignorenulls=True).over(Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    state = F.when((F.coalesce(running, F.lit(0)) == 1) & F.col("event_type").isin("click", "view"), "dropped").otherwise("taken")
    return events.select("event_id", state.alias("state"))


def circuit(outcomes: DataFrame, threshold: int = 5, wait_seconds: int = 30) -> DataFrame:
    """``key, event_id, state`` after every outcome (key, event_id, ts, ok): closed, open or half-open.

    The circuit opens with the failure that is exactly the ``threshold``-th in a row, is half-open after the wait, and
    closes with a success; a later failure doesn't stamp a new opening time.
    """

    def step(state, row):
        fails, opened = state
        if row.ok:
            fails, opened = 0, None
        else:
            fails += 1
            opened = row.ts if fails == threshold else opened
        said = "closed" if opened is None else "open" if (row.ts - opened).total_seconds() < wait_seconds else "half_open"
        return (fails, opened), (said,)

    return folded(outcomes.where("key is not null"), "key", (0, None), step, "key long, event_id long, state string", ["key", "event_id"])


def claimed(outbox: DataFrame, most: int) -> DataFrame:
    """The oldest pending entries (id, created, status, retries, touched)."""
    return outbox.where("status = 'pending'").orderBy("created", "id").limit(most)


def reaped(outbox: DataFrame, now, minutes: int = 5) -> DataFrame:
    """Entries with those set back to pending that are in work for too long."""
    stuck = (F.col("status") == "processing") & (F.col("touched") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return outbox.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def purged(outbox: DataFrame, now, done_hours: int = 24, failed_days: int = 7, most_retries: int = 3) -> DataFrame:
    """Entries without those long done or long given up."""
    done = (F.col("status") == "done") & (F.col("touched") < now - F.make_dt_interval(hours=F.lit(done_hours)))
    failed = (F.col("status") == "failed") & (F.col("retries") >= most_retries) & (F.col("touched") < now - F.make_dt_interval(days=F.lit(failed_days)))
    return outbox.where(~(done | failed))
