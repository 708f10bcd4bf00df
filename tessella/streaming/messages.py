"""Streams of messages: envelopes, duplicates, sessions and rate limits.

All work on any streaming DataFrame; state is kept by Spark, keyed and bounded by watermarks or timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.functions import text as T
from tessella.sources.scratch import folder

ENVELOPE = "id string, version string, type string, sent timestamp, body string"
#: Largest message, in bytes.
MOST_BYTES = 32 << 20


def envelopes(raw: DataFrame, value: str = "value", major: str = "1", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The fields of each message and ``problem``: why it is refused, or null."""
    parsed = raw.withColumn("_m", F.from_json(value, ENVELOPE))
    problem: Column = (
        F.when(F.octet_length(value) > most_bytes, "too_large")
        .when(F.col("_m").isNull() | F.col("_m.id").isNull() | F.col("_m.type").isNull(), "malformed")
        .when(~T.major_version(F.col("_m.version")).cast("string").eqNullSafe(F.lit(major)), "version")
    )
    return parsed.select(*raw.columns, "_m.*", problem.alias("problem"))


def first_of_each(messages: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each message once within ``delay``; the state is dropped beyond it."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sessions(messages: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """key, start, end and number of messages of each session."""
    found = messages.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("messages"))
    return found.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "messages")


def rate_limited(messages: DataFrame, key: str, ident: str, time: str, per_second: float, burst: float) -> DataFrame:
    """key, ident and whether a token bucket of its key lets each message pass; messages of a batch count by time."""

    def limit(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values([time, ident], kind="stable")
        allowed = []
        for at in rows[time].astype("int64") / 1e9 if str(rows[time].dtype).endswith("[ns]") else rows[time].map(lambda x: x.timestamp()):
            if last is not None:
                tokens = min(burst, tokens + max(0.0, at - last) * per_second)
            last = at if last is None else max(at, last)
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: k[0], ident: rows[ident].to_numpy(), "allowed": allowed})

    kinds = dict(messages.dtypes)
    out = f"{key} {kinds[key]}, {ident} {kinds[ident]}, allowed boolean"
    return messages.select(key, ident, time).groupBy(key).applyInPandasWithState(limit, out, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


#: A new run, one that went silent, and the statuses from which nothing more is to come (fixed values).
NEW, SILENT, ENDED = "AWAITING_ACCEPT", "SILENT", ("COMPLETED", "CANCELLED")


class Runs(StatefulProcessor):
    """Status of a key's run, and one timer: for its silence or, once it is silent or has ended, for its removal.

    What passing time does is one rule, ``elapse``, whether a timer or the next message finds it out, so the result does
    not depend on how messages fall into batches.
    """

    def __init__(self, names: list[str], transitions: dict[tuple[str, str], str], gap: int, ttl: int):
        self.names, self.transitions, self.gap, self.ttl = names, transitions, gap, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, last long, timer long")

    def _live(self, status: str) -> bool:
        return status != SILENT and status not in ENDED

    def elapse(self, status: str, last: int | None, at: int) -> tuple[str, int | None, int | None]:
        """(status, last sign of the run or None, when it went silent if it did) as of ``at``."""
        silent = None
        if last is not None and self._live(status) and at - last > self.gap:
            status, last = SILENT, last + self.gap
            silent = last
        if last is not None and not self._live(status) and at - last > self.ttl:
            status, last = NEW, None
        return status, last, silent

    def _keep(self, status: str, last: int, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (last + (self.gap if self._live(status) else self.ttl)) // 1000 + 1  # the first millisecond behind the moment
        self.handle.registerTimer(timer)
        self.run.update((status, last, timer))

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        ident = pd.array([i for i, *_ in out], dtype="Int64")
        return pd.DataFrame({self.names[0]: key[0], self.names[1]: ident, "at": [x[1] for x in out], "status": [x[2] for x in out], "accepted": [x[3] for x in out]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, ident, action = self.names
        status, last, timer = self.run.get() if self.run.exists() else (NEW, None, None)
        batch = pd.concat(list(rows)).sort_values(["at_us", ident], kind="stable")
        out = []
        for i, at, a in zip(batch[ident].tolist(), batch["at_us"].tolist(), batch[action].tolist(), strict=True):
            status, last, silent = self.elapse(status, last, at)
            if silent is not None:
                out.append((None, silent, SILENT, True))
            after = self.transitions.get((status, a))
            status, last = after or status, at if last is None else max(at, last)
            out.append((i, at, status, after is not None))
        self._keep(status, last, timer)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.run.exists():
            return
        status, last, timer = self.run.get()
        status, last, silent = self.elapse(status, last, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if last is None:
            self.run.clear()
        elif silent is not None:
            self._keep(status, last, None)
            yield self._frame(key, [(None, silent, SILENT, True)])

    def close(self) -> None:
        pass


def run_states(messages: DataFrame, key: str, ident: str, time: str, action: str, transitions: dict[tuple[str, str], str], gap_seconds: int, ttl_seconds: int, delay: str) -> DataFrame:
    """key, ident, at (microseconds), status after it and whether the message was accepted, and a SILENT row without ident a silence.

    A run begins as AWAITING_ACCEPT; a message moves it by (status, action) or, if no such transition exists, is not
    accepted and changes nothing but the time of its last sign. A live run without a sign for ``gap_seconds`` is SILENT; one
    that is silent or has ended is forgotten after ``ttl_seconds``, and the key's next message begins a new one. Messages
    count in order of time and ident within a batch; state is a few numbers a key and goes by timers, as the watermark
    passes. Null times are dropped; a null key is a key. Needs the state store of RocksDB (``drained`` sets it).
    """
    kinds = dict(messages.dtypes)
    shape = f"{key} {kinds[key]}, {ident} {kinds[ident]}, at long, status string, accepted boolean"
    rows = messages.withWatermark(time, delay).filter(F.col(time).isNotNull()).select(key, ident, time, action, F.unix_micros(time).alias("at_us"))
    processor = Runs([key, ident, action], transitions, gap_seconds * 1_000_000, ttl_seconds * 1_000_000)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime")


class Seen(StatefulProcessor):
    """The last ids of a key in the order in which they came first, each with its reply."""

    def __init__(self, names: list[str], most: int, ident_type: str, reply_type: str):
        self.names, self.most, self.shape = names, most, f"ident {ident_type}, reply {reply_type}"

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", self.shape)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        k, ident, reply = self.names
        known = dict(self.seen.get())
        out = []
        for _, i, r in sorted((at, i, r) for b in rows for at, i, r in zip(b["at_us"].tolist(), b[ident].tolist(), b[reply].tolist(), strict=True)):
            again = i in known
            if not again:
                known[i] = r
                if len(known) > self.most:
                    del known[next(iter(known))]
            out.append((key[0], i, again, known[i] if again else r))
        self.seen.put(list(known.items()))
        yield pd.DataFrame(out, columns=[k, ident, "duplicate", reply])

    def close(self) -> None:
        pass


def remembered(messages: DataFrame, key: str, ident: str, time: str, reply: str, most: int = 2000) -> DataFrame:
    """Each message with ``duplicate`` and a reply: its own, or for an id that is among the last ``most`` of its key the one remembered.

    Messages of a batch count in order of time, ident and reply. An id that was pushed out counts as new when it comes again, so the
    state is bounded by a number, not by time. Ident, time and reply are not null.
    """
    kinds = dict(messages.dtypes)
    shape = f"{key} {kinds[key]}, {ident} {kinds[ident]}, duplicate boolean, {reply} {kinds[reply]}"
    rows = messages.select(key, ident, reply, F.unix_micros(time).alias("at_us"))
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Seen([key, ident, reply], most, kinds[ident], kinds[reply]), outputStructType=shape, outputMode="Append", timeMode="None")


class Blocks(StatefulProcessor):
    """Failures of a key in a row, and until when it is blocked; a timer ends the block and forgets the key."""

    def __init__(self, names: list[str], most: int, block: int):
        self.names, self.most, self.block = names, most, block

    def init(self, handle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "count long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        k, ident, failed = self.names
        count, until = self.failures.get() if self.failures.exists() else (0, 0)
        was, out = until, []
        for at, i, bad in sorted((at, i, bad) for b in rows for at, i, bad in zip(b["at_us"].tolist(), b[ident].tolist(), b[failed].tolist(), strict=True)):
            if until and until <= at:
                count, until = 0, 0
            if until:
                out.append((key[0], i, "blocked"))
                continue
            count = count + 1 if bad else 0
            until = at + self.block if count >= self.most else 0
            out.append((key[0], i, "failed" if bad else "passed"))
        if was and was != until:
            self.handle.deleteTimer(was // 1000 + 1)
        if until and was != until:
            self.handle.registerTimer(until // 1000 + 1)
        if count:
            self.failures.update((count, until))
        elif self.failures.exists():
            self.failures.clear()
        yield pd.DataFrame(out, columns=[k, ident, "outcome"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.failures.clear()
        return iter(())

    def close(self) -> None:
        pass


def blocked(messages: DataFrame, key: str, ident: str, time: str, failed: str, most: int = 5, seconds: int = 60, delay: str = "10 seconds") -> DataFrame:
    """key, ident and outcome of each attempt: passed, failed, or blocked for ``seconds`` after ``most`` failures in a row.

    A success forgets the failures before it, the end of a block too. Attempts of a batch count in order of time and ident; a
    blocked one does not count. ``failed`` is not null.
    """
    kinds = dict(messages.dtypes)
    rows = messages.withWatermark(time, delay).filter(F.col(time).isNotNull()).select(key, ident, time, failed, F.unix_micros(time).alias("at_us"))
    shape = f"{key} {kinds[key]}, {ident} {kinds[ident]}, outcome string"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Blocks([key, ident, failed], most, seconds * 1_000_000), outputStructType=shape, outputMode="Append", timeMode="EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, into a table that is read back. In the same folder ``at`` a later run goes on where the last one ended."""
    spark: SparkSession = stream.sparkSession
    at = at or folder(spark, name)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
