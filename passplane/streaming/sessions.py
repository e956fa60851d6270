"""Sessions as streams: an extension, since the service that this library follows handles one request at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A session's deadline: so long after its first event, whatever comes later.
TTL_MS = 30 * 60 * 1000

#: The state store that holds more state than memory.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

STATUS = "session_id long, status string, captured string, at timestamp"


def first_captures(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """The first capture of each session and side within the watermark; later ones are duplicates (no replacement)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "side"])


def last_captures(events: DataFrame) -> DataFrame:
    """(session_id, side, ts, attempts): the last capture of each session and side so far, which replaces the ones before.

    For the update or complete mode: a replacement is a new row of the same key.
    """
    return events.groupBy("session_id", "side").agg(F.max("ts").alias("ts"), F.count("*").alias("attempts"))


def captures_per_window(events: DataFrame, width: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """(start, side, n): captures in tumbling windows, final once the watermark has passed."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "side").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "side", "n")


def statuses(events: DataFrame, sides: tuple[str, ...] = ("FRONT", "BACK"), delay: str = "30 minutes") -> DataFrame:
    """A row for each change of status of a session: IN_PROGRESS, COMPLETED with all sides, EXPIRED at its deadline.

    events: session_id, side, ts. State holds the sides seen and the deadline; activity does not move the deadline, so a
    session window would not do. Completed and expired sessions leave the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, deadline = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "status": ["EXPIRED"], "captured": [seen], "at": [pd.Timestamp(deadline, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        deadline = deadline or int(rows.ts.iloc[0].timestamp() * 1000) + TTL_MS
        own = [s for s in seen.split(",") if s]
        late = rows.ts > pd.Timestamp(deadline, unit="ms")
        own = sorted({*own, *rows.side[~late]})
        done = set(sides) <= set(own)
        status = "COMPLETED" if done else "EXPIRED" if late.any() else "IN_PROGRESS"
        if status == "IN_PROGRESS":
            state.update((",".join(own), deadline))
            if deadline > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(deadline)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "captured": [",".join(own)], "at": [rows.ts.max() if status != "EXPIRED" else pd.Timestamp(deadline, unit="ms")]})

    keyed = events.select("session_id", "side", "ts").withWatermark("ts", delay).groupBy("session_id")
    return keyed.applyInPandasWithState(step, STATUS, "seen string, deadline long", "append", GroupStateTimeout.EventTimeTimeout)


#: Sessions are dealt to so many groups, each with one state value; fixed for the life of a stream's progress.
BUCKETS = 1024


def outcomes(events: DataFrame, sides: tuple[str, ...] = ("FRONT", "BACK"), delay: str = "30 minutes", buckets: int = BUCKETS) -> DataFrame:
    """One row a session, once it is known: COMPLETED when its last side comes, EXPIRED at its deadline.

    events: session_id, side, ts. A group of sessions is one key, so Python is called once a group and batch, not once a session. State holds each open session's sides
    seen (bits; -1 once its outcome was given) and its deadline, which activity does not move; a session goes when the watermark passes the deadline.
    """
    bits, full = {side: 1 << k for k, side in enumerate(sides)}, (1 << len(sides)) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, masks, deadlines = state.get if state.exists else ([], [], [])
        held = dict(zip(ids, zip(masks, deadlines, strict=True), strict=True))
        out, mark = [], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = sorted((us, session, side) for pdf in batches for us, session, side in zip(pdf["us"].tolist(), pdf["session_id"].tolist(), pdf["side"].tolist(), strict=True))
            for us, session, side in rows:
                seen, deadline = held.get(session) or (0, us // 1000 + TTL_MS)
                if seen >= 0:
                    if us // 1000 > deadline:
                        out.append((session, "EXPIRED", seen, deadline * 1000))
                        seen = -1
                    elif side in bits:
                        seen |= bits[side]
                        if seen == full:
                            out.append((session, "COMPLETED", seen, us))
                            seen = -1
                held[session] = (seen, deadline)
        gone = [session for session, (_, deadline) in held.items() if deadline < mark]
        for session in gone:
            seen, deadline = held.pop(session)
            if seen >= 0:
                out.append((session, "EXPIRED", seen, deadline * 1000))
        if held:
            state.update((list(held), [seen for seen, _ in held.values()], [deadline for _, deadline in held.values()]))
            state.setTimeoutTimestamp(max(min(deadline for _, deadline in held.values()), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            found = pd.DataFrame(out, columns=["session_id", "status", "captured", "us"])
            yield found.assign(captured=[",".join(sorted(side for side, bit in bits.items() if seen & bit)) for seen in found.captured])

    bucket = F.pmod(F.hash("session_id"), F.lit(buckets)).alias("bucket")
    keyed = events.select(bucket, "session_id", "side", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay).groupBy("bucket")
    found = keyed.applyInPandasWithState(step, "session_id long, status string, captured string, us long", "ids array<long>, seen array<long>, deadlines array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("session_id", "status", "captured", F.timestamp_micros("us").alias("at"))


def replaced(events: DataFrame) -> DataFrame:
    """(session_id, side, ts, capture_id, attempts): after each batch the last capture, by time and number, of each session and side that had one, which replaces
    those before; of rows of one key the one with most attempts is the latest. An aggregate of Spark's own holds the state.

    events: session_id, side, ts, capture_id. For the update mode.
    """
    last = events.groupBy("session_id", "side").agg(F.max(F.struct("ts", "capture_id")).alias("last"), F.count("*").alias("attempts"))
    return last.select("session_id", "side", "last.ts", "last.capture_id", "attempts")


def run_through(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, batch by batch, to a table in a folder, and gives the table. Batches that are repeated after a failure write the same
    files."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
        # a file sink takes appended rows only; updates are written batch by batch, each to a place of its own
        if mode == "append":
            query = writer.format("parquet").start(f"{folder}/rows")
        else:
            query = writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
