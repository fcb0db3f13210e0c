"""The request-side operators over streams: limits with keyed state, sessions, heartbeats. Event time, late rows dropped by watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.requests import LIMIT, SILENCE, WINDOW, Limiter


class LimitProcessor(StatefulProcessor):
    """Per key the accepted times of the last WINDOW seconds, as one list in a value state."""

    def __init__(self, limit: int = LIMIT, seconds: float = WINDOW) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limiter = Limiter(self.limit, self.seconds * 1_000_000)
        if self.accepted.exists():
            limiter.accepted.extend(self.accepted.get()[0])
        table = pd.concat(list(rows)).sort_values(["us", "event_id"])
        good = [limiter.check(us) for us in table["us"]]
        self.accepted.update((list(limiter.accepted),))
        yield pd.DataFrame({"event_id": table["event_id"], "user_id": table["user_id"], "accepted": good})

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, limit: int = LIMIT, seconds: float = WINDOW) -> DataFrame:
    """(event_id, user_id, accepted) of a stream (event_id, user_id, ts); a batch's rows of a user are taken in order of time.

    Needs the RocksDB state store. Rows without a user or time are left out.
    """
    rows = events.filter("user_id is not null and ts is not null").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=LimitProcessor(limit, seconds), outputStructType="event_id bigint, user_id bigint, accepted boolean", outputMode="append", timeMode="None"
    )


def heartbeat_stream(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """(start, requests, errors) per interval, given out once the watermark has passed its end."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    beats = timed.groupBy(F.window("at", every).alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return beats.select(F.col("w.start").alias("start"), "requests", "errors")


def session_stream(events: DataFrame, late: str = "10 minutes", silence: int = SILENCE) -> DataFrame:
    """(user_id, started, ended, requests) per session, given out once it is over for good."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", f"{silence} seconds").alias("w")).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("requests")).drop("w")
