"""Fixed-window admission of requests: the first N per key and window are admitted, the rest are not."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postingflow.functions.text import null_if_blank, trim_space
from postingflow.operators.scan import first_n

# Requests per key and minute of each guarded action.
LIMITS = {"register": 6, "login": 10, "resend": 4, "forgot": 4, "reset": 6}


def client_key(forwarded_for: Column, remote: Column) -> Column:
    """First forwarded address, else the remote address, else 'unknown'."""
    entries = F.filter(F.split(F.coalesce(forwarded_for, F.lit("")), ","), lambda e: trim_space(e) != "")
    return F.coalesce(trim_space(F.try_element_at(entries, F.lit(1))), null_if_blank(remote), F.lit("unknown"))


def _limit(limits: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("policy"))


def admit(requests: DataFrame, limits: dict[str, int] = LIMITS, window: str = "1 minute") -> DataFrame:
    """Add `admitted` to a request log (request_id, policy, key, ts); windows are epoch aligned.

    Only the first few rows of a key leave each map task: the largest limit bounds them.
    """
    keyed = requests.withColumn("window_start", F.window("ts", window).start)
    first = first_n(keyed.select("request_id", "policy", "key", "window_start", "ts"), ["policy", "key", "window_start"],
                    [F.col("ts"), F.col("request_id")], max(limits.values()))
    passed = first.filter(F.col("rn") <= _limit(limits)).select("request_id", F.lit(True).alias("admitted"))
    return keyed.join(passed, "request_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


_OUT = "request_id string, policy string, key string, window_start timestamp, ts timestamp, admitted boolean"


class _Counter(StatefulProcessor):
    """Counts admitted requests of one (policy, key, window); forgets them when the window is past."""

    def __init__(self, limits: dict[str, int]):
        self._limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._used = handle.getValueState("used", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit = self._limits.get(key[0], 0)
        used = self._used.get()[0] if self._used.exists() else 0
        if not used:
            end = int(pd.Timestamp(key[2]).timestamp() * 1000)
            self._handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        # At most `limit` rows per task arrive here, so this is a small frame.
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        free = max(limit - used, 0)
        batch["admitted"] = [i < free for i in range(len(batch))]
        self._used.update((used + min(free, len(batch)),))
        batch["window_start"] = key[2]
        yield batch[["request_id", "policy", "key", "window_start", "ts", "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._used.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limits: dict[str, int] = LIMITS, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """`admit` over a stream: in time order inside a micro-batch, in arrival order across them.

    Rows later than the watermark are dropped. Each task first turns away what exceeds the limit inside
    its own rows, so a key that sends a third of all requests reaches the counter as a few rows per task.
    """
    most = dict(limits)

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(["ts", "request_id"])
            place = frame.groupby(["policy", "key", "window_start"], dropna=False).cumcount()
            frame["over"] = place >= frame["policy"].map(most).fillna(0)
            yield frame

    cols = ["request_id", "policy", "key", "ts"]
    keyed = requests.select(*cols).withColumn("window_start", F.window("ts", window).start)
    judged = keyed.mapInPandas(prune, "request_id string, policy string, key string, ts timestamp, window_start timestamp, over boolean").withWatermark("ts", late)
    turned = judged.filter("over").select("request_id", "policy", "key", "window_start", "ts", F.lit(False).alias("admitted"))
    counted = judged.filter(~F.col("over")).groupBy("policy", "key", "window_start").transformWithStateInPandas(
        statefulProcessor=_Counter(limits), outputStructType=_OUT, outputMode="append", timeMode="eventtime")
    return counted.unionByName(turned)
