"""Leases as keyed state with timers: a lease that is not renewed ends by itself when event time passes its end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievewright.operators.jobs import ATTEMPTS, LEASE, OUT, Job, as_batch, expired, taken

#: Timers need a state store that can be searched by time.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LeaseKeeper(StatefulProcessor):
    """State of a job that is not finished, and a timer at the end of its lease; finished jobs leave nothing."""

    def __init__(self, lease: int, attempts: int):
        self.lease, self.attempts = lease * 1_000_000, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, scheduled bigint, generation bigint, attempt bigint, expires bigint")

    def _get(self) -> Job | None:
        return Job(*self.state.get()) if self.state.exists() else None

    def _put(self, before: Job | None, job: Job | None) -> None:
        """Keep the state, and one timer: the old lease's goes where the lease has changed."""
        ends = [None if x is None or x.expires is None else -(-x.expires // 1_000) for x in (before, job)]
        if ends[0] != ends[1]:
            if ends[0] is not None:
                self.handle.deleteTimer(ends[0])
            if ends[1] is not None:
                self.handle.registerTimer(ends[1])
        if job is not None:
            self.state.update((job.status, job.scheduled, job.generation, job.attempt, job.expires))
        elif before is not None:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        number = lambda c: [None if pd.isna(x) else int(x) for x in log[c]]
        events = zip((t.value // 1_000 for t in log["at"]), number("seq"), log["kind"], number("generation"), log["retryable"])
        before = self._get()
        job, out = taken(key[0], before, events, self.lease, self.attempts)
        self._put(before, job)
        yield as_batch(out).to_pandas()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, row = expired(key[0], self._get(), expiredTimerInfo.getExpiryTimeInMs() * 1_000, self.attempts)
        if row:
            if job is None:
                self.state.clear()
            else:
                self.state.update((job.status, job.scheduled, job.generation, job.attempt, job.expires))
            yield as_batch([row]).to_pandas()

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, lease: int = LEASE, attempts: int = ATTEMPTS, delay: str = "0 seconds") -> DataFrame:
    """The streaming twin of :func:`sievewright.operators.jobs.lease_log`; ``events`` come in order of time but for ``delay``."""
    events.sparkSession.conf.set(*PROVIDER)
    known = events.where("job is not null and at is not null and kind is not null").withWatermark("at", delay)
    return known.groupBy("job").transformWithStateInPandas(LeaseKeeper(lease, attempts), OUT, "append", "eventTime")
