"""Keyed state: rate limits, status machines, lock-outs; the same step over sorted batches and over streams.

A step takes (state, row) and returns (state, result). In a batch, rows are dealt by key and sorted, and a task
goes through them with only the present key's state in memory. In a stream, the state lives in the state store.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import reachable

State = tuple | None
Step = Callable[[State, Any], tuple[State, Any]]

# fixed values: allowed changes of status
SOS_CHANGES = {"RECEIVED": ("ASSIGNED",), "ASSIGNED": ("RESPONDING", "RECEIVED"), "RESPONDING": ("RESOLVED",), "RESOLVED": ()}
ALERT_CHANGES = {"NEW": ("ACKNOWLEDGED", "ASSIGNED"), "ACKNOWLEDGED": ("ASSIGNED", "RESOLVED"), "ASSIGNED": ("RESPONDING", "RESOLVED"), "RESPONDING": ("RESOLVED",), "RESOLVED": ()}
CASE_CHANGES = {
    "OPEN": ("UNDER_INVESTIGATION", "CLOSED"),
    "UNDER_INVESTIGATION": ("REVIEW", "RESOLVED", "OPEN"),
    "REVIEW": ("RESOLVED", "UNDER_INVESTIGATION"),
    "RESOLVED": ("CLOSED", "REVIEW"),
    "CLOSED": (),
}


def rate_limit(limit: int, seconds: float = 60.0) -> Step:
    """Accept a call unless `limit` accepted ones lie within the last `seconds`; rejected calls don't count."""

    def step(state: State, row: Any) -> tuple[State, bool]:
        now = row.seconds
        recent = [t for t in (state or ()) if t >= now - seconds]
        if len(recent) >= limit:
            return tuple(recent), False
        return (*recent, now), True

    # accepted calls count up to `seconds` after the last of them
    step.expires = lambda state: state[-1] + seconds if state else 0.0
    return step


def status_machine(changes: dict[str, tuple[str, ...]], first: str) -> Step:
    """Accept a status that may follow the present one; the first must be `first`."""

    def step(state: State, row: Any) -> tuple[State, bool]:
        present = state[0] if state else None
        good = row.status == first if present is None else row.status in changes.get(present, ())
        return ((row.status,) if good else state), good

    return step


def lock_out(failures: int = 5, seconds: float = 900.0) -> Step:
    """OK, FAILED, ACCOUNT_LOCKED or REFUSED for each attempt: so many failures in a row lock for `seconds`."""

    def step(state: State, row: Any) -> tuple[State, str]:
        count, until = state or (0, 0.0)
        if row.seconds < until:
            return (count, until), "REFUSED"
        if row.success:
            return (0, 0.0), "OK"
        if count + 1 >= failures:
            return (0, row.seconds + seconds), "ACCOUNT_LOCKED"
        return (count + 1, 0.0), "FAILED"

    # failures count until a success or a lock, however old; a lock ends at its time
    step.expires = lambda state: None if state[0] else state[1]
    return step


def accounts(attempts: DataFrame, now: Column, locked: int = 900, session: int = 43200) -> DataFrame:
    """Each account's state at `now` after attempts (user_id, event_id, seconds, result) that went through lock_out().

    (user_id, last_login, locked_until, locked, failed_attempts, sessions): failures count since the last success or
    lock, refused ones don't; a session is a success of the last `session` seconds. Two rounds of partial sums, no row
    of an account is gathered.
    """
    place = F.struct("seconds", "event_id")
    at = lambda kind: F.max(F.when(F.col("result") == kind, F.col("seconds")))
    fresh = F.count_if((F.col("result") == "OK") & (F.col("seconds") > now - session))
    one = attempts.groupBy("user_id").agg(at("OK").alias("last_login"), (at("ACCOUNT_LOCKED") + locked).alias("locked_until"), fresh.alias("sessions"), F.max(F.when(F.col("result").isin("OK", "ACCOUNT_LOCKED"), place)).alias("reset"))
    since = attempts.where("result = 'FAILED'").join(one.select("user_id", "reset"), "user_id").where(F.col("reset").isNull() | (place > F.col("reset")))
    failed = since.groupBy("user_id").agg(F.count("*").alias("failed_attempts"))
    out = one.join(failed, "user_id", "left")
    return out.select("user_id", "last_login", "locked_until", F.coalesce(F.col("locked_until") > now, F.lit(False)).alias("locked"), F.coalesce("failed_attempts", F.lit(0)).alias("failed_attempts"), "sessions")


def folded(rows: DataFrame, key: str, order: list[str], step: Step, kind: str) -> DataFrame:
    """The rows with a column result of type kind: step over each key's rows in order."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", result {kind}"
    names = rows.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, state = object(), None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                own = getattr(row, key)
                if own != present:
                    present, state = own, None
                state, result = step(state, row)
                out.append(result)
            yield b.assign(result=out)[[*names, "result"]]

    reachable(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.where(F.col(key).isNotNull()).repartition(n, key).sortWithinPartitions(key, *order).mapInPandas(work, schema)


def folded_stream(rows: DataFrame, key: str, order: list[str], step: Step, kind: str, state_kind: str) -> DataFrame:
    """As folded(), on a stream: each micro-batch's rows of a key go on from its stored state, a JSON string."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", result {kind}"
    names = rows.columns

    def work(own: tuple, batches: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(json.loads(store.get[0])) if store.exists else None
        b = pd.concat(list(batches)).sort_values(order)
        out = []
        for row in b.itertuples(index=False):
            state, result = step(state, row)
            out.append(result)
        store.update((json.dumps(state),))
        yield b.assign(result=out)[[*names, "result"]]

    reachable(rows.sparkSession)
    return rows.groupBy(key).applyInPandasWithState(work, schema, state_kind, "append", GroupStateTimeout.NoTimeout)


class _Fold(StatefulProcessor):
    """A step over the rows of a key; a timer clears the state when it no longer differs from none."""

    def __init__(self, order: list[str], step: Step, columns: list[str]) -> None:
        self.order, self.step, self.columns = order, step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(json.loads(self.state.get()[0])) if self.state.exists() else None
        b = pd.concat(list(rows)).sort_values(self.order)
        out = []
        for row in b.itertuples(index=False):
            state, result = self.step(state, row)
            out.append(result)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        until = self.step.expires(state)
        if until is None:
            self.state.update((json.dumps(state),))
        elif until <= 0:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
            self.handle.registerTimer(math.ceil(until * 1000) + 1)
        yield b.assign(result=out)[self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def timed_stream(rows: DataFrame, key: str, at: str, delay: str, order: list[str], step: Step, kind: str) -> DataFrame:
    """As folded_stream(), but keys whose state has run out by the watermark leave the state store.

    `at` is the rows' time, of which `seconds` are the seconds since 1970; rows later than `delay` are dropped. The step
    must say by `expires` when its state runs out. The session's state store must be RocksDB's.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", result {kind}"
    reachable(rows.sparkSession)
    own = rows.where(F.col(key).isNotNull()).withWatermark(at, delay)
    return own.groupBy(key).transformWithStateInPandas(_Fold(order, step, [*rows.columns, "result"]), schema, "Append", "EventTime")


def history(accepted: DataFrame, key: str, at: str) -> DataFrame:
    """Accepted changes numbered by key, with the status before."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(at)
    return accepted.withColumns({"seq": F.row_number().over(w), "before": F.lag("status").over(w)})


def ring(rows: DataFrame, size: int = 100) -> DataFrame:
    """The last rows by seq, as a replay buffer keeps them."""
    return rows.orderBy(F.desc("seq")).limit(size)


def replay(rows: DataFrame, since: int) -> DataFrame:
    return rows.where(F.col("seq") > since)
