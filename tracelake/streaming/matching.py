"""A then B within a bound, on a stream: state per key is the A events that still wait for their B."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.errors import EngineError

OUTPUT = "key string, a long, b long, gap_ms long"
STATE = "seqs array<long>, times array<long>"


def then_within(events: DataFrame, key: str, a: Column, b: Column, within_ms: int) -> DataFrame:
    """events (seq, ts_ms, key). Every A matches the first B after it, if that is at most within_ms later.
    Events take part in the order of seq, that is of appending: a late event is never dropped. Waiting
    events that the bound has passed are forgotten, so state is bounded by the events of one bound."""
    if within_ms <= 0:
        raise EngineError("unsupported_capability", "a streaming match needs a bound")
    rows = events.select(F.col(key).cast("string").alias("key"), "seq", "ts_ms", a.alias("is_a"), b.alias("is_b")).where("is_a or is_b")

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, times = state.get if state.exists else ([], [])
        new = pd.concat(list(frames))
        parts = [pd.DataFrame({"seq": seqs, "ts": times, "b": False}, dtype="int64")]
        parts += [pd.DataFrame({"seq": x["seq"], "ts": x["ts_ms"], "b": b}) for x, b in ((new[new["is_b"]], True), (new[new["is_a"]], False))]
        rows = pd.concat(parts).sort_values(["seq", "b"], ascending=[True, False], ignore_index=True)
        is_b = rows["b"].to_numpy(bool)
        closes = np.cumsum(is_b) - is_b  # rows up to and with one B
        ts, seq = rows["ts"].to_numpy("int64"), rows["seq"].to_numpy("int64")
        # The latest time of the As behind a row and before its B: once past the bound, the row waits no more.
        least = np.iinfo("int64").min
        back = pd.Series(np.where(is_b, least, ts)[::-1]).groupby(closes[::-1])
        later = back.cummax().groupby(closes[::-1]).shift(1, fill_value=least).to_numpy()[::-1]
        waits = ~is_b & (later <= ts + within_ms)
        at_b = np.flatnonzero(is_b)
        matched = np.flatnonzero(waits & (closes < len(at_b)))
        to = at_b[closes[matched]]
        near = ts[to] - ts[matched] <= within_ms
        matched, to = matched[near], to[near]
        left = waits & (closes == len(at_b))
        state.update((seq[left].tolist(), ts[left].tolist()))
        yield pd.DataFrame({"key": name[0], "a": seq[matched], "b": seq[to], "gap_ms": ts[to] - ts[matched]})

    return rows.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
