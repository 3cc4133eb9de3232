"""Ordered folds: what needs Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources.shared import parts_for


def breaker_fold(calls: DataFrame, failures: int = 3, successes: int = 2, timeout_us: int = 3_600_000_000) -> DataFrame:
    """State of each name's circuit breaker after every call of (name, at, call_id, ok).

    CLOSED opens after so many failures since the last success; OPEN ignores
    calls until the timeout, then HALF_OPEN closes after so many successes and
    opens again on a failure.  A key's calls are a sequence, so they are sorted
    and folded as a stream, a batch at a time.
    """
    calls = calls.select("name", "at", "call_id", "ok")
    parts = parts_for(calls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, bad, good, opened = None, "CLOSED", 0, 0, 0
        for b in batches:
            out = []
            for key, at, _, ok in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != name:
                    name, state, bad, good = key, "CLOSED", 0, 0
                if state == "OPEN" and at - opened >= timeout_us:
                    state, good = "HALF_OPEN", 0
                if state == "CLOSED":
                    bad = 0 if ok else bad + 1
                    if bad >= failures:
                        state, opened = "OPEN", at
                elif state == "HALF_OPEN":
                    good = good + 1 if ok else 0
                    if not ok:
                        state, opened = "OPEN", at
                    elif good >= successes:
                        state, bad = "CLOSED", 0
                out.append(state)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.string())], names=["name", "call_id", "state"])

    dealt = calls.repartition(parts, "name").sortWithinPartitions("name", "at", "call_id")
    return dealt.mapInArrow(run, "name long, call_id long, state string")
