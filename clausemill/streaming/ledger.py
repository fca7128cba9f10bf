"""The quota ledger as a stream: requests and refunds in order, one state for each day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "request_id long, day string, visitor string, kind string, allowed boolean, reason string, used long, remaining long, visitor_remaining long"
STATE = "used long, visitors map<string, long>"


#: Milliseconds after a day's last request that its counters are kept: a day, and one more for what is late.
KEEP_MS = 2 * 24 * 3600 * 1000


def ledger(limit: int, per_visitor: int, keep_ms: int | None = None):
    """The state function. kind: consume or refund. Within a batch rows go by ts, then request_id.

    A late row of an older day is taken, not dropped; once the day's counters
    are purged, keep_ms after its last request, it starts new ones.
    """
    cap = max(0, limit)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, visitors = (state.get[0], dict(state.get[1])) if state.exists else (0, {})
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        out = []
        for r in rows.itertuples():
            visitor = r.visitor if isinstance(r.visitor, str) and r.visitor else None
            own = visitors.get(visitor, 0) if visitor else 0
            reason = None
            if r.kind == "refund":
                used, own = max(0, used - 1), max(0, own - 1)
            else:
                reason = "daily" if used >= cap else "visitor" if visitor and own >= per_visitor else None
                used, own = used + (reason is None), own + (reason is None)
            if visitor:
                visitors[visitor] = own
            out.append((r.request_id, key[0], visitor, r.kind, reason is None, reason, used, max(0, cap - used), max(0, per_visitor - (own if visitor else 0))))
        state.update((used, visitors))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def stream_ledger(requests: DataFrame, limit: int, per_visitor: int, keep_ms: int | None = None) -> DataFrame:
    """requests: a stream of request_id, ts, day, visitor, kind.

    A stream that runs for ever should purge the counters of past days
    (keep_ms, such as KEEP_MS). Spark then always plans a further batch, so a
    run that is to end by itself (availableNow) must do without.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return requests.groupBy("day").applyInPandasWithState(ledger(limit, per_visitor, keep_ms), OUT, STATE, "append", timeout)
