"""The completion monitor as a stateful stream: one state per extraction, timers in processing time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SETTLE_S, STALE_S = 5 * 60, 4 * 3600
ENDED = ("COMPLETE", "CANCELLED", "STALE")
OUT = "extraction_id long, status string, changed_at double, checks long"


def decide(status: str, cost: float, budget: float, same: bool, complete: bool, quiet_s: float, queued: int = 0) -> str:
    """What one look at an extraction makes of its status."""
    if status in ("COMPLETE", "CANCELLED"):
        return status
    if cost > budget:
        return "CANCELLED"
    if same and complete and quiet_s >= SETTLE_S and not queued:
        return "COMPLETE"
    if same and not complete and quiet_s >= STALE_S:
        return "STALE"
    return status


def decided(status: Column, cost: Column, budget: Column, same: Column, complete: Column, quiet_s: Column, queued: Column) -> Column:
    """``decide`` as a column."""
    settled = same & complete & (quiet_s >= SETTLE_S) & (queued == 0)
    stale = same & ~complete & (quiet_s >= STALE_S)
    return F.when(status.isin("COMPLETE", "CANCELLED"), status).when(cost > budget, "CANCELLED").when(settled, "COMPLETE").when(stale, "STALE").otherwise(status)


def monitor(snapshots: DataFrame, budget: float = 50.0) -> DataFrame:
    """snapshots: extraction_id, at (seconds), done, total, cost. Emits an extraction's status after each batch with looks
    at it, and when it has been quiet for long enough to settle or go stale; then its state is dropped. Of a batch's
    looks only the last of each number of done pages count, so they are brought together before the state is read."""
    looks = snapshots.select("extraction_id", "at", "done", "total", "cost")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, done, since, checks, total, cost, at = state.get if state.exists else ("IN_PROGRESS", -1, 0.0, 0, 0, 0.0, 0.0)
        if state.hasTimedOut:
            # Quiet since the last look: the clock has gone on by what the timer waited for.
            at = max(at, since + (SETTLE_S if done == total else STALE_S))
            status = decide(status, cost, budget, True, done == total, at - since)
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "done"])
            for now_at, now_done, total, cost in zip(rows["at"], rows["done"], rows["total"], rows["cost"], strict=True):  # noqa: B007
                same = now_done == done
                if not same:
                    done, since = int(now_done), float(now_at)
                at, checks = float(now_at), checks + 1
                status = decide(status, float(cost), budget, bool(same), bool(now_done == total), at - since)
        if status in ENDED:
            if state.exists:
                state.remove()
        else:
            state.update((status, done, since, checks, int(total), float(cost), at))
            wait = (SETTLE_S if done == total else STALE_S) - (at - since)
            state.setTimeoutDuration(max(1, int(wait * 1000)))
        yield pd.DataFrame({"extraction_id": [key[0]], "status": [status], "changed_at": [since], "checks": [checks]})

    held = "status string, done long, since double, checks long, total long, cost double, at double"
    return looks.groupBy("extraction_id").applyInPandasWithState(step, OUT, held, "update", GroupStateTimeout.ProcessingTimeTimeout)
