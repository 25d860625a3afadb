"""The single-server queue over a stream of jobs.

One server a key serves first come, first served; a job that has waited the
age limit when the server is free is abstained from.  In first-come order the
state of a server is one number, the time at which it is free, so a job's
outcome is known when it arrives; jobs are taken in the order of arrival
inside each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "server string, job_id string, arrival_us bigint, start_us bigint, completion_us bigint, wait_us bigint, timed_out boolean"


def serve(free_us: int, jobs: list[tuple[str, int, int]], cap: int) -> tuple[int, list[tuple]]:
    """(time at which the server is free, outcomes) of jobs (id, arrival, service) in order of arrival."""
    out = []
    for job, arrival, service in jobs:
        start = max(free_us, arrival)
        if start - arrival >= cap:
            out.append((job, arrival, arrival + cap, arrival + cap, cap, True))
        else:
            free_us = start + service
            out.append((job, arrival, start, free_us, start - arrival, False))
    return free_us, out


def queue_outcomes(jobs: DataFrame, max_wait_us: int, idle_ms: int | None = None) -> DataFrame:
    """Outcomes of ``jobs``: ``server, job_id, arrival_us, service_us``, a stream.

    A job that arrives in a later batch than its successors is served after
    them.  Jobs without an arrival or service are left out.  The state of a
    server that has had no job for ``idle_ms`` is dropped; without it the one
    number a server is kept, and a trigger over what is available ends by itself.
    """

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows: list[tuple[str, int, int]] = []
        for pdf in batches:
            good = pdf.dropna(subset=["arrival_us", "service_us"])
            rows += [(j, int(a), int(s)) for j, a, s in zip(good["job_id"], good["arrival_us"], good["service_us"])]
        free, out = serve(state.get[0] if state.exists else 0, sorted(rows, key=lambda r: (r[1], r[0] or "")), max_wait_us)
        state.update((free,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[c.split()[0] for c in OUT.split(", ")])

    picked = jobs.select("server", "job_id", "arrival_us", "service_us")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return picked.groupBy("server").applyInPandasWithState(run, OUT, "free_us bigint", "append", timeout)
