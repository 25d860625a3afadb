"""Single-server queues with an age limit under several disciplines.

First come, first served without an age limit is closed form (scans.py).  With
the limit, and for the other disciplines, jobs are served in a stream sorted
by arrival that holds only those that wait.  Disciplines whose state ends with
a busy period run one group of periods at a time, in parallel; deficit round
robin keeps pointer and deficits over idle time, so a trace is one stream.  A
job that has waited ``max_wait_us`` when the server is free is abstained from
and never delays the others.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.operators.scans import lindley

#: Fields of a job, in the order of the tuples that disciplines see.
FIELDS = ("arrival_us", "sequence", "service_us", "tenant_id", "risk_score", "hard_required", "vfinish_us", "cost_us")
OUTCOME = ("start_us bigint", "completion_us bigint", "wait_us bigint", "timed_out boolean")
_LAST = float("inf")


class Server:
    """A non-preemptive server; jobs are fed in the order (arrival, sequence).

    A decision is made at a time when all jobs that arrived until then are
    known, so nothing but the waiting jobs is held.
    """

    def __init__(self, cap: int) -> None:
        self.cap, self.clock, self.n = cap, 0, 0
        self.queue: deque[int] = deque()  # by arrival, also jobs that are gone
        self.waiting: dict[int, tuple] = {}

    def add(self, k: int, job: tuple) -> None:
        raise NotImplementedError

    def pick(self) -> int:
        raise NotImplementedError

    def gone(self, k: int, job: tuple) -> None:
        """A waiting job has timed out."""

    def feed(self, job: tuple) -> list[tuple]:
        """Outcomes (job, start, completion, wait, timed out) that are certain before ``job`` arrives."""
        out = self.advance(job[0])
        if not self.waiting:
            self.clock = max(self.clock, job[0])
        k, self.n = self.n, self.n + 1
        self.waiting[k] = job
        self.queue.append(k)
        self.add(k, job)
        return out

    def advance(self, until: float = _LAST) -> list[tuple]:
        out = []
        while self.waiting and self.clock < until:
            while self.queue:
                k = self.queue[0]
                job = self.waiting.get(k)
                if job is not None and self.clock - job[0] < self.cap:
                    break
                self.queue.popleft()
                if job is not None:
                    del self.waiting[k]
                    self.gone(k, job)
                    out.append((job, job[0] + self.cap, job[0] + self.cap, self.cap, True))
            if not self.waiting:
                break
            job = self.waiting.pop(self.pick())
            out.append((job, self.clock, self.clock + job[2], self.clock - job[0], False))
            self.clock += job[2]
        return out


class Ordered(Server):
    """The waiting job with the least key is next."""

    def __init__(self, cap: int, key: Callable[[tuple], tuple]) -> None:
        super().__init__(cap)
        self.key, self.heap = key, []

    def add(self, k: int, job: tuple) -> None:
        heapq.heappush(self.heap, (self.key(job), k))

    def pick(self) -> int:
        while self.heap[0][1] not in self.waiting:
            heapq.heappop(self.heap)
        return heapq.heappop(self.heap)[1]


class DeficitRoundRobin(Server):
    """A visit adds the quantum to a tenant with waiting jobs and serves its first job if the deficit covers its cost.

    The deficit of a tenant without waiting jobs is kept.  Which tenant is
    served follows from the number of rounds each would need, so a pick costs
    one look at each tenant; ``most_visits`` a tenant is the limit beyond which it fails.
    """

    def __init__(self, cap: int, tenants: int, quantum_us: int, most_visits: int = 200) -> None:
        super().__init__(cap)
        if quantum_us <= 0:
            raise ValueError("the quantum must be positive")
        self.queues = [deque() for _ in range(tenants)]
        self.deficit, self.at, self.quantum, self.most = [0] * tenants, 0, quantum_us, most_visits

    def add(self, k: int, job: tuple) -> None:
        self.queues[job[3]].append(k)

    def gone(self, k: int, job: tuple) -> None:
        self.queues[job[3]].remove(k)

    def pick(self) -> int:
        n = len(self.queues)
        plans = []
        for t, q in enumerate(self.queues):
            if q:
                lacks = self.waiting[q[0]][7] - self.deficit[t]
                plans.append((max(1, -(-lacks // self.quantum)), (t - self.at) % n, t))
        rounds, place, t = min(plans)
        if rounds > self.most:
            raise RuntimeError("no tenant could be served: the quantum is too small for the costs")
        for _, p, u in plans:
            self.deficit[u] += self.quantum * (rounds if p <= place else rounds - 1)
        k = self.queues[t].popleft()
        self.deficit[t] -= self.waiting[k][7]
        self.at = (t + 1) % n
        return k


#: Disciplines whose choice depends on the waiting jobs only.
PICKS: dict[str, Callable[[tuple], tuple]] = {
    "fifo": lambda j: (j[0], j[1]),
    "risk_priority": lambda j: (-j[4], j[0], j[1]),
    "tenant_vfinish": lambda j: (not j[5], j[6], -j[4], j[0], j[1]),
}
DRR = "drr"


def register_discipline(name: str, pick: Callable[[tuple], tuple]) -> None:
    """Add a discipline: the waiting job with the least ``pick`` of its FIELDS is next."""
    PICKS[name] = pick


def server_of(discipline: str, cap: int, tenants: int, quantum_us: int, picks: dict[str, Callable[[tuple], tuple]] | None = None) -> Server:
    """A server for a discipline of ``picks`` (PICKS); an unknown one raises."""
    picks = PICKS if picks is None else picks
    if discipline == DRR:
        return DeficitRoundRobin(cap, tenants, quantum_us)
    if discipline not in picks:
        raise ValueError(f"unknown discipline: {discipline}")
    return Ordered(cap, picks[discipline])


def simulate(jobs: DataFrame, keys: list[str], disciplines: dict[str, str], max_wait_us: int, tenants: int = 8, quantum_us: int = 1_000_000, method: str = "method") -> DataFrame:
    """``jobs`` with ``start_us, completion_us, wait_us`` and ``timed_out`` of every job, in place of such columns.

    ``jobs`` needs keys (the method among them), FIELDS and ``group_id``
    (scans.idle_groups); ``disciplines`` gives the discipline of each method.
    Jobs without a risk have the highest; a null tenant, service or arrival
    fails.  Unknown disciplines raise at once.
    """
    for d in disciplines.values():
        server_of(d, max_wait_us, tenants, quantum_us)
    jobs = jobs.drop(*[c.split()[0] for c in OUTCOME])
    picks = dict(PICKS)  # registered ones go along to the workers
    columns = jobs.columns
    where = {c: columns.index(c) for c in (*FIELDS, *keys, "group_id", method)}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in jobs.dtypes), *OUTCOME])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Any, ...] | None = None
        server: Server | None = None
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c].tolist() for c in columns]):
                mine = (*[row[where[k]] for k in keys], row[where["group_id"]])
                if mine != held:
                    if server is not None:
                        out += server.advance()
                    held, server = mine, server_of(disciplines[row[where[method]]], max_wait_us, tenants, quantum_us, picks)
                risk = row[where["risk_score"]]
                out += server.feed((*[row[where[f]] for f in FIELDS[:4]], 1.0 if risk is None or risk != risk else risk, *[row[where[f]] for f in FIELDS[5:]], row))
            yield _rows(out, columns)
        if server is not None:
            yield _rows(server.advance(), columns)

    whole = [m for m, d in disciplines.items() if d == DRR]
    grouped = jobs.withColumn("group_id", F.when(F.col(method).isin(whole), F.lit(-1)).otherwise(F.col("group_id"))) if whole else jobs
    ordered = grouped.repartition(*keys, "group_id").sortWithinPartitions(*keys, "group_id", "arrival_us", "sequence")
    return ordered.select(*columns).mapInPandas(run, schema)


def _rows(outcomes: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*job[-1], *rest) for job, *rest in outcomes], columns=[*columns, *[c.split()[0] for c in OUTCOME]])


def virtual_finish(jobs: DataFrame, keys: list[str], tenant: str = "tenant_id", arrival: str = "arrival_us", cost: str = "cost_us", order: str = "event_id", block_us: int = 60_000_000) -> DataFrame:
    """Adds ``vfinish_us``: max(previous finish of the tenant, arrival) + cost, in arrival order; a heavy tenant is scanned in blocks."""
    return lindley(jobs, [*keys, tenant], arrival, cost, order, block_us, "vfinish_us")
