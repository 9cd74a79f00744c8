"""Progress of streaming queries as one percentage that never falls."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.accounts import STAGES, UNMEASURED

BANDS = {stage: band for stage, band in STAGES.items() if stage != "done"}


@dataclass
class Work:
    """One piece of work: its stages run as streaming queries of their own, one after the other or overlapping."""

    stage: str = "queued"
    percent: int = 2
    rows: dict[str, int] = field(default_factory=dict)
    error: str | None = None


class StageProgress(StreamingQueryListener):
    """Keeps the progress of works whose stages are streaming queries.

    A query takes part by its name ``<work>/<stage>``; others are ignored.  ``expected`` maps such
    names to the rows that the query will read; without it the stage shows ``UNMEASURED`` of its
    band.  Late reports of an earlier stage neither lower the percentage nor change the stage, and
    a micro-batch that runs again is counted once.  A query that ends with an error makes its work
    ``failed`` at the percentage it had; the end of ``indexing`` makes it ``done``, at 100.  A
    new query of a failed or finished work starts the work anew.  What is kept is a few numbers a
    work; :meth:`forget` drops them.
    """

    def __init__(self, expected: dict[str, int] | None = None) -> None:
        self.expected = dict(expected or {})
        self.works: dict[str, Work] = {}
        self.names: dict[str, str] = {}
        self.batches: dict[str, int] = {}
        self.lock = threading.Lock()

    def started(self, run: str, name: str | None) -> None:
        work, _, stage = (name or "").rpartition("/")
        if not work or stage not in BANDS:
            return
        with self.lock:
            self.names[run] = name
            held = self.works.get(work)
            if held is None or held.stage in ("done", "failed"):
                self.works[work] = Work()
            self._move(work, stage, None)

    def advanced(self, run: str, batch: int, rows: int) -> None:
        with self.lock:
            name = self.names.get(run)
            if name is None or batch <= self.batches.get(run, -1):
                return
            self.batches[run] = batch
            work, _, stage = name.rpartition("/")
            if work in self.works:
                done = self.works[work].rows
                done[stage] = done.get(stage, 0) + rows
                total = self.expected.get(name)
                self._move(work, stage, done[stage] / total if total else None)

    def ended(self, run: str, error: str | None) -> None:
        with self.lock:
            name = self.names.pop(run, None)
            self.batches.pop(run, None)
            work, _, stage = (name or "").rpartition("/")
            if work not in self.works:
                return
            held = self.works[work]
            if error is not None:
                held.stage, held.error = "failed", error
            elif stage == "indexing" and held.stage != "failed":
                held.stage, held.percent = "done", 100
            else:
                self._move(work, stage, 1.0)

    def _move(self, work: str, stage: str, share: float | None) -> None:
        held, order = self.works[work], list(BANDS)
        if held.stage not in BANDS or order.index(stage) < order.index(held.stage):
            return
        low, high = BANDS[stage]
        held.stage = stage
        held.percent = max(held.percent, round(low + (high - low) * (UNMEASURED if share is None else min(share, 1.0))))

    def shown(self, work: str) -> tuple[str, int] | None:
        """Stage and percentage of a work, or nothing if it is not known."""
        with self.lock:
            held = self.works.get(work)
            return held and (held.stage, held.percent)

    def forget(self, work: str) -> None:
        with self.lock:
            self.works.pop(work, None)

    def onQueryStarted(self, event) -> None:
        self.started(str(event.runId), event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.advanced(str(p.runId), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended(str(event.runId), event.exception)
