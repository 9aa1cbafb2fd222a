"""Background jobs: one at a time, in the order in which they came, with their progress in a log and an estimate of the time left.

Queue: a caller puts a ticket (named by time) into a shared folder and waits until it is the oldest and may take the lease. Leases are numbered files, created
only where there is none of that name, which file systems do atomically: of several takers of a number one wins, and a holder whose number isn't the largest any more
has lost it. The holder touches its lease as a heartbeat; a lease without one for EXPIRES seconds is taken over with the next number. A waiting caller touches its
ticket as well, so callers that died don't block those behind them.

Chunks: chunked() runs a job as a stream of chunks over files and logs its progress from the query's own reports; by_ranges (plans.resume) does without a stream.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from loomspark.plans.resume import Manifest
from loomspark.sinks.writers import job, update_job

#: Seconds without a heartbeat after which a lease or ticket counts no more, and between two looks.
EXPIRES, POLL = 60.0, 0.5
#: Seconds that a comment is taken to last before anything was measured (a fixed value).
FIRST_RATE = 0.30


class Lost(RuntimeError):
    """The lease was taken over."""


def time_left(seconds: float) -> str:
    # a fixed text
    return f"~{seconds / 60:.1f} minutos" if seconds > 60 else f"~{seconds:.0f} segundos"


class Queue:
    """A queue in a folder that all callers share, on a file system that creates files atomically and keeps times that are set."""

    def __init__(self, spark: SparkSession, folder: str, expires: float = EXPIRES, poll: float = POLL):
        self.spark, self.expires, self.poll = spark, expires, poll
        self.files = Manifest(spark, folder)

    def _waiting(self, times: dict[str, float]) -> list[str]:
        return sorted(n for n, at in times.items() if n.startswith("ticket-") and time.time() - at < self.expires)

    def waiting(self) -> list[str]:
        """Tickets of callers that live, the oldest first."""
        return self._waiting(self.files.times())

    @staticmethod
    def _last(times: dict[str, float]) -> int:
        return max((int(n.removeprefix("lease-")) for n in times if n.startswith("lease-")), default=-1)

    def enter(self) -> str:
        ticket = f"ticket-{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.files.create(ticket)
        return ticket

    def take(self, ticket: str, timeout: float | None = None) -> int:
        """Waits for one's turn; gives the lease's number."""
        until = time.time() + timeout if timeout is not None else None
        while True:
            self.files.touch(ticket)
            times = self.files.times()
            last = self._last(times)
            free = last < 0 or f"free-{last}" in times or time.time() - times[f"lease-{last}"] >= self.expires
            won = free and self._waiting(times)[:1] == [ticket] and self.files.create(f"lease-{last + 1}")
            late = until is not None and time.time() > until
            if won or late:
                self.files.remove(f"{self.files.folder}/{ticket}")
            if won:
                return last + 1
            if late:
                raise TimeoutError(f"{ticket} did not get its turn")
            time.sleep(self.poll)

    def renew(self, lease: int) -> None:
        if self._last(self.files.times()) != lease:
            raise Lost(f"lease {lease} was taken over")
        self.files.touch(f"lease-{lease}")

    def leave(self, lease: int) -> None:
        """Frees the lease if it is still held. The file with the largest number stays, so numbers never come again."""
        self.files.create(f"free-{lease}")
        times = self.files.times()
        last = self._last(times)
        for name in times:
            kind, _, number = name.partition("-")
            if kind in ("lease", "free") and int(number) < last:
                self.files.remove(f"{self.files.folder}/{name}")

    def run(self, job_id: str, work: Callable[[], object], log: str, timeout: float | None = None) -> object:
        """work() when its turn comes; its Spark jobs carry the job's id as a tag, so cancel() stops them. The log gets pending, processing and
        completed, failed (with the error) or cancelled. If the lease is lost, what runs is stopped."""
        update_job(self.spark, log, job_id, status="pending")
        lease = self.take(self.enter(), timeout)
        stop, lost = threading.Event(), threading.Event()

        def beat() -> None:
            while not stop.wait(self.expires / 4):
                try:
                    self.renew(lease)
                except Lost:
                    lost.set()
                    self.spark.sparkContext.cancelJobsWithTag(job_id)
                    return

        heart = threading.Thread(target=beat, daemon=True)
        heart.start()
        update_job(self.spark, log, job_id, status="processing")
        context = self.spark.sparkContext
        context.addJobTag(job_id)
        context.setInterruptOnCancel(True)
        try:
            out = work()
            if lost.is_set():
                raise Lost(f"lease {lease} was taken over")
            update_job(self.spark, log, job_id, status="completed")
            return out
        except Exception as e:
            state = job(self.spark, log, job_id).first()["fields"].get("status")
            update_job(self.spark, log, job_id, **({} if state == "cancelled" else {"status": "failed"}), error_message=str(e)[:2000])
            raise
        finally:
            context.removeJobTag(job_id)
            context.setInterruptOnCancel(False)
            stop.set()
            heart.join()
            self.leave(lease)

    def cancel(self, job_id: str, log: str) -> None:
        update_job(self.spark, log, job_id, status="cancelled")
        self.spark.sparkContext.cancelJobsWithTag(job_id)


def progress(spark: SparkSession, log: str, job_id: str, active: str | None = None) -> dict[str, str | None]:
    """The state of a job with its progress in words; while it waits, the time until the active job is done, while it runs, the time that is left."""
    found = job(spark, log, job_id).first()
    if found is None:
        raise KeyError(job_id)
    out = dict(found["fields"])
    other = job(spark, log, active).first() if active and active != job_id else None
    of = dict(other["fields"]) if other and out.get("status") == "pending" else out if out.get("status") == "processing" else {}
    left = int(of.get("total") or 0) - int(of.get("processed") or 0)
    if left > 0:
        seconds = left * float(of.get("seconds_each") or FIRST_RATE)
        if out["status"] == "pending":
            out["progress"] = f"En cola de espera... (Tiempo estimado para iniciar: {time_left(seconds)})"  # a fixed text
        else:
            out["estimated_remaining_seconds"], out["estimated_remaining_time_formatted"] = f"{seconds:.2f}", time_left(seconds)
    return out


def report(spark: SparkSession, log: str, job_id: str, processed: int, total: int, began: float) -> None:
    """Progress and the measured seconds a row."""
    percent = 100 * processed // total if total else 100
    each = (time.time() - began) / processed if processed else FIRST_RATE
    words = f"{processed} de {total} comentarios procesados ({percent}%)"  # a fixed text
    update_job(spark, log, job_id, progress=words, processed=processed, total=total, seconds_each=f"{each:.6f}")


class _Reports(StreamingQueryListener):
    """A query's rows so far, from its progress reports; a report that comes twice (a batch run again) counts once."""

    def __init__(self, tell: Callable[[int], None]):
        self.tell, self.rows, self.id, self.error, self.over = tell, {}, None, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.id and event.progress.numInputRows:
            self.rows[event.progress.batchId] = event.progress.numInputRows
            self.tell(sum(self.rows.values()))

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.id:
            self.error = event.exception
            self.over.set()


def chunked(spark: SparkSession, source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, log: str, job_id: str, total: int) -> int:
    """Runs write(chunk, number) over a stream of chunks (its own maxFilesPerTrigger or maxRecordsPerTrigger says how large) until all that is there is done, and
    logs progress after each chunk. total: rows to come. Gives the rows of this run; a run that was stopped goes on behind its last whole chunk."""
    began, waiting, told = time.time(), threading.Condition(), [0]

    def tell(rows: int) -> None:
        with waiting:
            told[0] = rows
            waiting.notify()

    reports = _Reports(tell)
    update_job(spark, log, job_id, total=total)
    before = int((job(spark, log, job_id).first() or {"fields": {}})["fields"].get("processed") or 0)
    spark.streams.addListener(reports)
    try:
        query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        running = query.start()
        reports.id = str(running.id)
        seen = 0
        while running.isActive or told[0] != seen:
            with waiting:
                waiting.wait(0.2)
                rows = told[0]
            if rows != seen:  # the log is written here, so that the listener's thread never waits for a Spark job
                report(spark, log, job_id, before + rows, total, began)
                seen = rows
        reports.over.wait(30)
        if told[0] != seen:
            report(spark, log, job_id, before + told[0], total, began)
        if running.exception():
            raise RuntimeError(str(running.exception()))
        return told[0]
    finally:
        spark.streams.removeListener(reports)
