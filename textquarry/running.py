"""Work in background threads: Spark job tags tell its progress and cancel it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Running:
    """The jobs that this process runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.futures, self.stopped, self.seen = spark, {}, set(), {}

    @staticmethod
    def _tag(job_id: int) -> str:
        return f"textquarry-job-{job_id}"

    def start(self, job_id: int, work: Callable[[], object]) -> None:
        """Runs work in a thread; all Spark jobs it starts carry the job's tag."""
        done = self.futures[job_id] = Future()
        context = self.spark.sparkContext

        def run() -> None:
            context.addJobTag(self._tag(job_id))
            try:
                if job_id in self.stopped:
                    raise RuntimeError("cancelled")
                done.set_result(work())
            except BaseException as fault:
                done.set_exception(fault)
            finally:
                context.removeJobTag(self._tag(job_id))

        InheritableThread(target=run, name=self._tag(job_id), daemon=True).start()

    def progress(self, job_id: int) -> int:
        """5 to 99: the share of tasks done in the stages that the job has started. It never falls."""
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForTag(self._tag(job_id)):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else ():
                found = tracker.getStageInfo(stage)
                if found.isDefined():
                    done, total = done + found.get().numCompletedTasks(), total + found.get().numTasks()
        self.seen[job_id] = max(self.seen.get(job_id, 5), min(99, 5 + 94 * done // total) if total else 5)
        return self.seen[job_id]

    def cancel(self, job_id: int) -> None:
        if job_id in self.futures and not self.futures[job_id].done():
            self.stopped.add(job_id)
            self.spark.sparkContext.cancelJobsWithTag(self._tag(job_id))

    def cancelled(self, job_id: int) -> bool:
        return job_id in self.stopped

    def result(self, job_id: int, timeout: float | None = None) -> object:
        """Waits for the job; raises what it raised."""
        return self.futures[job_id].result(timeout)
