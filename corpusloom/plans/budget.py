"""Time budgets of steps: jobs of a step that takes too long are cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Seconds of each step.
BUDGETS = {"index": 1800, "search": 600, "pages": 600, "schema": 60, "other": 120}


class StepTimeout(TimeoutError):
    pass


@contextmanager
def time_budget(spark: SparkSession, step: str = "other", seconds: float | None = None):
    """Runs the block under a job tag; its jobs are cancelled and StepTimeout is raised when time is over."""
    limit, tag, late = seconds if seconds is not None else BUDGETS[step], f"step-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    timer = threading.Timer(limit, stop)
    timer.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise StepTimeout(f"{step} took more than {limit} seconds") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def with_retries(action: Callable[[], object], tries: int = 3, pause: float = 0.05):
    """Runs an action up to `tries` times, waiting longer after each failure."""
    import time

    for n in range(tries):
        try:
            return action()
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(pause * (n + 1))
