"""A time budget for reads: what a step budget is to a single-threaded engine."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from ledgerloom.plans.policy import Code, Rejected

T = TypeVar("T")


def within(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """work()'s result; its Spark jobs are cancelled after ``seconds``, and the call is then rejected with step_limit."""
    group, over = f"budget-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a read with a budget", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise Rejected(Code.STEP_LIMIT, f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.interruptOnCancel", None)
