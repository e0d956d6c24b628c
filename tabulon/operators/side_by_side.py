"""Several Spark computations at once, each under a time limit."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


def side_by_side(
    spark: SparkSession,
    tasks: Mapping[str, Callable[[], Any]],
    limit: float | Mapping[str, float],
    parallel: int = 4,
) -> dict[str, Any]:
    """What each task returns, or the exception it ended with; at most `parallel` run at a time.

    Every task runs in a thread of its own, and its Spark jobs carry its own tag. A task that takes longer than
    `limit` seconds (one number, or one per name) ends as a `TimeoutError`: its jobs are cancelled, and
    whatever its thread still brings is not used. A thread that neither runs a job nor returns cannot be
    stopped from outside; it does not keep others, or the end of the program, waiting.
    """
    context, run = spark.sparkContext, uuid.uuid4().hex
    waiting, running, done, stopped = list(tasks), {}, {}, []
    changed = threading.Condition()

    def start(name: str) -> None:
        seconds = limit[name] if isinstance(limit, Mapping) else limit
        tag = f"{run}-{len(tasks) - len(waiting)}"

        def work() -> None:
            context.addJobTag(tag)
            context.setInterruptOnCancel(True)
            try:
                result = tasks[name]()
            except Exception as failure:
                result = failure
            with changed:
                done.setdefault(name, result)
                changed.notify()

        running[name] = (time.monotonic() + seconds, seconds, tag)
        InheritableThread(target=work, daemon=True).start()

    with changed:
        while len(done) < len(tasks):
            now = time.monotonic()
            for name, (deadline, seconds, tag) in list(running.items()):
                if name not in done and now >= deadline:
                    done[name] = TimeoutError(f"time limit of {seconds:g} s")
                    stopped.append(tag)
                if name in done:
                    del running[name]
            for tag in stopped:  # again and again: between two jobs there is nothing to cancel
                context.cancelJobsWithTag(tag)
            while waiting and len(running) < parallel:
                start(waiting.pop(0))
            if len(done) < len(tasks):
                next_end = min(deadline for deadline, _, _ in running.values()) - time.monotonic()
                changed.wait(max(0.05, min(next_end, 1.0)))
    for tag in stopped:
        context.cancelJobsWithTag(tag)
    return {name: done[name] for name in tasks}
