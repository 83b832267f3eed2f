"""The dashboard: recent projects with their progress, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxlake.operators import tasks as T


def dashboard(tasks: DataFrame, steps: DataFrame, n: int = 50) -> DataFrame:
    """Summaries of the n most recent projects.

    The n projects are picked first, and their steps by a semi join on those few ids, so the
    steps of all other projects are dropped at the scan and never aggregated.
    """
    recent = T.recent_tasks(tasks, n)
    theirs = steps.join(recent.select("task_id"), "task_id", "left_semi")
    return T.task_summary(T.enrich_tasks(recent, theirs))
