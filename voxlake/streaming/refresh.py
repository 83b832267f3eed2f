"""The dashboard kept up to date by a stream: only the projects that had news are computed again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import tasks as T
from voxlake.operators.lifecycle import apply_step_updates
from voxlake.plans.spread import spread
from voxlake.streaming.versioned import VersionedTable

#: An activity message: a project's progress, and with ``task_name`` what became of that step.
ACTIVITY = "task_id bigint, ts timestamp, seq bigint, phase string, percent double, message string, task_name string, status string"


def live_progress(tasks: DataFrame, activity: DataFrame) -> DataFrame:
    """Projects with the phase, progress and time of their last message; an empty field leaves what was there."""
    last = activity.groupBy("task_id").agg(F.max_by(F.struct("ts", "phase", "percent"), F.struct("ts", "seq")).alias("__m"))
    merged = spread(tasks, ["task_id"]).join(last, "task_id", "left")
    kinds = dict(tasks.dtypes)
    news = {"updated_at": F.col("__m.ts").cast(kinds["updated_at"]), "phase": F.col("__m.phase"), "progress": F.col("__m.percent")}
    return merged.withColumns({k: F.coalesce(v, k) for k, v in news.items()}).select(*tasks.columns)


def step_news(steps: DataFrame, activity: DataFrame) -> DataFrame:
    """Steps after the messages that name them (see ``apply_step_updates``)."""
    named = activity.where(F.col("task_name").isNotNull()).select("task_id", "task_name", "seq", F.col("ts").alias("at"), "status")
    return apply_step_updates(spread(steps, ["task_id", "task_name"]), named)


def summaries(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    return T.task_summary(T.enrich_tasks(tasks, steps))


@dataclass(frozen=True)
class LiveDashboard:
    """Projects, steps and dashboard rows as versioned tables, each with the last batch that it holds."""

    tasks: VersionedTable
    steps: VersionedTable
    rows: VersionedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64) -> LiveDashboard:
        table = lambda name, *keys: VersionedTable(spark, f"{path.rstrip('/')}/{name}", keys, buckets, ("task_id",))
        return cls(table("tasks", "task_id"), table("steps", "task_id", "task_name"), table("rows", "task_id"))

    def create(self, tasks: DataFrame, steps: DataFrame) -> None:
        """The state before the stream; what is there already stays, so it can be called on every start."""
        self.tasks.create(tasks)
        self.steps.create(steps)
        self.rows.create(summaries(self.tasks.read(), spread(self.steps.read(), ["task_id"])))

    def refresh(self, activity: DataFrame, batch_id: int) -> None:
        """Take in a batch of messages, for ``foreachBatch``: the steps and projects they name change, and the rows of
        just these projects are computed again, from the buckets that hold them. A batch that was stopped between the
        tables is finished when it comes again; one that comes after its end changes nothing."""
        if self.rows.holds(batch_id):
            return
        news = activity.persist()
        try:
            self.steps.upsert(news, batch_id, merge=step_news)
            self.tasks.upsert(news, batch_id, merge=live_progress)
            touched = news.select("task_id").where(F.col("task_id").isNotNull()).distinct()
            own = lambda table: spread(table.read(near=touched), ["task_id"]).join(touched, "task_id", "left_semi")
            self.rows.upsert(summaries(own(self.tasks), own(self.steps)), batch_id)
        finally:
            news.unpersist()

    def page(self, n: int = 50) -> DataFrame:
        """The rows of the n most recent projects."""
        return T.recent_tasks(self.rows.read(), n)


def start_dashboard(stream: DataFrame, board: LiveDashboard, checkpoint: str, every: str = "10 seconds", once: bool = False):
    """Bring the dashboard up to date on a timer, or once with all there is."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(board.refresh)
        .trigger(**trigger)
        .start()
    )
