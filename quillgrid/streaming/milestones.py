"""Milestones on a stream: one row per (session, milestone), with the time of the event that earned it as seen so far."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid import constants as K

SCHEMA = "session {session}, milestone string, earned_at timestamp"
#: Events that a milestone takes; others are earned by the first one.
NEEDED = {K.POWER_USER: K.POWER_USER_DOCUMENTS}


def milestone_events(
    events: DataFrame, session: str, action: str, ts: str, actions: dict[str, str] | None = None, power_action: str | None = None
) -> DataFrame:
    """``session, milestone, earned_at`` of every event that counts for a milestone. Events of ``power_action``, if given, count for the
    milestone of several documents too."""
    named = actions or K.MILESTONES
    mapping = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    kinds = [F.try_element_at(mapping, F.col(action))]
    if power_action is not None:
        kinds.append(F.when(F.col(action) == power_action, F.lit(K.POWER_USER)))
    rows = events.select(F.col(session).alias("session"), F.explode(F.array_compact(F.array(*kinds))).alias("milestone"), F.col(ts).cast("timestamp").alias("earned_at"))
    return rows.select("session", "milestone", "earned_at")


def _needed(counts: Mapping[str, int]) -> Column:
    if not counts:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("milestone")), F.lit(1))


def _earliest(rows: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """Each milestone's earliest events, numbered, as many as it takes. The constant limit is applied before the shuffle."""
    order = Window.partitionBy("session", "milestone").orderBy("earned_at")
    numbered = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(counts.values(), default=1))
    return numbered.where(F.col("_n") <= _needed(counts))


def earned(spark: SparkSession, out: str, session_type: str = "bigint", before: int | None = None, counts: Mapping[str, int] = NEEDED) -> DataFrame:
    """The earned milestones, each with the time of the event that completed it; ``before`` leaves out batches from this number on."""
    rows = spark.read.schema(SCHEMA.format(session=session_type) + ", batch bigint").option("basePath", out).parquet(out)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return _earliest(rows.drop("batch"), counts).where(F.col("_n") == _needed(counts)).drop("_n")


def run(stream: DataFrame, out: str, checkpoint: str, counts: Mapping[str, int] = NEEDED) -> StreamingQuery:
    """Add to ``out`` what each batch changes: events of milestones not yet earned, or earlier than the event that earned them.

    A batch keeps at most as many events of a milestone as it takes, and writes its own folder anew, so a repeated one changes nothing. No
    state is kept by time, so late and repeated events, however far apart, neither earn twice nor are lost.
    """
    kind = stream.schema["session"].dataType.simpleString()

    def write(batch_df: DataFrame, batch: int) -> None:
        new = _earliest(batch_df, counts).drop("_n")
        if batch:
            known = earned(batch_df.sparkSession, out, kind, batch, counts).withColumnRenamed("earned_at", "_known")
            new = new.join(known, ["session", "milestone"], "left").where("_known IS NULL OR earned_at < _known").drop("_known")
        new.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
