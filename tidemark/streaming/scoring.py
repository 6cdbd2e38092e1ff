"""Scoring applications as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import ScoringModel
from ..plans.scoring import score_batch, with_errors

Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(model: ScoringModel, version: int, stage: str, explain: bool = False) -> Scorer:
    """The batch scorer, unchanged: training, batch and stream share their expressions."""
    return lambda df: score_batch(df, model, version=version, stage=stage, explain=explain)


def score_stream(applications: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores of the acceptable rows of a stream. Stateless, so any output mode and order will do."""
    checked = with_errors(applications)
    return scorer(checked.where(F.size("errors") == 0).drop("errors"))


def rejected_stream(applications: DataFrame) -> DataFrame:
    checked = with_errors(applications)
    return checked.where(F.size("errors") > 0)


def _append(rows: DataFrame, out: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Append to a Parquet table; exactly once through the checkpoint and the file log."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start(out)


def start_scoring(applications: DataFrame, scorer: Scorer, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the scores of acceptable applications to a Parquet table."""
    return _append(score_stream(applications, scorer), out, checkpoint, trigger)


def start_rejects(applications: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the applications that are not scored, with their ``errors``, to a Parquet table.

    Beside ``start_scoring`` on the same applications every row ends up in one of the two. It is
    a query of its own, so that each table has its exactly-once log.
    """
    return _append(rejected_stream(applications), out, checkpoint, trigger)
