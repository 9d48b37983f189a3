"""Scoring and refreshing models on streams of rows, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boostlake.functions.objectives import Frame, objective
from boostlake.model import Model
from boostlake.operators.predict import predict
from boostlake.operators.refresh import refresh
from boostlake.operators.splits import TreeParams


def with_features(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with x, the array of its features."""
    return df.withColumn("x", F.array(*[F.col(f"`{c}`").cast("float") for c in features]))


def score_stream(stream: DataFrame, model: Model, features: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, output: str = "value") -> StreamingQuery:
    """Score a stream and hand each batch to ``sink`` (frame, batch id); the checkpoint makes it resume where it stopped."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(predict(model, with_features(df, features), output).drop("x"), i)).option("checkpointLocation", checkpoint).start()


def refresh_stream(stream: DataFrame, model: Model, features: list[str], label: str, checkpoint: str, params: TreeParams | None = None) -> tuple[StreamingQuery, Callable[[], Model]]:
    """Refresh a model's leaves on each batch of labelled rows; the second result gives the newest model."""
    held = {"model": model}

    def one(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        own = held["model"]
        at = predict(own, with_features(df, features), "margin").withColumnRenamed("prediction", "margin").withColumn("label", F.col(label))
        held["model"] = refresh(own, objective(own.objective, own.params).gradient(at, Frame()), params)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start(), lambda: held["model"]
