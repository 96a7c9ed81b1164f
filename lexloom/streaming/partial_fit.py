"""Incremental MAP estimation from a stream of examples.

Each micro-batch is one step. The state after micro-batch b is the table ``state/batch=b`` in the
given folder, complete once the log of steps names it; the last few states are kept. A replayed micro-batch starts from the last
state before it and takes the same step again, so restarts neither lose nor repeat a step.

The log has one small row per step. Ten logs of a level are merged into one of the next level, so
that after any number of steps a start reads a handful of files, and the history of all steps stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import gradient, optimise
from lexloom.operators.embedding import EmbeddingModel
from lexloom.plans import scale
from lexloom.plans.map_fit import map_step

STATE_SCHEMA = T.StructType(
    [T.StructField("ix", T.LongType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("vec", "m", "v")]
)
# States kept: the last one and those a replay may start from.
KEPT = 3
MERGED = 10  # logs of a level that become one of the next
STEPS_SCHEMA = "batch bigint, step bigint, state string, n bigint, log_lik double"


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """The finished steps: one small row each. A step taken again by a replay counts once."""
    logs = [f"{folder}/steps/{name}" for name in scale.names_in(spark, f"{folder}/steps")]
    if not logs:
        return spark.createDataFrame([], STEPS_SCHEMA)
    return spark.read.schema(STEPS_SCHEMA).json(logs).dropDuplicates(["batch"])


def _log(spark: SparkSession, folder: str, row: tuple) -> None:
    """Add a step to the log; a log is complete when its folder has the name that readers look for."""
    spark.createDataFrame([row], STEPS_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{folder}/steps/level=0-{row[0]}")
    level = 0
    while True:
        full = [n for n in scale.names_in(spark, f"{folder}/steps") if n.startswith(f"level={level}-")]
        if len(full) < MERGED:
            return
        paths = [f"{folder}/steps/{n}" for n in full]
        # Rows may be in both for a moment, and are then read once.
        merged = spark.read.schema(STEPS_SCHEMA).json(paths).dropDuplicates(["batch"])
        level += 1
        merged.coalesce(1).write.mode("overwrite").json(f"{folder}/steps/level={level}-{row[0]}")
        for path in paths:
            scale.delete(spark, path)


def partial_fit_batch(
    model: EmbeddingModel,
    pairs: DataFrame,
    batch: int,
    folder: str,
    size: int,
    kind: str = "sgns",
    adam: optimise.Adam = optimise.Adam(),
    plan: str | None = None,
) -> None:
    """One step on ``pairs(i, j, x)`` or ``pairs(i, ctx, x)`` of row indices."""
    # A micro-batch comes in a session of its own; the step runs in the model's.
    spark = model.theta.sparkSession
    last = steps(spark, folder).where(F.col("batch") < batch).orderBy(F.desc("batch")).first()
    if last is None:
        step, state = 1, optimise.with_moments(model.theta, model.dim)
    else:
        step, state = last["step"] + 1, spark.read.schema(STATE_SCHEMA).parquet(last["state"])
    path = f"{folder}/state/batch={batch}"

    def store(new: DataFrame) -> DataFrame:
        new.write.mode("overwrite").parquet(path)
        return spark.read.schema(STATE_SCHEMA).parquet(path)

    with scale.scope(spark):
        # Stored as they come; as bags they would take several times the space.
        kept = scale.materialise(pairs, "stream-pairs", session=spark)
        rows = kept.count()
        if rows == 0:
            return
        seen = map_step(model, state, gradient.pairs_as_bags(kept, plain=True), kind, rows / size, step, adam, plan, store)[1]
    _log(spark, folder, (batch, step, path, seen["n"], seen["log_lik"]))
    done = sorted(int(n.removeprefix("batch=")) for n in scale.names_in(spark, f"{folder}/state"))
    for old in [b for b in done if b <= batch][:-KEPT]:
        scale.delete(spark, f"{folder}/state/batch={old}")


def partial_fit_stream(
    model: EmbeddingModel,
    stream: DataFrame,
    folder: str,
    size: int,
    kind: str = "sgns",
    adam: optimise.Adam = optimise.Adam(),
    plan: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start fitting on a streaming ``(i, j, x)`` table; ``size`` scales the prior."""
    def step(pairs: DataFrame, batch: int) -> None:
        partial_fit_batch(model, pairs, batch, folder, size, kind, adam, plan)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_model(spark: SparkSession, model: EmbeddingModel, folder: str) -> EmbeddingModel:
    """The model after the last finished micro-batch."""
    last = steps(spark, folder).orderBy(F.desc("batch")).first()
    if last is None:
        return model
    return model.with_theta(spark.read.schema(STATE_SCHEMA).parquet(last["state"]).select("ix", "vec"))
