"""Metrics of runs side by side, and their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = "coco_map5095"


def flat_metrics(payloads: DataFrame) -> DataFrame:
    """(experiment, metric, value) of (experiment, metrics, inference) JSON texts.

    The object under "metrics" counts, or the whole text if there is none; values that are numbers or booleans stay;
    those of inference are prefixed. Broken or null texts have none.
    """
    kind = "map<string, string>"
    whole = F.from_json("metrics", kind)
    inner = F.coalesce(F.from_json(F.get_json_object("metrics", "$.metrics"), kind), whole)
    rows = lambda m, prefix: payloads.select("experiment", F.explode(m)).select("experiment", F.concat(F.lit(prefix), "key").alias("metric"), number(F.col("value")).alias("value"))
    out = rows(inner, "")
    if "inference" in payloads.columns:
        out = out.unionByName(rows(F.from_json("inference", kind), "inference_"))
    return out.where("value is not null")


def number(text: Column) -> Column:
    """The double that a JSON scalar is: a number or a boolean; null for anything else."""
    return F.when(text == "true", 1.0).when(text == "false", 0.0).when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.cast("double"))


def compared(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """experiment and a column for each metric, best first by coco_map5095 or else by the first metric; missing last.

    names: the metrics' names in order, looked up if not given (a few for each run).
    """
    names = names or [r.metric for r in metrics.select("metric").distinct().orderBy("metric").collect()]
    wide = metrics.groupBy("experiment").pivot("metric", names).agg(F.max("value"))
    by = FIRST if FIRST in names else (names[0] if names else "experiment")
    return wide.orderBy(F.col(by).desc_nulls_last(), "experiment")


def clean_name(name: Column) -> Column:
    """A metric's name for the log: outer blanks off, anything but letters, digits and _./ - as an underscore."""
    return F.regexp_replace(F.trim(name), r"[^a-zA-Z0-9_./ -]", "_")


def loggable(metrics: DataFrame) -> DataFrame:
    """(run_id, step, metric, value): texts that are finite numbers, under their clean names."""
    v = F.expr("try_cast(trim(value) as double)")
    ok = metrics.withColumn("v", v).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    return ok.select("run_id", "step", clean_name(F.col("metric")).alias("metric"), F.col("v").alias("value"))


def history_metrics(history: DataFrame, run_id: str) -> DataFrame:
    """Long form of a training history read from CSV: header blanks off, step from epoch, else the row's number.

    Give a row-number column _row for histories without epochs; without either the step is null.
    """
    h = history.toDF(*[c.strip() for c in history.columns])
    step = F.expr("cast(cast(epoch as double) as bigint)") if "epoch" in h.columns else (F.col("_row").cast("bigint") if "_row" in h.columns else F.lit(None).cast("bigint"))
    values = [c for c in h.columns if c not in ("epoch", "_row")]
    long = h.select(step.alias("step"), *[F.col(f"`{c}`").cast("string").alias(c) for c in values]).unpivot(["step"], values, "metric", "value")
    return loggable(long.withColumn("run_id", F.lit(run_id)))


def markdown(df: DataFrame) -> str:
    """A report's table as Markdown, all of its rows: one for each run compared."""
    rows = df.toLocalIterator()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def bars(metrics: DataFrame) -> DataFrame:
    """(metric, experiment, value) of a bar chart for each metric, the best run first in each; missing values have no bar."""
    return metrics.where("value is not null").select("metric", "experiment", "value").orderBy("metric", F.col("value").desc(), "experiment")


def mean_loss(steps: DataFrame) -> DataFrame:
    """(epoch, loss) of (epoch, loss) rows, one for each step: the mean over an epoch's steps that have a loss."""
    return steps.groupBy("epoch").agg(F.avg("loss").alias("loss"))
