"""Named steps over a DataFrame.

A step adds ``<name>_output`` and ``<name>_status`` columns; its condition is a SQL predicate
over the columns so far.  All steps together are one narrow projection chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import fields as fields_op
from leafmill.operators import schema
from leafmill.sources import sinks

Handler = Callable[[DataFrame, dict], tuple[DataFrame, Column, Column]]
"""Takes the rows and the step's config; returns rows, output column and error column (NULL = fine)."""


@dataclass
class Step:
    name: str
    handler: str
    config: dict = field(default_factory=dict)
    condition: str | None = None
    on_failure: str = "fail"  # fail, skip or retry


HANDLERS: dict[str, Handler] = {}


def register_step(name: str, handler: Handler) -> None:
    """Add or replace a handler."""
    HANDLERS[name] = handler


def _no_error() -> Column:
    return F.lit(None).cast("string")


def _extract(df: DataFrame, config: dict) -> tuple[DataFrame, Column, Column]:
    """Labelled fields of ``text`` as a map of values."""
    names = config["fields"]
    hits = T.literal_hits(T.fold_labels(F.col("text")), fields_op.label_literals(names))
    rows = df.withColumn("_hits", hits)
    values = fields_op.value_map(fields_op.label_array(F.col("text"), F.col("_hits"), names))
    # later steps, conditions and filters read the values; the text is searched once
    live = F.col("workflow_status") == "running"
    return T.bound(rows, _values=F.when(live, values)), F.col("_values"), _no_error()


def _validate(df: DataFrame, config: dict) -> tuple[DataFrame, Column, Column]:
    """Required fields of an earlier step: ``struct<valid, missing_fields>``."""
    missing = schema.missing_required(F.col(f"{config['source']}_output"), config["required_fields"])
    return df, F.struct((F.size(missing) == 0).alias("valid"), missing.alias("missing_fields")), _no_error()


def _transform(df: DataFrame, config: dict) -> tuple[DataFrame, Column, Column]:
    """Rename the mapped fields of an earlier step; an empty mapping gives nothing."""
    mapping = config.get("mapping") or {"": ""}
    return df, sinks.map_keys(F.col(f"{config['source']}_output"), mapping), _no_error()


def _export(df: DataFrame, config: dict) -> tuple[DataFrame, Column, Column]:
    """Body for the destination; rows without fields fail."""
    body = F.to_json(F.col(f"{config['source']}_output"))
    return df, body, F.when(body.isNull(), F.lit("nothing to export"))


def _outbox(df: DataFrame, config: dict) -> tuple[DataFrame, Column, Column]:
    """Request row for a webhook or a notification channel."""
    data = F.col(f"{config['source']}_output")
    return df, F.to_json(F.struct(F.lit(config.get("event", "workflow.completed")).alias("event"),
                                  F.lit(config.get("target", "")).alias("target"), data.alias("data"))), _no_error()


for _name, _handler in {"field_extract": _extract, "validate_fields": _validate, "transform_data": _transform,
                        "export_data": _export, "send_webhook": _outbox, "send_notification": _outbox}.items():
    register_step(_name, _handler)


def _decided(df: DataFrame, condition: str | None) -> DataFrame:
    """``_wanted``: the condition's truth, true where it cannot be decided.  It is analysed by itself and
    with lenient conversions, so neither an unknown name nor a bad value ends the job."""
    if not condition:
        return df.withColumn("_wanted", F.lit(True))
    conf = df.sparkSession.conf
    strict = conf.get("spark.sql.ansi.enabled")
    try:
        conf.set("spark.sql.ansi.enabled", "false")  # decides how the predicate's casts are built, here and now
        return df.withColumn("_wanted", F.coalesce(F.expr(condition).cast("boolean"), F.lit(True)))
    except (AnalysisException, ParseException):
        return df.withColumn("_wanted", F.lit(True))
    finally:
        conf.set("spark.sql.ansi.enabled", strict)


def run(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Apply steps in order.

    A condition that is false skips the step; one that cannot be decided runs it: a NULL, a value
    that fails to convert, an unknown name, a predicate that does not parse.  A failed step with
    policy ``fail`` ends the row's workflow; with ``skip`` or ``retry`` (which is left to whoever
    runs the rows again) it goes on.  ``workflow_status`` is completed or failed.
    """
    out = df.withColumn("workflow_status", F.lit("running"))
    for step in steps:
        if step.handler not in HANDLERS:
            output, error = F.lit(None).cast("string"), F.lit(f"Unknown handler: {step.handler}")
        else:
            out, output, error = HANDLERS[step.handler](out, step.config)
        out = _decided(out, step.condition)
        live, wanted = F.col("workflow_status") == "running", F.col("_wanted")
        bad = error.isNotNull()
        status = F.when(~live, F.lit(None).cast("string")).when(~wanted, "skipped").when(bad, "failed").otherwise("completed")
        out = out.withColumn(f"{step.name}_status", status)
        done = F.col(f"{step.name}_status")
        out = out.withColumn(f"{step.name}_output", F.when(done == "completed", output)).withColumn(
            f"{step.name}_error", F.when(done == "failed", error))
        after = {"fail": "failed", "retry": "running", "skip": "running"}[step.on_failure]
        out = out.withColumn("workflow_status", F.when(done == "failed", after).otherwise(F.col("workflow_status")))
    return out.withColumn("workflow_status", F.when(
        F.col("workflow_status") == "running", "completed").otherwise(F.col("workflow_status"))).drop("_hits", "_values", "_wanted")


def dead_letters(result: DataFrame) -> DataFrame:
    """Rows whose workflow did not complete."""
    return result.filter(F.col("workflow_status") != "completed")


def step_summary(result: DataFrame, steps: list[Step]) -> DataFrame:
    """Rows per step and status (counted before the shuffle)."""
    pairs = F.array(*[F.struct(F.lit(s.name).alias("step"), F.col(f"{s.name}_status").alias("status")) for s in steps])
    rows = result.select(F.explode(F.filter(pairs, lambda p: p["status"].isNotNull())).alias("p"))
    return rows.groupBy("p.step", "p.status").agg(F.count("*").alias("n"))


# fixed values: step lists of the two ready-made workflows
INVOICE_STEPS = [
    Step("extract", "field_extract", {"fields": ["Invoice Number", "Invoice Date", "Total Amount", "Vendor Name"]}),
    Step("validate", "validate_fields", {"source": "extract", "required_fields": ["Invoice Number", "Total Amount"]}),
    Step("export", "export_data", {"source": "extract"}, condition="validate_output.valid"),
]
RECEIPT_STEPS = [
    Step("extract", "field_extract", {"fields": ["Store Name", "Date", "Total Amount", "Items"]}),
    Step("webhook", "send_webhook", {"source": "extract", "target": "receipts"}),
]
