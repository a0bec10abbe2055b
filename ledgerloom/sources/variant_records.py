"""JSON record arrays without a fixed schema: every record comes out, good or with a reason.

The strict reader (``json_records``) ends the job at the first bad body. Here bodies are
parsed to ``VARIANT``, fields are taken by path and type, and what cannot be read stays as
text beside the reason.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

POSITION, RAW, REASON = "position", "raw", "reason"


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def parse_variant_records(
    bodies: DataFrame, fields: Mapping[str, tuple[str, str]], required: Iterable[str] = (), body: str = "body"
) -> DataFrame:
    """One row per record: the other columns, ``position``, one typed column per field, ``raw``, ``reason``.

    ``fields`` maps a column name to its path and type, as in ``{"k": ("$.props.k", "long")}``.
    ``reason`` is null for a good record. A body that is null, not JSON or not an array gives
    one row without a position; ``raw`` is then the body, else the record's own JSON. A field
    that is absent or null is null, and a reason only if ``required``; one that does not fit
    its type always is. The first field at fault is named. An empty array gives no row.
    """
    required = set(required)
    if unknown := required - set(fields):
        raise ValueError(f"required but no field: {', '.join(sorted(unknown))}")
    others = [c for c in bodies.columns if c != body]
    if taken := {*fields, POSITION, RAW, REASON}.intersection(others):
        raise ValueError(f"columns {', '.join(sorted(taken))} would be there twice")
    text = F.col(f"`{body}`")
    parsed = F.try_parse_json(text)
    items = parsed.try_cast("array<variant>")
    at_fault = (
        F.when(text.isNull(), "null body").when(parsed.isNull(), "not JSON").when(items.isNull(), "not an array")
    )
    kept = [F.col(f"`{c}`") for c in others]
    opened = bodies.select(*kept, text.alias("_body"), at_fault.alias("_fault"), items.alias("_items"))
    nothing = F.array(F.lit(None).cast("variant"))
    records = opened.select(
        *kept,
        "_body",
        "_fault",
        F.posexplode(F.when(F.col("_fault").isNotNull(), nothing).otherwise(F.col("_items"))).alias("_at", "_record"),
    )
    record = F.col("_record")
    reasons = [F.col("_fault"), F.when(~F.schema_of_variant(record).startswith("OBJECT"), "not an object")]
    columns = []
    for name, (path, kind) in fields.items():
        value = F.try_variant_get(record, path, kind)
        there = _present(F.try_variant_get(record, path, "variant"))
        columns.append(value.alias(name))
        reasons.append(F.when(there & value.isNull(), f"{name} is no {kind}"))
        if name in required:
            reasons.append(F.when(~F.coalesce(there, F.lit(False)), f"{name} absent"))
    return records.select(
        *kept,
        F.when(F.col("_fault").isNull(), F.col("_at")).alias(POSITION),
        *columns,
        F.when(F.col("_fault").isNotNull(), F.col("_body")).otherwise(F.to_json(record)).alias(RAW),
        F.coalesce(*reasons).alias(REASON),
    )


def good_records(records: DataFrame) -> DataFrame:
    return records.where(F.col(REASON).isNull()).drop(RAW, REASON)


def bad_records(records: DataFrame, fields: Iterable[str]) -> DataFrame:
    """What was not read: the columns that came with the body, position, text and reason."""
    return records.where(F.col(REASON).isNotNull()).drop(*fields)


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Good (``bad=0``) and bad (``bad=1``) records in one pass, in folders of their own below ``path``."""
    records.withColumn("bad", F.col(REASON).isNotNull().cast("int")).write.mode(mode).partitionBy("bad").parquet(path)
