"""A result is a value or a reason to refuse it, with its formula and inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def refusal(reasons: Sequence[tuple[Column, str]]) -> Column:
    """The code of the first condition that holds, in order; null if none does. A null condition doesn't hold."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def guarded(value: Column, reasons: Sequence[tuple[Column, str]], formula: Column, inputs: dict[str, Column]) -> Column:
    """``struct(value, refused, formula, inputs)`` in which value and refused exclude each other."""
    code = refusal(reasons)
    pairs = [x for k, v in inputs.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.when(code.isNull(), value).alias("value"),
        F.coalesce(code, F.when(value.isNull(), F.lit("missing"))).alias("refused"),
        formula.alias("formula"),
        F.create_map(*pairs).alias("inputs"),
    )
