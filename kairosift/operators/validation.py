"""Validation of JSON records against a schema description: every fault becomes a code.

Values are parsed once, permissively, into typed fields with the record itself where it is corrupt; the kinds of values as they
are written come from the parsed variant, so a number in quotes isn't a number. All of it is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of fields: their type when parsed, and how a value of the kind is written.
KINDS = {"integer": ("bigint", "^BIGINT$"), "number": ("double", "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "text": ("string", "^STRING$"), "flag": ("boolean", "^BOOLEAN$"), "list": ("string", "^ARRAY.*$")}


@dataclass(frozen=True)
class Field:
    """A field of a record; ``size``: characters of a text or entries of a list at most; ``low`` and ``high``: inclusive bounds of a number."""

    name: str
    kind: str
    required: bool = True
    allowed: tuple[str, ...] = ()
    size: int | None = None
    low: float | None = None
    high: float | None = None


def _faults(f: Field, value: Column, kind: Column, variant: Column) -> list[Column]:
    there = kind.isNotNull() & (kind != "VOID")
    right = there & kind.rlike(KINDS[f.kind][1])
    code = lambda name: F.lit(f"{name}:{f.name}")
    out = [F.when(there & ~right, code("WRONG_TYPE"))]
    if f.required:
        out.append(F.when(~F.coalesce(there, F.lit(False)), code("MISSING")))
    if f.allowed:
        out.append(F.when(right & ~value.isin(*f.allowed), code("NOT_ALLOWED")))
    if f.size is not None:
        length = F.size(F.try_variant_get(variant, f"$.{f.name}", "array<variant>")) if f.kind == "list" else F.length(value)
        out.append(F.when(right & (length > f.size), code("TOO_LONG")))
    for bound, breaks in ((f.low, lambda b: value < b), (f.high, lambda b: value > b)):
        if bound is not None:
            out.append(F.when(right & breaks(F.lit(bound)), code("OUT_OF_RANGE")))
    return out


def validated(records: DataFrame, column: str, fields: list[Field], closed: bool = True) -> DataFrame:
    """``records`` with ``value`` (the typed fields) and ``codes`` (its faults, sorted; empty: none) of the JSON text in ``column``.

    MALFORMED: not an object at all, null too; MISSING, WRONG_TYPE, NOT_ALLOWED, TOO_LONG, OUT_OF_RANGE with the field's name; UNKNOWN with
    the name of a field that isn't described, if ``closed``. A JSON null is a missing value.
    """
    schema = ", ".join(f"`{f.name}` {KINDS[f.kind][0]}" for f in fields)
    held = records.withColumns({"value": F.from_json(column, f"{schema}, `_corrupt` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}), "__variant": F.try_parse_json(column)})
    variant, keys = F.col("__variant"), F.json_object_keys(column)
    whole = variant.isNotNull() & F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    found: list[Column] = []
    for f in fields:
        kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{f.name}", "variant"))
        found += _faults(f, F.col("value").getField(f.name), kind, variant)
    own = F.array_compact(F.array(*found))
    if closed:
        other = F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: ~k.isin(*[f.name for f in fields]))
        own = F.concat(own, F.transform(other, lambda k: F.concat(F.lit("UNKNOWN:"), k)))
    codes = F.when(F.coalesce(whole, F.lit(False)), F.array_sort(F.array_distinct(own))).otherwise(F.array(F.lit("MALFORMED")))
    return held.withColumn("codes", codes).drop("__variant")
