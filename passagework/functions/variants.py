"""Configurations as VARIANT: parsed once when they are stored, read by path afterwards.

shredded() keeps what queries filter on as typed columns beside the variant, so such a query reads no configuration at all;
anything else comes from the variant by variant_get. Defined results: text that isn't JSON gives nulls throughout, as does
null; a field that is missing, or has another type, is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column: (path below the kind, type).
FIELDS = {"size": ("$.size", "int"), "overlap": ("$.overlap", "int"), "delimiter": ("$.delimiter", "string"), "threshold": ("$.threshold", "double")}
KINDS = ("sliding", "snapping", "semantic")


def parsed(config: Column) -> Column:
    return F.try_parse_json(config)


def kind_of(variant: Column) -> Column:
    """The one kind that the configuration has."""
    out = None
    for kind in KINDS:
        has = F.try_variant_get(variant, f"$.{kind}", "variant").isNotNull()
        out = F.when(has, kind) if out is None else out.when(has, kind)
    return out


def field(variant: Column, path: str, type_: str) -> Column:
    """A field of the body, whatever the kind."""
    return F.coalesce(*[F.try_variant_get(variant, path.replace("$", f"$.{kind}", 1), type_) for kind in KINDS])


def distance(variant: Column) -> tuple[Column, Column]:
    """Name and power of a semantic chunker's similarity, which is a string or {"minkowski": power}."""
    power = F.try_variant_get(variant, "$.semantic.distanceFn.minkowski", "int")
    return F.when(power.isNotNull(), "minkowski").otherwise(F.try_variant_get(variant, "$.semantic.distanceFn", "string")), power


def shredded(df: DataFrame, config: str = "config") -> DataFrame:
    """df with its JSON column as a variant, and kind, size, overlap, delimiter, threshold, distance, power, skip_f and skip_b."""
    v = F.col(config)
    out = df.withColumn(config, parsed(v)).withColumn("kind", kind_of(v))
    for name, (path, type_) in FIELDS.items():
        out = out.withColumn(name, field(v, path, type_))
    name, power = distance(v)
    out = out.withColumn("distance", F.when(F.col("kind") == "semantic", name)).withColumn("power", power)
    for name, path in (("skip_f", "$.skipF"), ("skip_b", "$.skipB")):
        out = out.withColumn(name, field(v, path, "array<string>"))
    return out
