"""Fields that export files have beyond the declared ones.

A grouped aggregate over the fields of all records finds each name with the
type that holds all its values; only names and types reach the driver.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import snake_case
from ..session import case_sensitive
from . import documents


def _variants(spark: SparkSession, paths: str | Sequence[str], multi_line: bool, base_path: str | None, split_over: int) -> DataFrame:
    """``v``: every record of the matching files."""
    reader = spark.read.option("singleVariantColumn", "v").option("multiLine", multi_line).option("mode", "FAILFAST")
    if base_path:
        reader = reader.option("basePath", base_path)
    files = reader.json(paths if isinstance(paths, str) else list(paths))
    if not multi_line:
        return files.select("v")
    small = files.filter(F.col("_metadata.file_size") <= split_over).select("v")
    large = documents.elements(spark, paths, base_path, split_over).select(F.parse_json("value").alias("v"))
    return _elements(small).unionByName(large)


def _elements(df: DataFrame) -> DataFrame:
    """One row per element where ``v`` is an array, the row itself where it is not."""
    listed = F.try_variant_get("v", "$", "array<variant>")
    return df.select(F.explode(F.coalesce(listed, F.array("v"))).alias("v"))


def fields(
    spark: SparkSession,
    paths: str | Sequence[str],
    multi_line: bool = True,
    base_path: str | None = None,
    split_over: int = 64 << 20,
    envelope: str | None = None,
    known: Collection[str] = (),
) -> dict[str, str]:
    """Name -> type of every field of the records but the ``known`` ones, by name.

    The type is ``bigint``, ``double``, ``boolean`` or ``string`` (also for
    fields whose values differ in kind, or are all null), and ``nested`` as soon
    as one value is a list or an object.  ``envelope`` names the list inside
    each record that holds the actual records.
    """
    with case_sensitive(spark):
        records = _variants(spark, paths, multi_line, base_path, split_over)
        if envelope is not None:
            records = _elements(records.select(F.variant_get("v", f"$.{envelope}", "variant").alias("v")).filter(F.col("v").isNotNull()))
        each = records.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", "value")
        # Elements of a record that is a list have no key.
        each = each.filter(F.col("key").isNotNull())
        if known:
            each = each.filter(~F.col("key").isin(*sorted(known)))
        kind = F.schema_of_variant("value")
        nested = F.bool_or(kind.startswith("ARRAY") | kind.startswith("OBJECT")).alias("nested")
        found = each.groupBy("key").agg(F.schema_of_variant_agg("value").alias("type"), nested).collect()
    return {r["key"]: "nested" if r["nested"] else _spark_type(r["type"]) for r in sorted(found)}


def _spark_type(kind: str) -> str:
    if kind in ("BIGINT", "BOOLEAN"):
        return kind.lower()
    # Whole and fractional spellings of one measure meet in a decimal.
    return "double" if kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")) else "string"


def extra_fields(found: dict[str, str], declared: Sequence[str], taken: Sequence[str]) -> list[tuple[str, str, str]]:
    """(field, column, type) of the flat fields that are not ``declared``, by name.

    Columns are the snake_case names; one that is ``taken``, by another column
    or an earlier field, gets the next free number behind it.
    """
    used = {t.lower() for t in taken}
    out = []
    for name, kind in sorted(found.items()):
        if kind == "nested" or name in declared:
            continue
        column, n = snake_case(name), 2
        while column in used:
            column, n = f"{snake_case(name)}_{n}", n + 1
        used.add(column)
        out.append((name, column, kind))
    return out


def widened(ddl: str, extra: Sequence[tuple[str, str, str]], envelope: str | None = None) -> T.StructType:
    """The declared schema with the extra fields, inside the envelope if there is one."""
    schema = T.StructType.fromDDL(ddl)
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, _, kind in extra]
    if envelope is None:
        return T.StructType([*schema.fields, *more])
    items = schema[envelope].dataType.elementType
    inner = T.ArrayType(T.StructType([*items.fields, *more]))
    return T.StructType([T.StructField(f.name, inner) if f.name == envelope else f for f in schema.fields])
