"""File scans: JSON exports and the activity CSV."""

from __future__ import annotations

import csv
import io
import warnings
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import convert, nan_to_null, parse_human_time
from ..functions.names import snake_case
from ..plans import contracts as C
from ..session import case_sensitive
from . import documents, records

# Whole documents above this size are read by several tasks.
SPLIT_OVER = 64 << 20


def read_json(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | T.StructType | None,
    multi_line: bool = True,
    base_path: str | None = None,
    split_over: int | None = None,
) -> DataFrame:
    """All records of the matching files: array elements, or a lone object as one record.

    ``multi_line`` suits whole-document exports.  Each is read by one task, but
    with ``split_over`` those of more bytes are read by several (``documents``;
    an object that the schema reads as text then loses its white space);
    line-delimited files are split between tasks with ``multi_line=False``.
    Malformed files fail.  No matching file gives a warning and an empty frame.
    Where a schema holds names that differ only in case, the frame must also be
    executed inside ``case_sensitive``.
    """
    if multi_line and split_over is not None and schema is not None:
        whole = read_json(spark, paths, schema, True, base_path)
        if not whole.inputFiles():
            return whole
        small = whole.filter(F.col("_metadata.file_size") <= split_over)
        with case_sensitive(spark):
            large = documents.elements(spark, paths, base_path, split_over)
            ddl = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            inside = T.StructType([f for f in ddl.fields if f.name not in large.columns or f.name == "value"])
            parsed = large.select(F.from_json("value", inside, {"mode": "FAILFAST"}).alias("_record"), *[c for c in large.columns if c != "value"])
            return small.unionByName(parsed.select("_record.*", *[c for c in parsed.columns if c != "_record"]))
    with case_sensitive(spark):
        reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
        if base_path:
            reader = reader.option("basePath", base_path)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            return reader.json(paths if isinstance(paths, str) else list(paths))
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND" or schema is None:
                raise
            warnings.warn(f"no files found for {paths}", stacklevel=2)
            empty = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            return spark.createDataFrame([], empty)


def original_headers(columns: Sequence[str]) -> list[str]:
    """Undo the position suffix that Spark's own CSV reader puts on repeated headers."""
    stripped = [c.removesuffix(str(i)) for i, c in enumerate(columns)]
    repeats = Counter(s for s, c in zip(stripped, columns) if s != c)
    return [s if s != c and repeats[s] > 1 else c for s, c in zip(stripped, columns)]


def csv_names(headers: Sequence[str]) -> list[str]:
    """Table names for CSV headers; of a repeated header the last copy is canonical, earlier ones ``*_summary``."""
    last = {h: i for i, h in enumerate(headers)}
    names = []
    for i, header in enumerate(headers):
        name = "activity_date_str" if header == "Activity Date" else snake_case(header)
        names.append(name if last[header] == i else f"{name}_summary")
    return names


def _read_csv(spark: SparkSession, paths: str | Sequence[str], base_path: str | None) -> DataFrame:
    """All columns as text under their table names; files of each header are read under it."""
    found = records.records(spark, paths, base_path)
    kept = [c for c in found.columns if c not in ("_file", "_first", "value")]
    headed = found.filter("_first").select("_file", F.col("value").alias("_header"))
    # One row per distinct header; whatever the number of files.
    headers = sorted(r["_header"] for r in headed.select("_header").distinct().collect())
    rows = found.filter(~F.col("_first"))
    if len(headers) > 1:
        rows = rows.join(headed, "_file")
    read = []
    for header in headers:
        names = csv_names(next(csv.reader(io.StringIO(header, newline=""))))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        mine = rows.filter(F.col("_header") == header) if len(headers) > 1 else rows
        parsed = mine.select(F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"quote": '"', "escape": '"', "multiLine": "true"}).alias("_r"), *kept)
        inside = [n for n in names if n not in kept]
        fields = [F.col(f"_r.c{i}").alias(n) for i, n in enumerate(names) if n in inside]
        read.append(parsed.select(*fields, *kept))
    if not read:
        return spark.createDataFrame([], ", ".join(f"`{k}` STRING" for k in (*csv_names(["Activity Date"]), *kept)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def read_activity_csv(spark: SparkSession, path: str, base_path: str | None = None, strict: bool = True) -> DataFrame:
    """The activity log with typed measures, ``started_at`` and ``activity_date``.

    Files whose headers differ, in order or in columns, are each read under
    their own header; a column that a file lacks is NULL.  A large file is read
    by several tasks, also where texts hold line ends.
    """
    df = _read_csv(spark, path, base_path)
    kinds = {f.raw: f.kind for f in C.ACTIVITY_LOG if f.raw in df.columns}
    kinds |= {f"{n}_summary": k for n, k in list(kinds.items()) if f"{n}_summary" in df.columns}
    loose = {"int": "double"}  # measures stay fractional until they are staged
    typed = {n: convert(f"`{n}`", T.StringType(), loose.get(k, k)) for n, k in kinds.items() if k in ("int", "double", "bigint", "boolean")}
    df = nan_to_null(df.withColumns(typed))
    started = parse_human_time(F.col("activity_date_str"), strict)
    return df.withColumn("started_at", started).withColumn("activity_date", F.col("started_at").cast("date"))
