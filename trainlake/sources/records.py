"""Records of large CSV files read by many tasks.

A line end inside quotes belongs to the record, and whether a line begins
inside quotes depends on all quotes before it.  Only their parity counts, so
each byte range is first reduced to the parity of its quotes; composed in order
(one row per range) it tells every range how it begins.  A second pass puts the
lines of a record together; the record that runs over a range's end is put
together from the parts its ranges hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 5_000


def _lines(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, pa.Array, np.ndarray]]:
    """((file, start of the range, other columns), lines, quotes of each line) of consecutive rows."""
    for batch in batches:
        keys = list(zip(*(batch[n].to_pylist() for n in columns)))
        quotes = pc.count_substring(batch["value"], pattern='"').to_numpy(zero_copy_only=False)
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i][:2] != keys[i - 1][:2]], len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield keys[s], batch["value"].slice(s, e - s), quotes[s:e]


def _parities(rows: DataFrame) -> DataFrame:
    """One row per range: whether it turns quoting on or off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for key, _, quotes in _lines(batches, ["_file", "_start"]):
            held[key] = held.get(key, 0) + int(quotes.sum())
        if held:
            files, starts = zip(*held)
            turned = [n % 2 for n in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(starts, pa.int64()), pa.array(turned, pa.int32())], names=["_file", "_start", "turned"])

    return rows.select("_file", "_start", "value").mapInArrow(run, "_file string, _start long, turned int")


def _cut(placed: DataFrame, kept: Sequence[str], ends: bool) -> DataFrame:
    """The complete records of each range, or the parts of records at its two ends.

    ``_fresh``: the record begins in this part; ``_first``: it is the file's first.
    """
    columns = ["_file", "_start", "_inside", *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        out: list[tuple] = []

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field(k).type for k in kept]
                yield batch

        def handed() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), *kinds]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["_file", "_start", "_fresh", "_first", "value", *kept])
            out.clear()
            return batch

        key: tuple | None = None
        part: list[str] = []
        inside, fresh, first = False, True, False

        def left() -> None:
            """A record that the range leaves open."""
            if key is not None and part and ends:
                out.append((*key[:2], fresh, first, "\n".join(part), *key[3:]))

        for now, lines, quotes in _lines(seen(batches), columns):
            if key is None or now[:2] != key[:2]:
                left()
                # What comes before the first record's beginning belongs to the range before.
                key, part, inside, fresh, first = now, [], now[2], not now[2], now[1] == 0
            for line, n in zip(lines.to_pylist(), quotes.tolist()):
                part.append(line)
                inside ^= bool(n % 2)
                if not inside:
                    if fresh != ends:
                        out.append((*key[:2], fresh, first, "\n".join(part), *key[3:]))
                    part, fresh, first = [], True, False
                    if len(out) >= ROWS:
                        yield handed()
        left()
        if out:
            yield handed()

    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    return placed.mapInArrow(run, "_file string, _start long, _fresh boolean, _first boolean, value string" + "".join(f", `{k}` {types[k]}" for k in kept))


def records(spark: SparkSession, paths: str | Sequence[str], base_path: str | None = None) -> DataFrame:
    """``_file``, ``_first`` (the file's first record, its header), ``value`` and the path's partition columns.

    ``value`` is the text of one record, quotes and inner line ends as they
    are.  Blank records are left out.  A file that ends inside quotes fails.
    """
    reader = spark.read.option("lineSep", "\n")
    if base_path:
        reader = reader.option("basePath", base_path)
    text = reader.text(paths if isinstance(paths, str) else list(paths))
    kept = [c for c in text.columns if c != "value"]
    rows = text.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value", *kept
    )
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")
    inside = F.coalesce(F.sum("turned").over(before) % 2 == 1, F.lit(False))
    fail = F.raise_error(F.concat(F.lit("CSV file ends inside quotes: "), F.col("_file"))).cast("boolean")
    odd = F.sum("turned").over(whole) % 2 == 1
    states = _parities(rows).select("_file", "_start", inside.alias("_begins"), odd.alias("_odd"))
    states = states.select("_file", "_start", F.when(F.col("_odd"), fail).otherwise(F.col("_begins")).alias("_inside"))
    # A range stays whole, and in the order of its bytes, whichever way Spark joins.
    placed = rows.join(states, ["_file", "_start"]).sortWithinPartitions("_file", "_start", "_at")
    inner = _cut(placed, kept, ends=False).select("_file", "_first", "value", *kept)

    edges = _cut(placed, kept, ends=True)
    order = Window.partitionBy("_file").orderBy("_start", "_fresh")
    numbered = edges.withColumn("_record", F.sum(F.col("_fresh").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("_start", "_fresh", "value")))
    outer = numbered.groupBy("_file", "_record", *kept).agg(F.bool_or("_first").alias("_first"), F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    outer = outer.select("_file", "_first", "value", *kept)

    # A line may end with a carriage return, a file begin with a mark.
    value = F.regexp_replace("value", "\r$", "")
    value = F.when(F.col("_first"), F.ltrim(value, F.lit("\ufeff"))).otherwise(value)
    return inner.unionByName(outer).withColumn("value", value).filter(F.trim("value") != "")
