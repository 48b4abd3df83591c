"""Large JSON documents read by many tasks.

A document that is one array can't be cut at line ends, and whether a byte is
inside a string or how deep it lies depends on all bytes before it.  It is
therefore read in byte ranges, cut behind closing braces, in passes:

1. Each range is reduced to a transition: whether it turns strings on or off,
   and by how much it changes the depth if it begins outside or inside one.
2. Composed in order of the ranges (one row each) they give every range its
   state at the beginning.  With it a range cuts its bytes at the commas of the
   outermost array.  Elements inside a range are complete.
3. What lies before the first and behind the last cut of a range is put
   together with its neighbours' ends, two rows a range.

The passes read the files again instead of keeping the bytes; no task holds
more than a batch of rows and one element.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows end behind one of these, which JSON texts have at the end of every record.
BRACE = "}"
# Rows handed on at a time.
ROWS = 5_000

# White space, and the bytes of a mark that may begin a file.
_MARGIN = b" \t\r\n\xef\xbb\xbf"
_BLANK = np.zeros(256, bool)
_BLANK[list(_MARGIN)] = True
_STEP = np.zeros(256, np.int64)
_STEP[[0x7B, 0x5B]] = 1
_STEP[[0x7D, 0x5D]] = -1


def _outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Which bytes lie outside of strings, quotes included, and whether a string is open at the end."""
    quotes = np.flatnonzero(data == 0x22)
    slashes = data == 0x5C
    if slashes.any():
        # A quote behind an odd number of backslashes is a character.
        plain = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        quotes = quotes[(quotes == 0) | ((quotes - 1 - plain[quotes - 1]) % 2 == 0)]
    turns = np.zeros(len(data), np.int64)
    turns[quotes] = 1
    open_after = (np.cumsum(turns) + inside) % 2 == 1
    outside = ~open_after
    outside[quotes] = True
    return outside, bool(open_after[-1])


def _ranges(batches: Iterator[pa.RecordBatch], carried: Sequence[str] = ()) -> Iterator[tuple[tuple, np.ndarray]]:
    """((file, start of the range, carried columns), bytes) of consecutive rows, each with its brace again."""
    for batch in batches:
        keys = list(zip(*(batch[n].to_pylist() for n in ("_file", "_start", *carried))))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i][:2] != keys[i - 1][:2]], len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                rows = pc.binary_join_element_wise(batch["value"][s:e].cast(pa.large_binary()), pa.scalar(BRACE.encode(), pa.large_binary()), pa.scalar(b"", pa.large_binary()))
                ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
                yield keys[s], np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _transitions(rows: DataFrame) -> DataFrame:
    """One row per range: its change of state, and its first character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for key, data in _ranges(batches, ["_size"]):
            state = held.setdefault(key, [False, 0, 0, None, 0])
            state[4] += len(data)
            outside, state[0] = _outside(data, state[0])
            steps = _STEP[data]
            state[1] += int(steps[outside].sum())
            state[2] += int(steps[~outside].sum())
            if state[3] is None and (filled := np.flatnonzero(~_BLANK[data])).size:
                state[3] = chr(data[filled[0]])
        if held:
            columns = [*zip(*held), *zip(*held.values())]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            names = ["_file", "_start", "_size", "turned", "from_outside", "from_inside", "opens", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = "_file string, _start long, _size long, turned boolean, from_outside long, from_inside long, opens string, bytes long"
    return rows.select("_file", "_start", "_size", "value").mapInArrow(run, schema)


def _states(ranges: DataFrame) -> DataFrame:
    """``_inside`` and ``_depth`` at the beginning of each range; a document whose brackets don't close fails."""
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = F.col("turned").cast("int")
    placed = ranges.withColumns(
        {
            "_inside": F.coalesce(F.sum(turned).over(before) % 2 == 1, F.lit(False)),
            "_odd": F.sum(turned).over(whole) % 2 == 1,
            # A lone object is read like the only element of an array that is open already.
            "_open": F.when(F.first("opens", ignorenulls=True).over(whole) == "[", 0).otherwise(1),
        }
    )
    change = F.when(F.col("_inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    placed = placed.withColumn("_change", change).withColumns(
        {
            "_before": F.coalesce(F.sum("_change").over(before), F.lit(0)),
            "_total": F.sum("_change").over(whole),
            "_bytes": F.sum("bytes").over(whole),
        }
    )
    # The last row of a file gets a brace that may not be there; a mark of three bytes is passed over.
    added = F.pmod(F.col("_bytes") - F.col("_size"), F.lit(3))
    broken = F.col("_odd") | (F.col("_total") + added != 0)
    fail = F.raise_error(F.concat(F.lit("JSON document ends too early or too late: "), F.col("_file"))).cast("long")
    return placed.select("_file", "_start", "_inside", F.when(broken, fail).otherwise(F.col("_before") + F.col("_open")).alias("_depth"))


def _cut(placed: DataFrame, kept: Sequence[str], ends: bool) -> DataFrame:
    """The complete elements of each range, or its two ends with whether an element begins there (``_fresh``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        out: list[tuple] = []

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field(k).type for k in kept]
                yield batch

        def handed() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.bool_(), pa.large_binary(), *kinds]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["_file", "_start", "_fresh", "value", *kept])
            out.clear()
            return batch

        key: tuple | None = None
        piece: list[bytes] = []
        inside, depth, fresh = False, 0, False
        for now, data in _ranges(seen(batches), ["_inside", "_depth", *kept]):
            if key is None or now[:2] != key[:2]:
                if key is not None and ends:
                    out.append((*key[:2], fresh, b"".join(piece), *key[4:]))
                key, piece, inside, depth, fresh = now, [], now[2], now[3], False
            outside, inside = _outside(data, inside)
            after = depth + np.cumsum(np.where(outside, _STEP[data], 0))
            before = np.concatenate([[depth], after[:-1]])
            depth = int(after[-1])
            edge = (data == 0x2C) & (after == 1) | (before == 0) & (after == 1) | (before == 1) & (after == 0)
            text, at = data.tobytes(), 0
            for cut in np.flatnonzero(outside & edge).tolist():
                if fresh != ends:
                    out.append((*key[:2], fresh, b"".join([*piece, text[at:cut]]), *key[4:]))
                piece, at, fresh = [], cut + 1, True
                if len(out) >= ROWS:
                    yield handed()
            piece.append(text[at:])
        if key is not None and ends:
            out.append((*key[:2], fresh, b"".join(piece), *key[4:]))
        if out:
            yield handed()

    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    return placed.mapInArrow(run, "_file string, _start long, _fresh boolean, value binary" + "".join(f", `{k}` {types[k]}" for k in kept))


def elements(spark: SparkSession, paths: str | Sequence[str], base_path: str | None = None, over_bytes: int = -1) -> DataFrame:
    """``value``, the text of every record in the matching files, and the path's partition columns.

    A record is an element of the document's array, or the whole document if it
    is an object.  Only files of more than ``over_bytes`` are read.  A document
    whose brackets or quotes don't close fails; whatever else is no JSON shows when ``value`` is
    parsed.
    """
    reader = spark.read.option("lineSep", BRACE)
    if base_path:
        reader = reader.option("basePath", base_path)
    text = reader.text(paths if isinstance(paths, str) else list(paths))
    kept = [c for c in text.columns if c != "value"]
    rows = text.filter(F.col("_metadata.file_size") > over_bytes).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").cast("binary").alias("value"),
        *kept,
    )
    # A range stays whole, and in the order of its bytes, whichever way Spark joins.
    placed = rows.join(_states(_transitions(rows)), ["_file", "_start"]).sortWithinPartitions("_file", "_start", "_at")
    inner = _cut(placed, kept, ends=False).select("value", *kept)

    edges = _cut(placed, kept, ends=True)
    order = Window.partitionBy("_file").orderBy("_start", "_fresh")
    numbered = edges.withColumn("_element", F.sum(F.col("_fresh").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("_start", "_fresh", "value")))
    outer = numbered.groupBy("_file", "_element", *kept).agg(F.array_join(F.transform(parts, lambda p: F.hex(p["value"])), "").alias("hex"))
    outer = outer.select(F.unhex("hex").alias("value"), *kept)

    record = F.btrim(F.col("value").cast("string"), F.lit(_MARGIN.decode("utf-8")))
    # What is left of an empty array, or of a file's end, holds no record.
    return inner.unionByName(outer).withColumn("value", record).filter(F.btrim("value", F.lit(BRACE + " \t\r\n")) != "")
