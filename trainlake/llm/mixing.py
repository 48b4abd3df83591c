"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only.

A document of source s is repeated on average rate(s) times.  A hash of its id
and the seed is a uniform number; the smallest count whose Poisson distribution
function exceeds it is the number of copies.  The copies are then dealt over
all partitions and ordered by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import unused

# Entries of all distribution tables up to which they are sent to every task (16 bytes each).
BROADCAST_ENTRIES = 200_000
# Copies of the tables, and shares of a hot source, beyond that.
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash; the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def temperature_weights(docs: DataFrame, exponent: float = 0.5) -> DataFrame:
    """(source, weight): each source's number of rows to a power below one, which lifts small sources."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(exponent)).alias("weight"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, cdf): distribution function at 0, 1, 2 .. until it is one in double precision."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.filter("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    mass = steps.select("source", "k", F.exp(-F.col("rate") + F.col("k") * F.log("rate") - factorial).alias("p"))
    summed = mass.select("source", "k", F.sum("p").over(upto).alias("c"))
    listed = F.array_sort(F.collect_list(F.struct("k", "c")))
    return summed.groupBy("source").agg(F.transform(listed, lambda s: s["c"]).alias("cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 1) -> DataFrame:
    """Repeat and drop documents so that sources have the shares of ``weights`` on average.

    ``weights`` has one row (source, weight >= 0) per source; sources without a
    row or weight go.  ``total`` is the expected number of rows, by default
    that of ``docs``.  Returns the columns of ``docs`` and copies (the row's
    number of copies) and copy (1 to copies), one row per copy, shuffled.

    Defined cases: the null source is a source of its own; rows with equal
    doc_id get equal counts; rows without doc_id are drawn by their text (null
    and empty alike); input columns named copies or copy are replaced.  Without
    weights, or from an empty table, nothing comes.
    """
    docs = docs.drop("copies", "copy")
    of, cdf, salt, at = (unused(name, docs) for name in ("_source", "_cdf", "_salt", "_at"))
    counts = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    known = counts.alias("c").join(weights.select("source", "weight").alias("w"), F.col("c.source").eqNullSafe(F.col("w.source")))
    known = known.select("c.source", "n", F.col("weight").cast("double").alias("weight")).filter("weight > 0")
    sums = counts.agg(F.sum("n").alias("n")).first()["n"], known.agg(F.sum("weight").alias("w"), F.count("*").alias("k")).first()
    rows, weight = sums[0] or 0.0, sums[1]["w"] or 1.0
    expected = float(rows if total is None else total)
    rates = known.select("source", (F.lit(expected) * F.col("weight") / F.lit(weight) / F.col("n")).alias("rate"))
    tables = poisson_tables(rates).withColumnRenamed("source", of).withColumnRenamed("cdf", cdf)

    entries = rates.agg(F.sum(F.col("rate") + 12 * F.sqrt("rate") + 32).alias("e")).first()["e"] or 0
    same = F.col("source").eqNullSafe(F.col(of))
    if entries <= BROADCAST_ENTRIES:
        joined = docs.join(F.broadcast(tables), same)
    else:
        # A third of all rows may be one source: its rows meet one of several copies of its table.
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        spread = tables.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, same & (F.col(salt) == F.col(at)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    u = uniform(seed, key)
    drawn = joined.withColumn("copies", F.size(F.filter(cdf, lambda c: c <= u)).cast("int"))
    # An empty sequence gives no row; a filter on the count could be moved below the join, where the row isn't known.
    upto = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))
    several = drawn.select(*[F.col(f"`{c}`") for c in docs.columns], "copies", F.explode(upto).alias("copy"))
    order = F.xxhash64(F.lit(seed), key, F.col("copy"))
    return several.repartition(order).sortWithinPartitions(order)
