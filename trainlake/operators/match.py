"""Best match of each left row within a few days, without enumerating pairs.

The rank is: smaller day gap, then matching type family, then smaller time
difference, then smaller id.  On either side of a start time the nearest right
row also has the smallest day gap, so each left row only needs one step back and
one step ahead in time order, once among all rows and once among its family.

The time line of a key, once for all rows and once for each family, is cut into
slots, and one sorted pass over a slot, there and back, carries the last
recording along, payload included.  Only the slots' edges are exchanged beside the rows: a slot also
receives the nearest recordings outside it.  A task never holds more than a
slot, even when one athlete or one day has most of the data.

Five exchanges in all: the edges by slot, the edges by key, the rows by slot,
the matches by what was asked, and the left rows that asked it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import micros
from ..functions.scalars import member_of
from .spine import BROADCAST_ROWS, left_join_spine

_ANY = "*"
_NO_TIME = -(1 << 62)
# Length of a time slot: the rows of a quarter of an hour of one key are sorted together.
SLOT_S = 15 * 60


def _searches(window_days: int) -> Column:
    """Where to look for a probe: (time, first day, last day) to accept.

    A start on its own day needs one search.  A row whose day is not that of its
    start time is looked up day by day, at the point of each day nearest to it.
    """
    day_us = 86_400_000_000

    def start_of(day: Column) -> Column:
        return micros(day)

    def search(at: Column, low: Column, high: Column) -> Column:
        return F.struct(at.alias("at"), low.alias("low"), high.alias("high"))

    day = F.col("_day")
    at = F.when(F.col("_t") == _NO_TIME, start_of(day)).otherwise(F.col("_t"))
    own_day = at.between(start_of(day), start_of(day) + F.lit(day_us - 1))
    once = F.array(search(at, F.date_sub(day, window_days), F.date_add(day, window_days)))
    by_day = [F.date_add(day, o) for o in range(-window_days, window_days + 1)]
    each = F.array(
        *[search(F.greatest(start_of(d), F.least(at, start_of(d) + F.lit(day_us - 1))), d, d) for d in by_day]
    )
    return F.when(own_day, once).otherwise(each)


def _edges(candidates: DataFrame, asked: DataFrame, group: Sequence[str]) -> DataFrame:
    """For each slot with probes the nearest candidates outside it."""
    there = F.col("_hit").isNotNull()
    here, turned = F.when(there, F.struct("_t", "_hit")), F.when(there, F.struct((-F.col("_t")).alias("_t"), F.col("_hit")))
    offered = candidates.select(*group, "_slot", "_t", "_hit", F.lit(False).alias("_asked"))
    wanted = asked.select(*group, "_slot", F.lit(True).alias("_asked"))
    # The smallest time, or the largest; at equal times the smallest id.
    ends = (F.min(here).alias("_first"), F.min(turned).alias("_last"), F.max("_asked").alias("_asked"))
    slots = offered.unionByName(wanted, allowMissingColumns=True).groupBy(*group, "_slot").agg(*ends)
    earlier = Window.partitionBy(*group).orderBy(F.col("_slot").asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*group).orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumns(
        {"_before": F.last("_last", ignorenulls=True).over(earlier), "_after": F.last("_first", ignorenulls=True).over(later)}
    ).filter("_asked")
    before = F.struct((-F.col("_before._t")).alias("_t"), F.col("_before._hit").alias("_hit"))
    after = F.struct(F.col("_after._t").alias("_t"), F.col("_after._hit").alias("_hit"))
    return carried.select(*group, "_slot", F.explode(F.array(before, after)).alias("_edge")).select(*group, "_slot", "_edge.*").filter(F.col("_hit").isNotNull())


def nearest_matches(
    probes: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str] = (),
    window_days: int = 1,
    max_diff_s: float | None = None,
    slot_s: int = SLOT_S,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Best candidate per distinct probe.

    ``probes`` has keys + ``_day, _t, _family``; ``candidates`` has keys +
    ``_t, _family, _id`` and the payload columns, with ``_t`` in microseconds
    on the same clock.  Result: the probe columns + ``_id, date_diff_days,
    type_mismatch, start_diff_s`` and the payload.  Candidates equal in time
    and id are told apart by their payload, the smallest first.
    """
    group = [*keys, "_cls"]
    # Every row stands among all rows and among its family.
    classes = F.explode(F.filter(F.array(F.lit(_ANY), F.col("_family")), lambda c: c != ""))

    def slot(time: str) -> Column:
        return F.floor(F.col(time) / F.lit(slot_s * 1_000_000)).cast("bigint")

    right = candidates.select(*keys, classes.alias("_cls"), slot("_t").alias("_slot"), "_t", F.struct("_id", *payload).alias("_hit"))
    asked = (
        probes.select(*keys, "_day", F.col("_t").alias("_own_t"), "_family", "_t")
        .filter(F.col("_day").isNotNull())
        .withColumn("_search", F.explode(_searches(window_days)))
        .withColumn("_cls", classes)
        .withColumn("_t", F.col("_search.at"))
        .withColumn("_slot", slot("_t"))
    )
    rows = right.unionByName(_edges(right, asked, group)).unionByName(asked, allowMissingColumns=True)

    # Candidates come before probes at equal time, in both directions, and the smallest id comes last.
    is_probe = F.col("_hit").isNull()
    back = Window.partitionBy(*group, "_slot").orderBy(F.col("_t").asc(), is_probe, F.col("_hit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*group, "_slot").orderBy(F.col("_t").desc(), is_probe, F.col("_hit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(~is_probe, F.struct("_t", "_hit"))
    near = rows.withColumns({"_back": F.last(found, ignorenulls=True).over(back), "_ahead": F.last(found, ignorenulls=True).over(ahead)}).filter(is_probe)

    def ranked(hit: str) -> Column:
        found_day = F.timestamp_micros(F.col(f"{hit}._t")).cast("date")
        secs = F.when(F.col("_own_t") != _NO_TIME, F.abs(F.col(f"{hit}._t") - F.col("_own_t")) / F.lit(1e6))
        entry = F.struct(
            F.abs(F.date_diff(found_day, F.col("_day"))).alias("date_diff_days"),
            F.when(F.col("_cls") == _ANY, 1).otherwise(0).alias("type_mismatch"),
            secs.alias("start_diff_s"),
            F.col(f"{hit}._hit").alias("_hit"),
        )
        usable = F.col(hit).isNotNull() & found_day.between(F.col("_search.low"), F.col("_search.high"))
        if max_diff_s is not None:
            usable = usable & (secs <= F.lit(float(max_diff_s)))
        return F.when(usable, entry)

    # ``least`` and ``min`` skip NULL, so a probe with one neighbour keeps it.
    return (
        near.select(*keys, "_day", F.col("_own_t").alias("_t"), "_family", F.least(ranked("_back"), ranked("_ahead")).alias("_best"))
        .filter(F.col("_best").isNotNull())
        .groupBy(*keys, "_day", "_t", "_family")
        .agg(F.min("_best").alias("_best"))
        .select(*keys, "_day", "_t", "_family", "_best.date_diff_days", "_best.type_mismatch", "_best.start_diff_s", "_best._hit.*")
    )


PROBE = ("_day", "_t", "_family")


def with_probe(left: DataFrame, day: str, time: str, kind: str, families: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Add the probe columns that identify what a left row asks for.

    A row without a day asks for nothing; its time is a hash of the row, so
    that such rows spread over the tasks of the join back.
    """
    family = member_of(F.col(kind), {n: m[0] for n, m in families.items()})
    nowhere = F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    return left.withColumns(
        {
            "_day": F.col(day).cast("date"),
            "_t": F.when(F.col(day).isNull(), nowhere).otherwise(F.coalesce(micros(F.col(time)), F.lit(_NO_TIME))),
            "_family": F.coalesce(family, F.lit("")),
        }
    )


def match_table(
    asking: DataFrame,
    right: DataFrame,
    *,
    right_id: str,
    right_time: str,
    right_type: str,
    families: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    payload: Mapping[str, str] | None = None,
    match_id: str = "match_id",
    keys: Sequence[str] = (),
    window_days: int = 1,
    max_diff_s: float | None = None,
    slot_s: int = SLOT_S,
) -> DataFrame:
    """One row per distinct probe that has a match: keys, probe columns, match, payload."""
    keys = list(keys)
    family = F.coalesce(member_of(F.col(right_type), {n: m[1] for n, m in families.items()}), F.lit(""))
    offered = right.filter(F.col(right_time).isNotNull()).withColumns(
        {"_t": micros(F.col(right_time)), "_family": family, "_id": F.col(right_id)}
    )
    named = dict(payload or {})
    taken = {alias: f"_payload_{i}" for i, alias in enumerate(named.values())}
    offered = offered.select(*keys, "_t", "_family", "_id", *[F.col(c).alias(taken[a]) for c, a in named.items()])
    matches = nearest_matches(asking, offered, keys, window_days, max_diff_s, slot_s, list(taken.values()))
    return matches.withColumnsRenamed({"_id": match_id} | {name: alias for alias, name in taken.items()})


def best_match(
    left: DataFrame,
    right: DataFrame,
    *,
    left_day: str,
    left_time: str,
    left_type: str,
    families: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    keys: Sequence[str] = (),
    hot_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    **match_args,
) -> DataFrame:
    """Left rows with their best right row attached (NULL when there is none).

    ``families`` maps a name to (left types, right types); rows of one family
    are compatible.  ``payload`` maps right columns to result names.  Adds
    ``match_id, date_diff_days, type_mismatch, start_diff_s`` and the payload.
    Nothing runs while the plan is built, unless ``hot_rows`` asks to count the
    rows that ask for the same and to join those with more apart.
    """
    asking = with_probe(left, left_day, left_time, left_type, families)
    matches = match_table(asking, right, families=families, keys=keys, **match_args)
    return left_join_spine(asking, [matches], [*keys, *PROBE], hot_rows, broadcast_rows).drop(*PROBE)
