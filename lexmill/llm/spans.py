"""Regular-expression matches with their positions, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,`end`:int,found:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches for which ``keep(match)`` holds: start, end (exclusive), found.

    Positions count code points. A match that ``keep`` refuses still takes its
    place: the search goes on behind it. The text between matches and the
    matches themselves come from the same search, so adding up their lengths
    gives the positions. ``pattern`` must not match the empty string.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["between"])
        end = start + F.coalesce(F.length(pair["found"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        # the last pair has the rest of the text and no match
        kept = F.when(pair["found"].isNotNull() & keep(pair["found"]), F.concat(acc["kept"], F.array(span))).otherwise(acc["kept"])
        return F.struct(end.alias("at"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("at"), no_spans().alias("kept"))
    found = F.aggregate(pairs, start, step, lambda acc: acc["kept"])
    return F.when(text.rlike(pattern), found).otherwise(no_spans())


def listing(spans: Column) -> Column:
    """``kind:start:end`` of structs, comma-joined in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
