"""Names and reports as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_dir(depth: Column, batch: Column, sample: Column, runner: Column) -> Column:
    """d<depth>_b<batch>_s<sample>_r<runner>."""
    parts = [("d", depth), ("_b", batch), ("_s", sample), ("_r", runner)]
    return F.concat(*[x for tag, value in parts for x in (F.lit(tag), value.cast("string"))])


def is_run_dir(name: Column) -> Column:
    return name.rlike(r"^d\d+_b\d+_s\d+_r\d+$")


def progress_bar(done: Column, total: Column, width: int = 40) -> Column:
    """[####----]  50.0%, the ratio clamped to [0, 1]; an error where the total is not positive."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(done.cast("double"), total.cast("double"))))
    n = F.floor(ratio * width).cast("int")
    bar = F.concat(F.lit("["), F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n), F.lit("] "), F.format_string("%5.1f%%", F.bround(ratio * 100, 1)))
    return F.when(total > 0, bar).otherwise(F.raise_error(F.lit("total must be positive")))


def report_field(lines: Column, entry: str) -> Column:
    """What follows ``entry`` on the first of ``lines`` that starts with it; empty if there is none."""
    found = F.get(F.filter(lines, lambda x: x.startswith(entry)), F.lit(0))
    return F.coalesce(F.trim(F.replace(found, F.lit(entry), F.lit(""))), F.lit(""))


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS as seconds."""
    part = lambda k: F.split_part(text, F.lit(":"), F.lit(k)).cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)
