"""Column helpers for seconds, timecodes, shares and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.mmm; below zero and null count as zero."""
    s = F.greatest(F.lit(0.0), F.coalesce(seconds.cast("double"), F.lit(0.0)))
    return F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def timecode_of_ms(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded to milliseconds first."""
    ms = F.bround(F.greatest(F.lit(0.0), F.coalesce(seconds.cast("double"), F.lit(0.0))) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def human_duration(seconds: Column) -> Column:
    s = F.bround(F.greatest(F.lit(0.0), seconds.cast("double"))).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(seconds.isNull(), "").when(h > 0, F.format_string("%d h %02d min", h, m)).when(m > 0, F.format_string("%d min %02d s", m, s % 60)).otherwise(F.format_string("%d s", s))


def share(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to even; nothing of nothing is zero."""
    return F.bround(100 * part / F.greatest(whole, F.lit(1))).cast("long")


def decade(year: Column) -> Column:
    number = year.cast("string").try_cast("int")
    return F.coalesce(F.concat((F.floor(number / 10) * 10).cast("string"), F.lit("s")), F.lit(""))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))


def clusters_in(start: Column, end: Column, length: float, most: int) -> Column:
    """Array of (start, end) windows of a span: one, or several of a given length, evenly begun."""
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    long = F.greatest(end - start, F.lit(0.04))
    n = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(long / length).cast("int")))
    last = F.greatest(start, end - length)
    begun = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(start + (last - start) * i / (n - 1), 3))
    made = F.transform(begun, lambda s: F.struct(s.alias("start"), F.bround(F.least(s + length, end), 3).alias("end")))
    made = F.array_distinct(F.filter(made, lambda w: w["end"] - w["start"] >= 0.35))
    return F.when((long <= length * 1.35) | (F.lit(most) == 1) | (F.size(made) == 0), whole).otherwise(made)


def evenly(n: Column, k: int) -> Column:
    """Positions (from 0) of k items spread over n, first and last among them."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int")))
    return F.when(n <= k, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(some)


def frame_times(start: Column, end: Column) -> Column:
    """Three moments of a shot at which frames are taken."""
    return F.transform(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda f: F.bround(F.greatest(start, F.least(start + (end - start) * f, end - 0.04)), 3))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)
