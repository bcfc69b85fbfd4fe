"""Frame, time code and level arithmetic (Column -> Column); integers wherever values allow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timecode_frames(code: Column, rate: Column) -> Column:
    """``HH:MM:SS:FF`` (non-drop) to frames at a nominal rate; anything else raises."""
    part = [F.split(code, ":")[k].cast("long") for k in range(4)]
    value = ((part[0] * 60 + part[1]) * 60 + part[2]) * rate + part[3]
    return F.when(code.rlike(r"^\d+:\d+:\d+:\d+$"), value).otherwise(F.raise_error(F.concat(F.lit("not a time code: "), code)).cast("long"))


def nominal_rate(num: Column, den: Column) -> Column:
    return F.round(num / den).cast("long")


def first_frame(ms: Column, num: Column, den: Column) -> Column:
    """The frame at or before a time that is not negative, on integers."""
    return F.call_function("div", ms * num, den * 1000)


def end_frame(ms: Column, num: Column, den: Column) -> Column:
    """The frame at or after a time that is not negative, on integers."""
    return F.call_function("div", ms * num + den * 1000 - 1, den * 1000)


def frame_range(start_ms: Column, end_ms: Column, num: Column, den: Column) -> tuple[Column, Column]:
    """Floor in, ceiling out, at least one frame."""
    first, last = first_frame(start_ms, num, den), end_frame(end_ms, num, den)
    return first, F.when(last <= first, first + 1).otherwise(last)


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Into [low, high]; low wins if they are the wrong way round."""
    return F.greatest(low, F.least(x, high))


def decibels(x: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(x, F.lit(1e-10)))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by 96 Euclid steps, enough for any two longs."""
    state = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), state, step, lambda s: s["x"])


def rational(frames: Column, num: Column, den: Column) -> Column:
    """Frames as reduced seconds, ``a/bs``, ``as`` or ``0s``."""
    top = frames * den
    g = gcd(top, num)
    whole = F.concat((top / g).cast("long").cast("string"), F.lit("s"))
    part = F.concat((top / g).cast("long").cast("string"), F.lit("/"), (num / g).cast("long").cast("string"), F.lit("s"))
    return F.when(frames == 0, "0s").when((num / g) == 1, whole).otherwise(part)


def orientation(width: Column, height: Column, rotation: Column) -> Column:
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.when(F.when(turned, width).otherwise(height) > F.when(turned, height).otherwise(width), "short").otherwise("long")
