"""Column expressions with the scalar semantics the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Banker's rounding."""
    return F.bround(x, digits)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two numeric arrays, in double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_mask(v: Column, size: int) -> Column:
    """Bit i is set where element i is positive; up to 63 elements."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get(v, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two bit masks, 0 for two empty ones."""
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, 0.0).otherwise(F.bit_count(a.bitwiseAND(b)) / union)


def flip_byte_rows(mask: Column) -> Column:
    """An 8 x 8 bit mask with each row of eight bits reversed."""
    out = mask
    for shift, low in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        keep = F.lit(low)
        out = F.shiftrightunsigned(out, shift).bitwiseAND(keep).bitwiseOR(F.shiftleft(out.bitwiseAND(keep), shift))
    return out


def natural_key(name: Column) -> Column:
    """Sorts page2 before page10, and page2 before page002."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "\u0000$1\u0000")
    parts = F.transform(F.split(padded, "\u0000"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p))
    return F.struct(parts.alias("parts"), F.length(name).alias("zeros"), name.alias("name"))


#: The seven steps from C, and semitones of an alteration sign.
STEPS = ("C", "D", "E", "F", "G", "A", "B")


def pitch_of(position: Column, top_line_step: int, top_line_octave: int) -> tuple[Column, Column]:
    """Step and octave of a staff position counted downward from the top line (0)."""
    index = F.lit(top_line_octave * 7 + top_line_step) - position
    return F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.pmod(index, F.lit(7)) + 1).cast("int")), F.floor(index / 7).cast("int")


def softmax_confidence(distance: Column, temperature: float, over) -> Column:
    """exp(-d / T) over its sum in a window."""
    weight = F.exp(-distance / temperature)
    return weight / F.sum(weight).over(over)


def open_set(nearest: Column, second: Column, ratio: float, margin: float) -> Column:
    """Accept when the nearest distance is small against the separation and its margin is wide enough."""
    return (nearest / second <= ratio) & ((second - nearest) / second >= margin)
