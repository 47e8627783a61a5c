"""Scalar expressions on columns: labels, durations, ids, scores, texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from momentlens.profiles import NARRATION_HIGH, NARRATION_LOW, NARRATION_MIDDLE


def segment_label(i: Column) -> Column:
    """A..Z, then AA, AB and so on; beyond 701 the first character runs past Z."""
    letter = lambda k: F.char(k + 65)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))


def human_duration(seconds: Column) -> Column:
    """45s, 2m05s, 1h02m; fractions of a second are cut."""
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%02ds", minutes, s % 60))
        .otherwise(F.format_string("%dh%02dm", hours, minutes % 60))
    )


def chunk_id(source: Column, start: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over source and start to one decimal."""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), F.format_string("%.1f", start.cast("double"))), 256), 1, 16)


def collection_name(prefix: str, model: Column) -> Column:
    """A store's name for a model: signs to underscores, lower case, at most 63 characters."""
    return F.left(F.concat(F.lit(f"{prefix}_"), F.lower(F.translate(model, "/-", "__"))), F.lit(63))


def backend_of(model: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The first backend whose substring the model's name has."""
    out = F.lit(default)
    for part, name in reversed(rules):
        out = F.when(F.lower(model).contains(part), F.lit(name)).otherwise(out)
    return out


def rating_tier(score: Column, high: float = 0.6, medium: float = 0.4) -> Column:
    return F.when(score > high, "high").when(score > medium, "medium").otherwise("low")


def strongest(named: Sequence[tuple[str, Column]]) -> Column:
    """The name of the largest column; the first one wins a tie."""
    out = F.lit(None).cast("string")
    top = F.greatest(*[c for _, c in named]) if len(named) > 1 else named[0][1]
    for name, c in reversed(named):
        out = F.when(c == top, F.lit(name)).otherwise(out)
    return out


def reasons(named: Sequence[tuple[str, Column]], fallback: Column, above: float = 0.5) -> Column:
    """Texts of all columns above a threshold, or the fallback alone."""
    found = F.filter(F.array(*[F.when(c > above, F.format_string(f"{name} (%.2f)", c)) for name, c in named]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def intensity(score: Column, low: float = 0.3, width: float = 0.4) -> Column:
    """Score scaled into [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / width))


#: The meter's colours for quiet, middling and intense segments.
METER_COLOURS = ("#2a9d8f", "#f4a261", "#e63946")


def meter(score: Column) -> Column:
    """percent (a whole number, halves up), width in percent and colour of an intensity meter."""
    n = intensity(score)
    quiet, middling, intense = METER_COLOURS
    colour = F.when(n > 0.7, intense).when(n > 0.4, middling).otherwise(quiet)
    return F.struct(F.floor(n * 100 + 0.5).cast("long").alias("percent"), (n * 100).alias("width"), colour.alias("colour"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, n: int = 6) -> Column:
    """``n`` decimals as DuckDB rounds them: the product with 10^n as it is in binary, not the shortest decimal of ``x``. They differ where that ends in a five: 0.5146875 is stored a bit lower."""
    return F.round(x * 10.0**n) / 10.0**n


def side(x: Column, left: float = 0.4, right: float = 0.6) -> Column:
    return F.when(x < left, "left").when(x > right, "right").otherwise("center")


def letter_sum(text: Column) -> Column:
    """Sum of the code points of a text."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc + F.ascii(c))


def pick(options: Sequence[str], at: Column) -> Column:
    """The option at a number, wrapped round."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(at, F.lit(len(options))) + 1).cast("int"))


def narration(score: Column, label: Column) -> Column:
    """A line by score and by the letters of the label."""
    at = letter_sum(label)
    return F.when(score > 0.55, pick(NARRATION_HIGH, at)).when(score > 0.4, pick(NARRATION_MIDDLE, at)).otherwise(pick(NARRATION_LOW, at))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def suffix(path: Column) -> Column:
    """The extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def rational(text: Column) -> Column:
    """The value of `num/den` or of a plain number; null for a zero denominator."""
    parts = F.split(text, "/")
    den = F.coalesce(F.get(parts, 1).cast("double"), F.lit(1.0))
    return F.when(den != 0, F.get(parts, 0).cast("double") / den)


def interpolated(x: Column, knots: Sequence[tuple[float, float]], clamp_left: bool = False, clamp_right: bool = False) -> Column:
    """Piecewise linear through knots; beyond them the outer piece goes on unless that side is clamped."""
    pieces = list(zip(knots, knots[1:], strict=False))
    line = lambda a, b: F.lit(float(a[1])) + (x - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))
    out = line(*pieces[-1])
    for a, b in reversed(pieces[:-1]):
        out = F.when(x <= b[0], line(a, b)).otherwise(out)
    if clamp_left:
        out = F.when(x < knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)
    if clamp_right:
        out = F.when(x > knots[-1][0], F.lit(float(knots[-1][1]))).otherwise(out)
    return out


def spring(frame: Column, fps: float, damping: float = 10.0, stiffness: float = 100.0, mass: float = 1.0) -> Column:
    """A damped oscillator from 0 to 1, in closed form; approximates an animation library's easing."""
    t = F.greatest(frame, F.lit(0)) / F.lit(float(fps))
    zeta, omega = damping / (2 * (stiffness * mass) ** 0.5), (stiffness / mass) ** 0.5
    if zeta < 1:
        w = omega * (1 - zeta**2) ** 0.5
        return 1 - F.exp(-zeta * omega * t) * (F.cos(w * t) + (zeta * omega / w) * F.sin(w * t))
    return 1 - F.exp(-omega * t) * (1 + omega * t)
