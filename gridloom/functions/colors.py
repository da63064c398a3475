"""Colour maps and RGB composition as Columns of channel values 0 to 255."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import RasterException
from gridloom.operators.aggregate import class_condition

Color = tuple[int, int, int, int]


def hex_to_rgba(text: str, alpha: int = 255) -> Color:
    """Channels of a hex colour of 1, 2, 3 or 6 digits, which repeat until there are six."""
    digits = text.lstrip("#")
    if len(digits) not in (1, 2, 3, 6) or not re.fullmatch("[0-9A-Fa-f]+", digits):
        raise RasterException(f"Cannot read colour {text!r}.")
    red, green, blue = bytes.fromhex(digits * (6 // len(digits)))
    return red, green, blue, alpha


def hex_columns(text: Column, alpha: int = 255) -> list[Column]:
    """r, g, b, a of a column of hex colours; NULL channels where ``hex_to_rgba`` would be an error."""
    digits = F.regexp_replace(text, "^#+", "")
    whole = F.when(digits.rlike("^([0-9A-Fa-f]{1,3}|[0-9A-Fa-f]{6})$"), F.substring(F.repeat(digits, 6), 1, 6))
    return [F.conv(F.substring(whole, k, 2), 16, 10).cast("int").alias(c) for k, c in ((1, "r"), (3, "g"), (5, "b"))] + [F.lit(alpha).alias("a")]


def channel(norm: Column, start: float, stop: float, over: float | None = None) -> Column:
    """A channel between two colours, by way of a third one at the middle if given."""
    if over is None:
        return norm * (stop - start) + start
    return F.when(norm < 0.5, norm * 2 * (over - start) + start).otherwise((norm * 2 - 1) * (stop - over) + over)


def to_byte(value: Column) -> Column:
    """Truncated and wrapped to 0..255, as unsigned bytes are."""
    return F.pmod(value.cast("bigint"), F.lit(256)).cast("int")


def continuous(value: Column, low: float, high: float, start: Color, stop: Color = (1, 1, 1, 255), over: Color | None = None, masked: bool = True) -> list[Column]:
    """r, g, b, a of values between two colours; outside the range, and for nodata, transparent."""
    norm = (value - low) / (high - low)
    channels = [to_byte(channel(norm, start[k], stop[k], over[k] if over else None)).alias(c) for k, c in enumerate("rgb")]
    seen = (norm >= 0) & (norm <= 1) if masked else (norm > 0) & (norm < 1)
    return [F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(channels, "rgb", strict=True)] + [F.when(F.coalesce(seen, F.lit(False)), 255).otherwise(0).alias("a")]


def discrete(value: Column, colormap: dict[str, Color]) -> list[Column]:
    """r, g, b, a of values by class; of overlapping classes the later one wins, no class is transparent."""
    out = [F.lit(0)] * 4
    for expression, color in colormap.items():
        hit = class_condition(expression, value, masked=True)
        out = [F.when(hit, color[k]).otherwise(out[k]) for k in range(4)]
    return [c.alias(n) for c, n in zip(out, "rgba", strict=True)]


def rgb_channel(value: Column, low: float, high: float) -> Column:
    """A band clipped to the scale and stretched by 255 / high."""
    return (F.lit(255.0) * (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / high).cast("bigint").cast("int")


def compose(red: Column, green: Column, blue: Column) -> list[Column]:
    """r, g, b and an alpha that is 0 where any channel is 0 or nodata."""
    parts = [F.coalesce(c, F.lit(0)) for c in (red, green, blue)]
    clear = (parts[0] == 0) | (parts[1] == 0) | (parts[2] == 0)
    return [p.alias(n) for p, n in zip(parts, "rgb", strict=True)] + [F.when(clear, 0).otherwise(255).alias("a")]


def brightness(value: Column, factor: float) -> Column:
    return F.least(F.greatest(value * factor, F.lit(0.0)), F.lit(255.0)).cast("int")


def saturation(red: Column, green: Column, blue: Column, factor: float) -> list[Column]:
    """r, g, b between the pixel's grey (0) and its colour (1), or beyond."""
    grey = F.floor((red * 299 + green * 587 + blue * 114) / 1000)
    return [F.least(F.greatest(grey + (c - grey) * factor, F.lit(0.0)), F.lit(255.0)).cast("int").alias(n) for c, n in ((red, "r"), (green, "g"), (blue, "b"))]


def contrast(value: Column, mean: Column, factor: float) -> Column:
    return F.least(F.greatest(mean + (value - mean) * factor, F.lit(0.0)), F.lit(255.0)).cast("int")
