"""Numeric options that callers may give as numbers or text."""

from __future__ import annotations

import math


def option(value: object, limits: tuple[float, float, float], whole: bool = False) -> float:
    """``value`` within ``limits`` (default, lowest, highest); the default where it is missing or no number. ``whole`` cuts numbers off
    and takes text only if it is a whole number."""
    default, lowest, highest = limits
    try:
        if whole:
            number = int(value) if isinstance(value, str) else math.trunc(value)
        else:
            number = float(value)
            if math.isnan(number):
                number = default
    except (TypeError, ValueError, OverflowError):
        number = default
    return max(lowest, min(number, highest))
