"""Settings as text."""

from __future__ import annotations

import re

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str | None, default: float) -> float:
    """A duration: 0 for off, whole numbers are seconds, else numbers with units (1h30m); blank or wrong gives the default."""
    raw = (text or "").strip()
    if not raw:
        return default
    if raw.lower() in ("0", "off", "false", "no"):
        return 0.0
    if raw.isascii() and raw.isdigit():
        return float(raw)
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", raw)
    return sum(float(n) * _UNITS[u] for n, u in parts) if parts and "".join(n + u for n, u in parts) == raw else default
