"""One entry point for all text formats."""

from __future__ import annotations

from buslens.sources.busmaster import read_busmaster
from buslens.sources.candump import read_candump
from buslens.sources.css import read_css
from buslens.sources.detect import detect_format
from buslens.sources.generic import read_generic
from buslens.sources.lines import ParsedLog
from buslens.sources.peak import read_peak_trc

READERS = {
    "candump": read_candump,
    "busmaster": read_busmaster,
    "peak": read_peak_trc,
    "css": read_css,
    "generic": read_generic,
}


def read_log(spark, path, fmt: str | None = None) -> ParsedLog:
    """Read files of one format; without fmt the format is detected and must be the same and unique."""
    if fmt is None:
        found = detect_format(spark, path).groupBy("status", "format").count().collect()
        if len(found) != 1 or found[0]["status"] != "ok":
            seen = sorted(f"{r['status']}:{r['format']}" for r in found)
            raise ValueError(f"log format is not unique and known: {', '.join(seen)}")
        fmt = found[0]["format"]
    return READERS[fmt](spark, path)
