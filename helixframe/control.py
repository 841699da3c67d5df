"""Steps with their times, logging, and the stages as views for SQL."""

from __future__ import annotations

import logging
import logging.handlers
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("helixframe")


@contextmanager
def step(name: str) -> Iterator[None]:
    """Logs how long the block took; an error is logged with the step's name and goes on."""
    began = time.monotonic()
    try:
        yield
    except Exception:
        log.exception("%s failed after %.1f s", name, time.monotonic() - began)
        raise
    log.info("%s: %.1f s", name, time.monotonic() - began)


class _Marks(logging.Formatter):
    """Level as a mark in front of the message."""

    marks = {logging.DEBUG: ".", logging.INFO: "-", logging.WARNING: "!", logging.ERROR: "x", logging.CRITICAL: "x"}

    def format(self, record: logging.LogRecord) -> str:
        return f"{self.marks.get(record.levelno, ' ')} {super().format(record)}"


def set_up_logging(path: str | None = None, verbose: bool = False, most_bytes: int = 10 << 20, kept: int = 3) -> logging.Logger:
    """Messages to the console, and with ``path`` to a file that is rolled at ``most_bytes``, ``kept`` old ones kept."""
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=most_bytes, backupCount=kept))
    for h in log.handlers[:]:
        log.removeHandler(h)
        h.close()
    for h in handlers:
        h.setFormatter(_Marks("%(asctime)s %(message)s"))
        log.addHandler(h)
    return log


def register_views(tables: dict[str, DataFrame]) -> SparkSession:
    """Every table as a temporary view of its name, for ``spark.sql``; gives the session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return next(iter(tables.values())).sparkSession


def guarded(steps: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Runs named steps in order, timed; the first that fails raises."""
    out = {}
    for name, f in steps.items():
        with step(name):
            out[name] = f()
    return out
