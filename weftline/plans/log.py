"""Logging to the console and a daily file, errors with their place, and progress by observed metrics."""

from __future__ import annotations

import logging
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def setup(level: str = "INFO", folder: str | None = None, day: date | None = None) -> logging.Logger:
    """A logger on standard output and, with a folder, on its file of the day."""
    log = logging.getLogger("weftline")
    log.setLevel(level)
    log.handlers.clear()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder) / f"log_{day or date.today():%Y-%m-%d}.log", encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log


class JobError(Exception):
    """An error with the file and line where its cause was raised."""

    def __init__(self, message: str, cause: BaseException | None = None):
        place, at = "", cause.__traceback__ if cause else None
        while at is not None:
            place, at = f" ({at.tb_frame.f_code.co_filename}:{at.tb_lineno})", at.tb_next
        super().__init__(f"{message}: {cause}{place}" if cause else message)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with a running count of its rows and failures, to be read after the action that consumes it."""
    watch = Observation(name)
    failures = F.count_if(F.col("error").isNotNull()) if "error" in df.columns else F.lit(0)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), (failures if "error" in df.columns else F.sum(failures)).alias("failures")), watch
