"""Materialised tables that know what they were made from, and are made again only when that changes.

Each build writes a generation of its own; a pointer row names the current one, and is written last, so a reader or a lost
job never sees half a build. Everything is read and written by Spark, so any store that Spark knows will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "generation string, config string, made timestamp"


def key(config: str) -> str:
    """The folder of a configuration (a JSON text): the start of its digest."""
    canonical = json.dumps(json.loads(config), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()[:16]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def current(spark: SparkSession, root: str, config: str) -> str | None:
    """The folder of the newest generation, or None."""
    pointers = _read(spark, f"{root}/{key(config)}/pointers")
    newest = pointers.orderBy(F.col("made").desc(), "generation").first() if pointers is not None else None
    return f"{root}/{key(config)}/{newest['generation']}" if newest else None


def is_current(spark: SparkSession, folder: str | None, sources: DataFrame) -> bool:
    """Whether a generation was made from exactly these source rows."""
    made = _read(spark, f"{folder}/sources") if folder else None
    if made is None or set(made.columns) != set(sources.columns):
        return False
    made = made.select(*sources.columns)
    return sources.exceptAll(made).isEmpty() and made.exceptAll(sources).isEmpty()


def ensure(spark: SparkSession, root: str, config: str, sources: DataFrame, build: Callable[[], dict[str, DataFrame]]) -> str:
    """The folder of a generation made from `sources`: the current one, or a new one with a table for each that build gives."""
    folder = current(spark, root, config)
    if is_current(spark, folder, sources):
        return folder
    generation = f"gen-{uuid.uuid4().hex}"
    folder = f"{root}/{key(config)}/{generation}"
    for name, table in build().items():
        table.write.parquet(f"{folder}/{name}")
    sources.write.parquet(f"{folder}/sources")
    pointer = spark.range(1).select(F.lit(generation).alias("generation"), F.lit(config).alias("config"), F.current_timestamp().alias("made"))
    pointer.write.mode("append").parquet(f"{root}/{key(config)}/pointers")
    return folder
