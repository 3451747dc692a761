"""Lookup with fallbacks: by id, else by title and exact levels if unique, else by title and rounded level names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.functions import durations as D

#: The place of the first level that a catalogue lists.
FIRST_LEVEL = 2


def fallback_name(level: Column) -> Column:
    value = D.number(level)
    return F.when(value == 13.0, "13").when(value == 13.5, "13+").otherwise(level)


def _local_key(local: Column, listed_size: Column, fallback: bool) -> Column:
    """What of a chart's levels (entries of key and value, in order) lies within a list of that size: the keys and the names."""
    own = F.filter(local, lambda e: (e["key"] >= FIRST_LEVEL) & (e["key"] - FIRST_LEVEL < listed_size))
    return F.transform(own, lambda e: F.struct(e["key"].alias("key"), (fallback_name(e["value"]) if fallback else e["value"]).alias("name")))


def _met(forms: DataFrame, catalogue: DataFrame, song: Column, fallback: bool, name: str) -> DataFrame:
    """title, local and `name`, the only song whose listed levels are those of the form; of two or more songs, none.

    A song fits if all levels that both have are named alike, and there is one. That is met by equality, not pair by pair: for
    each size of list of a title and each set of keys that its charts have within it, the names there are the key."""
    sizes = catalogue.where(F.size("level") > 0).select("title", F.size("level").alias("size")).distinct()
    asked = forms.join(sizes, "title").select("title", "local", "size", _local_key(F.col("local"), F.col("size"), fallback).alias("key"))
    asked = asked.where((F.size("key") > 0) & F.forall("key", lambda e: e["name"].isNotNull())).withColumn("keys", F.col("key.key"))
    sets = asked.select("title", "size", "keys").distinct()
    rows = catalogue.select("title", F.size("level").alias("size"), "level", song.alias("s")).join(sets, ["title", "size"])
    at = F.transform("keys", lambda k: F.struct(k.alias("key"), F.get("level", k - FIRST_LEVEL).alias("name")))
    listed = rows.select("title", "size", at.alias("key"), "s").groupBy("title", "size", "key").agg(F.count("*").alias("n"), F.any_value("s").alias("s"))
    met = asked.select("title", "local", "size", "key").join(listed, ["title", "size", "key"])
    return met.groupBy("title", "local").agg(F.sum("n").alias("n"), F.any_value("s").alias(name)).where("n = 1").drop("n")


def match(charts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """charts (chart, title, short_id, local_levels ..) with song_id, song (the catalogue's row or null).

    catalogue: id, title, level, ds, basic_info; of rows with one id the first by title counts. Charts of one title and the
    same local levels are looked up once. Spark picks how to join; a small catalogue is broadcast by its measured size.
    Charts without an id are dealt over tasks, as a join by id would bring them all to one."""
    song = F.struct(*[F.col(f"`{c}`") for c in catalogue.columns])
    by_id = catalogue.where("id is not null").groupBy(F.col("id").cast("string").alias("short_id")).agg(F.min_by(song, "title").alias("by_id")).withColumn("__deal", F.lit(0))
    told = charts.withColumns({"local": F.array_sort(F.map_entries("local_levels")), "__deal": F.when(F.col("short_id").isNull(), F.pmod(F.xxhash64("chart"), F.lit(4096)).cast("int")).otherwise(0)})
    forms = told.where("title is not null and size(local) > 0").select("title", "local").distinct()
    by_title = _met(forms, catalogue, song, False, "by_level").join(_met(forms, catalogue, song, True, "by_name"), ["title", "local"], "full")
    found = told.join(by_id, ["short_id", "__deal"], "left").join(by_title, ["title", "local"], "left")
    chosen = F.coalesce("by_id", "by_level", "by_name")
    return found.select(*charts.columns, chosen["id"].alias("song_id"), chosen.alias("song"))


def without_genre(matched: DataFrame, genre: str) -> DataFrame:
    """Rows whose song is of another genre, or unknown."""
    return matched.where(F.coalesce(F.col("song.basic_info.genre") != genre, F.lit(True)))


def level_values(levels: DataFrame, matched: DataFrame) -> DataFrame:
    """levels with level_query from the song's list where it has one for that level."""
    listed = F.try_element_at("ds", (F.col("level") - FIRST_LEVEL + 1).cast("int"))
    ds = matched.where("song is not null").select("chart", F.col("song.ds").alias("ds"))
    value = F.when(F.col("level") >= FIRST_LEVEL, F.coalesce(listed, F.col("level_query"))).otherwise(F.col("level_query"))
    return levels.join(ds, "chart", "left").withColumn("level_query", value).drop("ds")


def sound(charts: DataFrame, audio: DataFrame, features: DataFrame, errors: DataFrame) -> DataFrame:
    """charts with `reason`, the first of: no audio, no features, parse error; null for those that are sound."""
    has = lambda df, name: df.select("chart").distinct().withColumn(name, F.lit(True))
    told = charts.join(has(audio, "__audio"), "chart", "left").join(has(features, "__features"), "chart", "left").join(has(errors, "__error"), "chart", "left")
    reason = F.when(F.col("__audio").isNull(), "no audio").when(F.col("__features").isNull(), "no features").when(F.col("__error").isNotNull(), "parse error")
    return told.withColumn("reason", reason).drop("__audio", "__features", "__error")


def pending(wanted: DataFrame, done: DataFrame, key: str = "chart", signature: str = "signature") -> DataFrame:
    """What is wanted and isn't done with the same signature."""
    return wanted.join(done.select(key, signature), [key, signature], "left_anti")
