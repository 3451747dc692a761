"""Sources of charts: whole text files with their fingerprints, met with what else a song needs; the song catalogue."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHART_FILE, AUDIO_FILE = "maidata.txt", "track.mp3"
CATALOGUE = "id string, title string, level array<string>, ds array<double>, basic_info struct<genre:string>"


def _folder(path: Column, root: str) -> Column:
    name = F.regexp_replace(path, r"^file:/+", "/")
    return F.regexp_replace(F.regexp_replace(name, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", ""), r"/?[^/]*$", "")


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """folder (under root), path, size, modified of all files of that name, without their contents."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return read.select(_folder(F.col("path"), root).alias("folder"), "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def feature_name(folder: Column) -> Column:
    """The name of a song's feature file: the digest of the chart's relative path."""
    return F.concat(F.md5(F.concat_ws("/", F.when(folder != "", folder), F.lit(CHART_FILE))), F.lit(".npy"))


def scan(spark: SparkSession, charts: str, features: str) -> DataFrame:
    """chart, folder, feature, and size and modified of the three files: the charts that have audio and features."""
    chart = files(spark, charts, CHART_FILE).select("folder", F.col("size").alias("chart_size"), F.col("modified").alias("chart_modified"))
    audio = files(spark, charts, AUDIO_FILE).select("folder", F.col("size").alias("audio_size"), F.col("modified").alias("audio_modified"))
    made = files(spark, features, "*.npy").select(F.element_at(F.split("path", "/"), -1).alias("feature"), F.col("size").alias("feature_size"), F.col("modified").alias("feature_modified"))
    named = chart.withColumn("feature", feature_name(F.col("folder")))
    return named.join(audio, "folder").join(made, "feature").withColumn("chart", F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), F.lit(CHART_FILE)))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """chart (its path under root), text: a row for each file, whatever its size."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", CHART_FILE).text(root, wholetext=True)
    folder = _folder(F.col("_metadata.file_path"), root)
    return read.select(F.concat_ws("/", F.when(folder != "", folder), F.lit(CHART_FILE)).alias("chart"), F.col("value").alias("text"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The songs of a JSON list; no rows if the file is missing or isn't such a list."""
    try:
        read = spark.read.schema(CATALOGUE).option("multiLine", "true").json(path)
    except AnalysisException:
        return spark.createDataFrame([], CATALOGUE)
    return read.where("id is not null")


def catalogue_version(songs: DataFrame) -> str:
    """A digest of the songs, whatever their order: each row's digest, then these in order. A catalogue is small."""
    row = F.sha2(F.to_json(F.struct(*sorted(songs.columns))), 256).alias("d")
    return songs.select(row).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256)).first()[0]


def write_texts(charts: DataFrame, folder: str) -> None:
    """A folder for each chart with its text; charts that couldn't be written (null text) are left out."""
    charts.where("text is not null").select("chart", "text").write.mode("overwrite").partitionBy("chart").text(folder)


def save(charts: DataFrame, folder: str) -> DataFrame:
    """Writes for each chart a folder of its own under `folder` with its text and a copy of its audio file. charts: chart (a
    relative path), text, audio (the file's address, or null). Gives chart, text_path and audio_path of what was written when
    it is read; a chart without text is left out. Addresses are any that pyarrow opens and all executors share. A file gets
    its name when it is whole, so a lost task leaves none half written, and one that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(folder)

        def put(path: str, write) -> None:
            target.create_dir(path.rpartition("/")[0], recursive=True)
            draft = f"{path}.{uuid.uuid4().hex}"
            with target.open_output_stream(draft) as out:
                write(out)
            target.move(draft, path)

        def copy(address: str, out: pa.NativeFile) -> None:
            store, path = fs.FileSystem.from_uri(address)
            with store.open_input_stream(path) as given:
                while part := given.read(1 << 22):
                    out.write(part)

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                home = f"{root.rstrip('/')}/{row['chart'].strip('/')}"
                text, audio = f"{home}/{CHART_FILE}", None
                put(text, lambda out, row=row: out.write(row["text"].encode()))
                if row["audio"]:
                    audio = f"{home}/{row['audio'].rpartition('/')[2]}"
                    put(audio, lambda out, row=row: copy(row["audio"], out))
                rows.append((row["chart"], text, audio))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["chart", "text_path", "audio_path"])

    some = charts.where("text is not null").select(F.col("chart").cast("string").alias("chart"), "text", F.col("audio").cast("string").alias("audio"))
    return some.mapInArrow(run, "chart string, text_path string, audio_path string")
