"""Tables by chart that are brought up to date chart by chart, and read for some charts without opening the files of others.

A store has for each table of a build one Parquet table, laid out by generation and by bucket of charts, and a manifest with
the fingerprint of what each chart was made from. An update compares the sources with the manifest by an anti-join, builds
only charts that are new or changed, and appends these as a generation; charts that are gone get a row that says so. The
pointer that names the generation is written last: until then, and if the job is lost, readers see what was there before. Of
a chart the newest generation counts. compact() writes what counts as one generation, from which readers then start.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith import config as C
from metrolith.sources.shared import cut

MANIFEST = "chart string, fingerprint string, gone boolean, generation string, bucket int"
POINTER = "generation string, number long, whole boolean, config string, made timestamp"


@dataclass(frozen=True)
class Store:
    """root: a folder that all executors share. buckets: folders that the charts of a generation are dealt to."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read
            return (reader.schema(schema) if schema else reader).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return None

    def bucket(self, chart) -> object:
        return F.pmod(F.xxhash64(chart.cast("string")), F.lit(self.buckets)).cast("int")

    def generations(self) -> list:
        """The pointers that count, oldest first; one row for each update since the last compact()."""
        pointers = self._read("pointers", POINTER)
        rows = sorted(pointers.collect(), key=lambda r: (r["number"], r["made"], r["generation"])) if pointers is not None else []
        first = max((i for i, r in enumerate(rows) if r["whole"]), default=0)
        return rows[first:]

    def manifest(self) -> DataFrame:
        """chart, fingerprint, generation, bucket of every chart that is there."""
        pointers = self.generations()
        read = self._read("manifest", MANIFEST)
        if read is None or not pointers:
            return self.spark.createDataFrame([], "chart string, fingerprint string, generation string, bucket int")
        names = [r["generation"] for r in pointers]
        number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("generation"))
        newest = read.where(F.col("generation").isin(names)).withColumn("number", number).groupBy("bucket", "chart").agg(F.max_by(F.struct("fingerprint", "gone", "generation"), "number").alias("m"))
        return newest.where("not m.gone").select("chart", "m.fingerprint", "m.generation", "bucket")

    def read(self, table: str, charts: DataFrame | list[str] | None = None, settings: C.Config | None = None) -> DataFrame:
        """The current rows of a table, of all charts or of some, with `generation` and `bucket`. A list of charts prunes the
        files when the query is planned, a table (chart) when it runs. settings: those of this run; where the store was made
        with others that must agree, an error."""
        pointers = self.generations()
        if not pointers:
            raise ValueError(f"{self.root}: nothing was built")
        if settings is not None:
            for made in {r["config"] for r in pointers}:
                if odd := C.same_for_inference(C.load(json.loads(made)), settings):
                    raise ValueError(f"{self.root} was made with other settings: {', '.join(odd)}")
        rows = self.spark.read.parquet(f"{self.root}/{table}").where(F.col("generation").isin([r["generation"] for r in pointers]))
        known = self.manifest()
        if isinstance(charts, list):
            named = self.spark.createDataFrame([(c,) for c in charts], "chart string")
            wanted = [r[0] for r in named.select(self.bucket(F.col("chart"))).distinct().collect()]  # as many as the list at most
            rows, known = (d.where(F.col("bucket").isin(wanted) & F.col("chart").isin(charts)) for d in (rows, known))
        elif charts is not None:
            some = charts.select(F.col("chart").cast("string").alias("chart")).distinct().withColumn("bucket", self.bucket(F.col("chart")))
            known = known.join(some, ["bucket", "chart"], "left_semi")
        return rows.join(known.select("chart", "bucket", "generation"), ["bucket", "generation", "chart"], "left_semi")

    def fingerprints(self, sources: DataFrame) -> DataFrame:
        """chart, fingerprint, bucket: the digest of all that is known of a chart's sources."""
        known = F.md5(F.to_json(F.struct(*sorted(c for c in sources.columns if c != "chart"))))
        return sources.select(F.col("chart").cast("string").alias("chart"), known.alias("fingerprint")).withColumn("bucket", self.bucket(F.col("chart")))

    def _write(self, name: str, table: DataFrame, generation: str) -> None:
        """Files by bucket; a bucket that holds very much is more than one file."""
        own = table.withColumn("chart", F.col("chart").cast("string")).withColumn("bucket", self.bucket(F.col("chart"))).withColumn("generation", F.lit(generation))
        own.hint("rebalance", "bucket").write.mode("append").partitionBy("generation", "bucket").parquet(f"{self.root}/{name}")

    def _point(self, generation: str, whole: bool, settings: str) -> None:
        numbers = [r["number"] for r in self.generations()]
        row = self.spark.range(1).select(F.lit(generation).alias("generation"), F.lit(max(numbers, default=0) + 1).cast("long").alias("number"), F.lit(whole).alias("whole"), F.lit(settings).alias("config"), F.current_timestamp().alias("made"))
        row.write.mode("append").parquet(f"{self.root}/pointers")

    def update(self, sources: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], settings: C.Config = C.Config()) -> str | None:
        """Brings the store up to date with sources (chart and what may change of it) and gives the new generation; None if
        nothing changed. build gets the rows of sources to build, and gives tables with a column `chart`. A chart that a
        table has no rows of has none there from then on."""
        sources = cut(sources)  # looked at once: a file that changes meanwhile is newer than its fingerprint, and is built again next time
        now, then = self.fingerprints(sources), self.manifest()
        changed = now.join(then, ["bucket", "chart", "fingerprint"], "left_anti")
        gone = then.join(now, ["bucket", "chart"], "left_anti")
        if changed.isEmpty() and gone.isEmpty():
            return None
        generation = f"gen-{uuid.uuid4().hex}"
        todo = sources.join(changed.select("chart"), sources["chart"].cast("string") == changed["chart"], "left_semi")
        for name, table in build(todo).items():
            self._write(name, table, generation)
        told = changed.select("chart", "fingerprint", F.lit(False).alias("gone")).unionAll(gone.select("chart", "fingerprint", F.lit(True)))
        self._write("manifest", told, generation)
        self._point(generation, False, C.as_json(settings))
        return generation

    def compact(self, tables: list[str]) -> str:
        """What counts of these tables, all that the store has, as one generation that readers start from."""
        pointers = self.generations()
        generation = f"gen-{uuid.uuid4().hex}"
        for name in tables:
            self._write(name, self.read(name).drop("generation", "bucket"), generation)
        self._write("manifest", self.manifest().select("chart", "fingerprint", F.lit(False).alias("gone")), generation)
        self._point(generation, True, pointers[-1]["config"])
        return generation
