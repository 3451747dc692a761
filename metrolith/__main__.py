"""python -m metrolith index|audit|rotation: the window index of a folder of charts, the round trip of its texts, or a check of
the index's rotations; for spark-submit."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith import config
from metrolith.operators import augment, metrics, parse, windows
from metrolith.plans import charts as plans
from metrolith.sources import charts, materialise, store


def index(spark: SparkSession, args: argparse.Namespace) -> str:
    """The folder of a store with windows, rejected, errors and excluded, brought up to date: only charts that are new, or of
    which a file changed, are compiled. Other settings, another level, stride or catalogue are a store of their own."""
    settings = config.Config(window=replace(config.Window(), train_stride_sec=args.stride))
    w = windows.Windows(settings.window.prefix_start_sec, settings.window.target_start_sec, settings.window.target_end_sec, args.stride, features=settings.window.feature_frames)
    found = charts.scan(spark, args.charts, args.features)
    # A feature file has a header of 128 bytes and rows of `width` numbers of `bytes` bytes.
    frames = F.floor((F.col("feature_size") - 128) / (args.width * args.bytes)).cast("long")
    catalogue = charts.catalogue(spark, args.catalogue) if args.catalogue else None

    def build(changed: DataFrame) -> dict[str, DataFrame]:
        texts = charts.texts(spark, args.charts).join(changed.select("chart"), "chart", "left_semi")
        made = plans.build_index(texts, changed.select("chart", frames.alias("feature_frames")), catalogue, args.level, w, fail_fast=args.fail_fast)
        return {"windows": made.windows, "rejected": made.rejected, "errors": made.errors, "excluded": made.excluded}

    version = charts.catalogue_version(catalogue) if catalogue is not None else None
    key = json.dumps({"settings": asdict(settings), "stride": args.stride, "level": args.level, "catalogue": version})
    out = store.Store(spark, f"{args.out}/{materialise.key(key)}")
    out.update(found, build, settings)
    return out.root


def rotation(spark: SparkSession, args: argparse.Namespace) -> None:
    """Checks that the sequences of an index turn as they should: by none and by eight they stay, by one eight times they come
    back, the centre stays, and each turn is read without a repair."""
    rows = spark.read.parquet(args.windows).select("tokens")
    if args.limit:
        rows = rows.limit(args.limit)
    bad = augment.unsound_rotations(rows).first()
    if bad:
        raise SystemExit(f"turned by {bad['steps']}: {bad['reason']}: {bad['tokens']}")
    print("rotation: all as it should be")


def audit(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tables extremes, errors, changed (charts whose text isn't the same after tokens) and batch (all charts together) under
    args.out."""
    texts = charts.texts(spark, args.charts)
    parsed = parse.parse(texts)
    metrics.extremes(parsed.frames).write.mode("overwrite").parquet(f"{args.out}/extremes")
    parsed.errors.write.mode("overwrite").parquet(f"{args.out}/errors")
    plans.round_trip(texts).where("not same").write.mode("overwrite").parquet(f"{args.out}/changed")
    changed = spark.read.parquet(f"{args.out}/changed").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    batch = plans.batch_audit(texts, round_trips=False).unionAll(changed.select(F.lit("charts"), F.lit("changed"), "n", none, none))
    batch.write.mode("overwrite").parquet(f"{args.out}/batch")


def _level(text: str) -> int:
    if not 0 <= (n := int(text)) <= 6:
        raise argparse.ArgumentTypeError("a level is 0 to 6")
    return n


def _above_zero(text: str) -> float:
    if not 0 < (x := float(text)) < float("inf"):
        raise argparse.ArgumentTypeError("must be above 0")
    return x


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="metrolith", description=__doc__)
    kinds = out.add_subparsers(dest="kind", required=True)
    turned = kinds.add_parser("rotation")
    turned.add_argument("--windows", required=True)
    turned.add_argument("--limit", type=int, default=0)
    for name in ("index", "audit"):
        one = kinds.add_parser(name)
        one.add_argument("--charts", required=True)
        one.add_argument("--out", required=True)
        if name == "index":
            one.add_argument("--features", required=True)
            one.add_argument("--catalogue")
            one.add_argument("--level", type=_level, default=5)
            one.add_argument("--stride", type=_above_zero, default=config.Window().train_stride_sec)
            one.add_argument("--width", type=int, default=768)
            one.add_argument("--bytes", type=int, default=2, choices=(2, 4))
            one.add_argument("--fail-fast", action="store_true")
    return out


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.kind == "index":
        print(index(spark, args))
    elif args.kind == "rotation":
        rotation(spark, args)
    else:
        audit(spark, args)


if __name__ == "__main__":
    main()
