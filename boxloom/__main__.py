"""python -m boxloom COMMAND: the runs of plans/commands.py from a shell."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boxloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> None:
        c = sub.add_parser(name)
        for o, kind in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", **kind)

    need, text = {"required": True}, {}
    number = lambda v: {"type": type(v), "default": v}
    command("prepare", source=need, out=need, train=number(0.75), val=number(0.15), test=number(0.10), seed=number(42))
    command("validate", images=text, annotations=need, strict={"action": "store_true"})
    command("analyse", annotations=need, out={"default": "reports/dataset_analysis"}, small_max=number(0.01), medium_max=number(0.05))
    command("tile", annotations=need, out=need, patch=number(640), overlap=number(0.20), min_visible=number(0.30), keep_all_negative={"action": "store_true"}, negative_ratio=number(0.50), seed=number(42))
    command("convert", out=need, mode={"choices": ["hardlink", "symlink", "copy"], "default": "hardlink"}, **{f"{s}_{k}": text for s in ("train", "val", "test") for k in ("images", "annotations")})
    command("merge", patch_annotations=need, predictions=need, out=need, iou=number(0.5), max_detections=number(300))
    command("evaluate", gt=need, pred=need, out=need, conf=number(0.25), iou=number(0.50))
    command("compare", metrics={"nargs": "+", "required": True}, out={"default": "reports/comparison"})
    command("log", metrics=need, run_dir=need, tracking=need)
    command("run", gt=need, predictions={"nargs": "+", "required": True, "metavar": "MODEL=FILE"}, out=need, conf=number(0.25), iou=number(0.50), dry_run={"action": "store_true"})
    command("environment")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from boxloom.plans import commands as C
    from boxloom.plans import jobs

    if a.command == "environment":
        print(json.dumps(jobs.environment(), indent=2))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"boxloom-{a.command}").getOrCreate()
    if a.command == "prepare":
        print(json.dumps(C.prepare_export(spark, a.source, a.out, {"train": a.train, "val": a.val, "test": a.test}, a.seed), ensure_ascii=False, indent=2))
    elif a.command == "validate":
        found, ok = C.validate(spark, a.images, a.annotations, a.strict)
        for r in C.quality.messages(found).orderBy("severity", "rule", "entity_id").collect():
            print(f"[{r.severity}] {r.rule} {r.entity} {r.entity_id} {r.detail or ''}")
        return 0 if ok else 1
    elif a.command == "analyse":
        print(json.dumps(C.analyse(spark, a.annotations, a.out, a.small_max, a.medium_max), ensure_ascii=False, indent=2))
    elif a.command == "tile":
        images, boxes = C.tile(spark, a.annotations, a.out, patch=a.patch, overlap=a.overlap, min_visible=a.min_visible, negative_ratio=a.negative_ratio, seed=a.seed, keep_all=a.keep_all_negative)
        print(f"tiles: {images.count()}, annotations: {boxes.count()}")
    elif a.command == "convert":
        splits = {s: (getattr(a, f"{s}_images"), getattr(a, f"{s}_annotations")) for s in ("train", "val", "test") if getattr(a, f"{s}_annotations")}
        C.convert(spark, splits, a.out, a.mode)
    elif a.command == "merge":
        print(f"merged detections: {C.merge(spark, a.patch_annotations, a.predictions, a.out, a.iou, a.max_detections)}")
    elif a.command == "evaluate":
        print(json.dumps(C.measure(spark, a.gt, a.pred, a.out, a.conf, a.iou), ensure_ascii=False, indent=2))
    elif a.command == "log":
        print(f"metrics logged: {C.log_evaluation(spark, a.metrics, a.run_dir, a.tracking)}")
    elif a.command == "run":
        files = dict(p.split("=", 1) for p in a.predictions)
        done = {m: f"{a.out}/{m}/metrics.json" for m in files}
        actions = {f"{m}:evaluate": lambda m=m: C.measure(spark, a.gt, files[m], done[m], a.conf, a.iou) for m in files}
        actions["compare"] = lambda: C.compare_experiments(spark, list(done.values()), f"{a.out}/comparison")
        for name in jobs.execute(jobs.plan(list(files), convert=False, train=False, predict=False, actions=actions), a.dry_run):
            print(name)
    else:
        C.compare_experiments(spark, a.metrics, a.out).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
