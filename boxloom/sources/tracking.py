"""A log of runs as plain Parquet tables: runs, params, metrics, artifacts. Every write appends."""

from __future__ import annotations

import math
import re
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from boxloom.operators import compare

RUN_FILE = "run_id.txt"


def _clean(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_./ -]", "_", str(name).strip())


class Tracker:
    """With enabled off every call does nothing and gives None."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True) -> None:
        self.spark, self.root, self.enabled = spark, root.rstrip("/"), enabled

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def start(self, experiment: str, params: dict, run_dir: str | None = None) -> str | None:
        """A new run's id, kept in the run's folder too; parameters that are no scalars are left out."""
        if not self.enabled:
            return None
        run = uuid.uuid4().hex
        self._append("runs", [(run, experiment, time.time())], "run_id string, experiment string, started double")
        flat = [(run, str(k), str(v)) for k, v in params.items() if v is None or isinstance(v, (str, int, float, bool))]
        self._append("params", flat, "run_id string, name string, value string")
        if run_dir:
            Path(run_dir).mkdir(parents=True, exist_ok=True)
            Path(run_dir, RUN_FILE).write_text(run, encoding="utf-8")
        return run

    def run_of(self, run_dir: str, strict: bool = False) -> str | None:
        """The id kept in a run's folder; without one None, or with strict an error."""
        p = Path(run_dir, RUN_FILE)
        if p.exists():
            return p.read_text(encoding="utf-8").strip()
        if strict:
            raise FileNotFoundError(f"no run id in {run_dir}")
        return None

    def metrics(self, run: str | None, values: dict, step: int | None = None) -> None:
        """Finite numbers, also written as text, under their clean names; other values are left out."""
        if not self.enabled or run is None:
            return
        rows = []
        for k, v in values.items():
            try:
                x = float(v)
            except (TypeError, ValueError):
                continue
            if math.isfinite(x):
                rows.append((run, step, _clean(k), x))
        self._append("metrics", rows, "run_id string, step bigint, metric string, value double")

    def table(self, metrics: DataFrame) -> None:
        """(run_id, step, metric, value) of any size, values as text."""
        if self.enabled:
            compare.loggable(metrics).write.mode("append").parquet(f"{self.root}/metrics")

    def log_table(self, run: str | None, name: str, rows: DataFrame) -> None:
        """Rows of any form, as a table of its own for each name and run."""
        if self.enabled and run is not None:
            rows.write.mode("append").parquet(f"{self.root}/tables/{_clean(name)}/run_id={run}")

    def artifacts(self, run: str | None, path: str) -> None:
        """A file, or all files of a folder, by name and size."""
        if not self.enabled or run is None:
            return
        p = Path(path)
        files = [p] if p.is_file() else sorted(x for x in p.rglob("*") if x.is_file())
        self._append("artifacts", [(run, str(f.relative_to(p.parent)), f.stat().st_size) for f in files], "run_id string, path string, bytes bigint")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def sync_history(self, run_dir: str, csv: str) -> None:
        """A training CSV brought into the log of the run in run_dir, which must have an id."""
        from boxloom.sources.files import read_history

        run = self.run_of(run_dir, strict=True)
        if self.enabled:
            read_history(self.spark, csv, run).write.mode("append").parquet(f"{self.root}/metrics")
