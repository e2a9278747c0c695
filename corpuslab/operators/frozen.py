"""Frozen datasets and checkpoints: load them only if they are what was recorded."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import fingerprint
from corpuslab.operators.dedup import keep_first
from corpuslab.schemas import CHECKPOINT
from corpuslab.sources.sinks import write_document

AGREEMENT = 1e-3


def load_frozen(spark: SparkSession, rows: DataFrame, split_path: str, manifest_path: str, key: str, text: str, label: str, cols: list[str]) -> DataFrame:
    """First rows with their recorded split; raises with every difference from the manifest."""
    kept = keep_first(rows, text, key)
    assigned = kept.join(spark.read.parquet(split_path).select(F.col("row_id").alias(key), "split"), key, "left")
    if n := assigned.filter("split is null").count():
        raise ValueError(f"{n} rows without a split")
    if errors := fingerprint.verify(fingerprint.load(manifest_path), fingerprint.split(assigned, key, label, cols)):
        raise ValueError("; ".join(errors))
    return assigned


def save_checkpoint(path: str, experiment: str, seed: int, best_epoch: int, best_metric_value: float, checkpoint_file: str, model_architecture: dict | None = None, metric: str = "val_macro_f1") -> dict:
    """Write the record of a checkpoint, with its architecture and time. Checkpoints are chosen by ``val_macro_f1`` and nothing else."""
    if metric != "val_macro_f1":
        raise ValueError(f"checkpoints are chosen by val_macro_f1, not {metric}")
    values = (experiment, seed, best_epoch, metric, best_metric_value, checkpoint_file, model_architecture or {}, datetime.now(timezone.utc).isoformat())
    record = dict(zip(CHECKPOINT.fieldNames(), values))
    write_document(record, path)
    return record


def verify_checkpoint(record_path: str, path: str) -> list[str]:
    """What is wrong with a checkpoint and its record, which may be missing or broken."""
    try:
        record = json.loads(Path(record_path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return [f"{record_path} is missing", *[e for e in checkpoint_errors({}, path) if path in e]]
    except ValueError as e:
        return [f"{record_path} is broken: {e}"]
    if gone := [k for k in CHECKPOINT.fieldNames() if k not in record]:
        return [f"{record_path} lacks {gone}"]
    return checkpoint_errors(record, path)


def checkpoint_errors(record: dict, path: str, metric: str = "val_macro_f1") -> list[str]:
    """What is wrong with a checkpoint record and its file."""
    p, errors = Path(path), []
    if not p.is_file():
        errors.append(f"{path} is missing")
    elif not p.stat().st_size:
        errors.append(f"{path} is empty")
    if record.get("monitor_metric") != metric:
        errors.append(f"monitor_metric is {record.get('monitor_metric')!r}, not {metric!r}")
    if not isinstance(record.get("best_epoch"), int) or record["best_epoch"] < 1:
        errors.append("best_epoch must be 1 or more")
    v = record.get("best_metric_value")
    if not isinstance(v, (int, float)) or not 0 <= v <= 1:
        errors.append("best_metric_value must be in [0, 1]")
    return errors


def run_errors(record: dict, manifest: dict, history_best: float, max_epochs: int, files: list[str]) -> list[str]:
    """What is wrong with a finished run: dataset, epochs, agreement of the recomputed metric, files."""
    errors = []
    if record.get("dataset_version") != manifest.get("dataset_content_sha256"):
        errors.append("dataset_version is not the manifest's")
    if not 1 <= record.get("best_epoch", 0) <= record.get("epochs_run", 0) <= max_epochs:
        errors.append("epochs outside the budget")
    if abs(record.get("val_macro_f1", -1) - history_best) > AGREEMENT:
        errors.append("recomputed val_macro_f1 disagrees with the history")
    errors += [f"{f} is missing" for f in files if not Path(f).exists()]
    return errors


def verify_all(checks: dict[str, Callable[[], list[str] | DataFrame | None]]) -> None:
    """Run named checks, each giving errors as a list or as a frame with one row per error (None: none), and raise with all of them
    at once. A check that raises counts as one error, so that the others still run."""
    found = []
    for name, check in checks.items():
        try:
            got = check()
            found += [f"{name}: {e}" for e in (got if isinstance(got, list) else [] if got is None else [str(r.asDict()) for r in got.collect()])]
        except Exception as e:  # noqa: BLE001
            found.append(f"{name}: {type(e).__name__}: {e}")
    if found:
        raise ValueError("\n".join(found))


def project_errors(root: str, files: list[str], config: dict, expected: dict[str, object]) -> list[str]:
    """Missing files of a project, and values of its configuration (``section.key``) that aren't the expected ones."""
    errors = [f"{f} is missing" for f in files if not (Path(root) / f).exists()]
    for key, want in expected.items():
        have: object = config
        for k in key.split("."):
            have = have.get(k) if isinstance(have, dict) else None
        if have != want:
            errors.append(f"{key} is {have!r}, not {want!r}")
    return errors
