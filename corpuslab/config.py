"""Configuration documents and the environment of a run."""

from __future__ import annotations

import json
import logging
import os
import platform
import subprocess
import sys
from dataclasses import dataclass, field
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("dataset", "cleaning", "split")


@dataclass(frozen=True)
class CorpusConfig:
    """What of a corpus is read, cleaned and split, and how. Wrong values are an error at once."""

    text_column: str
    label_column: str
    labels: tuple[str, ...]
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)
    seed: int = 42
    max_len: int = 256
    max_features: int = 20_000
    dropout: float = 0.0
    learning_rate: float = 1e-3
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if abs(sum(self.ratios) - 1) > 1e-9 or min(self.ratios) <= 0:
            raise ValueError(f"ratios {self.ratios} must be positive and sum to 1")
        if not self.labels or len(set(self.labels)) != len(self.labels):
            raise ValueError("labels must be given once each")
        if self.max_len < 1 or self.max_features < 2:
            raise ValueError("max_len and max_features must be positive")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout must be in [0, 1)")
        if self.learning_rate <= 0:
            raise ValueError("learning_rate must be positive")


#: Kinds of embedding layers.
EMBEDDINGS = ("random", "glove")


@dataclass(frozen=True)
class RecurrentConfig:
    """Settings of a recurrent model whose predictions are evaluated here. All that is wrong with them is one error."""

    experiment: str
    vocab_size: int
    output_classes: int
    classes: int
    embedding_dim: int = 100
    max_len: int = 128
    units: int = 64
    embedding: str = "random"
    learning_rate: float = 1e-3
    layers: int = 1
    dropouts: tuple[float, ...] = ()
    experiments: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        errors = [f"{k} must be positive" for k in ("vocab_size", "embedding_dim", "max_len", "units", "learning_rate") if getattr(self, k) <= 0]
        if self.experiments and self.experiment not in self.experiments:
            errors.append(f"experiment {self.experiment} is none of {self.experiments}")
        if self.output_classes != self.classes:
            errors.append(f"output_classes must be {self.classes}")
        if self.embedding not in EMBEDDINGS:
            errors.append(f"embedding must be one of {EMBEDDINGS}")
        if not 1 <= self.layers <= 3:
            errors.append("layers must be 1 to 3")
        if not all(0 <= d < 1 for d in self.dropouts):
            errors.append("dropouts must be in [0, 1)")
        if errors:
            raise ValueError("; ".join(errors))


def run_id(experiment: str, seed: int, at: datetime | None = None) -> str:
    """Experiment, seed and time in UTC to the second."""
    return f"{experiment}_seed{seed}_{(at or datetime.now(timezone.utc)).astimezone(timezone.utc):%Y%m%dT%H%M%SZ}"


def duration_s(started: str, ended: str) -> float:
    """Seconds between two times in ISO form."""
    return round((datetime.fromisoformat(ended) - datetime.fromisoformat(started)).total_seconds(), 2)


def from_document(d: dict) -> CorpusConfig:
    if missing := [s for s in SECTIONS if s not in d]:
        raise ValueError(f"missing sections: {missing}")
    need = {"dataset": ("text_column", "label_column", "labels"), "split": ("train_val_test", "seed")}
    if gone := [f"{s}.{k}" for s, ks in need.items() for k in ks if k not in d[s]]:
        raise ValueError(f"missing keys: {gone}")
    return CorpusConfig(d["dataset"]["text_column"], d["dataset"]["label_column"], tuple(d["dataset"]["labels"]), tuple(d["split"]["train_val_test"]), d["split"]["seed"])


def load(path: str) -> CorpusConfig:
    return from_document(json.loads(Path(path).read_text(encoding="utf-8")))


def current(configs: DataFrame) -> CorpusConfig:
    """The row of a table of configurations that is marked as current; exactly one must be."""
    rows = configs.filter("is_current").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("exactly one configuration must be current")
    return from_document(rows[0].asDict(recursive=True))


def environment(spark: SparkSession) -> dict:
    """Versions, commit and settings of this run; what can't be found is null."""

    def git(*a: str) -> str | None:
        try:
            r = subprocess.run(["git", *a], capture_output=True, text=True, timeout=10)
            return r.stdout.strip() if r.returncode == 0 else None
        except (OSError, subprocess.TimeoutExpired):
            return None

    def version(p: str) -> str | None:
        try:
            return metadata.version(p)
        except metadata.PackageNotFoundError:
            return None

    dirty = git("status", "--porcelain")
    return {
        "captured_at": datetime.now(timezone.utc).isoformat(),
        "python": sys.version.split()[0],
        "platform": platform.platform(),
        "spark": spark.version,
        "parallelism": spark.sparkContext.defaultParallelism,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "git_commit": git("rev-parse", "HEAD"),
        "git_dirty": None if dirty is None else bool(dirty),
        "cpus": os.cpu_count(),
        "master": spark.sparkContext.master,
        "settings": dict(spark.sparkContext.getConf().getAll()),
        "packages": {p: version(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")},
    }


def logger(name: str = "corpuslab", level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(h)
    log.setLevel(level)
    return log
