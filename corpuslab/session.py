"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_ROOTS: dict[str, list] = {}


def get_session(app: str = "corpuslab", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that every plan here counts on: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.appName(app).master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session may do without it and gets a
    temporary folder; on a cluster a folder of one machine would be lost with it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="corpuslab-")
    return "file://" + _LOCAL_DIRS[app]


class Stage:
    """Tables written to the shared folder to cut lineage. ``put`` writes a frame once and returns it as read
    from storage, so that neither a lost executor nor a second use computes it again; ``drop`` deletes what
    later steps no longer need."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: set[str] = set()

    def put(self, df: DataFrame, label: str = "t", codec: str | None = None) -> DataFrame:
        path = f"{self.root}/{self._n:03d}-{label}"
        self._n += 1
        df.write.mode("overwrite").parquet(path, compression=codec)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stage_path = path  # type: ignore[attr-defined]
        self._paths.add(path)
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            self._paths.discard(path)
            self._delete(path)

    def only(self, *kept: DataFrame) -> None:
        """Delete all tables but these, which the result will be read from."""
        for path in self._paths - {getattr(df, "_stage_path", None) for df in kept}:
            self._delete(path)
        self._paths &= {getattr(df, "_stage_path", None) for df in kept}

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages(spark: SparkSession) -> int:
    """Delete all stage tables of this application, once the results that were read from them are written. Returns how many
    folders there were."""
    stages = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for s in stages:
        s._delete(s.root)
    return len(stages)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    import pathlib
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="corpuslab-ship-")) / "corpuslab.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))


_SHIPPED: set[str] = set()
