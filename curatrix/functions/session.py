"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def session(name: str = "curatrix", cores: str = "*", **config: str) -> SparkSession:
    """A session with the settings that these jobs are made for; a cluster's own come first."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (defaults | config).items():
        builder = builder.config(k, v)
    if "spark.master" not in config:
        builder = builder.master(f"local[{cores}]")
    return builder.getOrCreate()


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share. Only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/curatrix/{tag}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, as only then Spark drops the shuffles and broadcasts of what is gone; then let the JVM
    give back the native memory that its C library keeps free for the hundreds of threads of Spark's plans.

    A JVM that can't (not HotSpot, before 17.0.9, not on Linux) keeps it, and nothing else changes.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with suppress(Py4JError):
        kinds, what = new(jvm.Class, 4), new(jvm.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(kind)
        what[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        what[1], what[2], what[3] = "systemTrimNativeHeap", new(jvm.Object, 0), new(jvm.String, 0)
        invoke = jvm.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), what)


@dataclass
class Tables:
    """What one piece of work has written to cut lineage: folders, and names in the catalog."""

    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def release(self, spark: SparkSession) -> None:
        """Delete them, and let Spark drop the shuffles of what is gone. For callers whose results that read them are written."""
        for name in self.names:
            spark.sql(f"drop table if exists `{name}`")
        jvm = spark.sparkContext._jvm
        for path in map(jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths, self.names = [], []
        tidy(spark)


_COLLECTING: ContextVar[Tables | None] = ContextVar("tables", default=None)


@contextmanager
def collecting() -> Iterator[Tables]:
    """The tables that are written within, in this thread; tables of an inner ``collecting`` are its own."""
    own = Tables()
    token = _COLLECTING.set(own)
    try:
        yield own
    finally:
        _COLLECTING.reset(token)


def note(path: str, name: str | None = None) -> None:
    """Tell whoever is collecting of a table."""
    if (own := _COLLECTING.get()) is not None:
        own.paths.append(path)
        if name:
            own.names.append(name)


def cut(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage: a table in the shared folder that the cluster names, read back."""
    path = fresh_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
