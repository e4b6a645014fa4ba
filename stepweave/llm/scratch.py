"""Intermediate tables in the folder that every executor shares.

Multi-step operators cut lineage by writing a table and reading it back, so
that a lost executor costs the recomputation of one step at most.  The folder
is the session's ``spark.checkpoint.dir``; only where that is unset (local
tests) a folder of this machine is made.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="stepweave-")
    return _own[app]


class Scratch:
    """Tables of one operator call, kept as Parquet under the shared folder.

    Spark removes the shuffle files of a finished step only once the driver has
    collected the garbage that refers to them, so each written table asks for that.

    A call's last tables stay until the driver's Python ends, because the frame
    that the call returns still reads them; ``drop`` removes earlier ones.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/stepweave-{uuid.uuid4().hex}"
        _made.append((spark, self.root))

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` once and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Tables of operators called inside are deleted at the end, when what is wanted of them has been written elsewhere."""
    before = len(_made)
    yield
    for spark, root in _made[before:]:
        _delete(spark, root)
    del _made[before:]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, root in _made:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
