"""Where operators keep tables between steps, and small helpers that all of them use."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder is set on one machine (as in tests), and on a cluster it's an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df, written once as Parquet in the shared folder: a lost executor costs no more than the tasks that read it."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def numbered(docs: DataFrame, names: list[str] | tuple[str, ...]) -> tuple[list[Column], list[StructField]]:
    """Columns of docs as _0, _1 and so on, and their fields: under names of their own they clash with nothing on their way through an operator."""
    fields = [docs.schema[n] for n in names]
    return [F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)], [StructField(f"_{i}", f.dataType, True) for i, f in enumerate(fields)]


def renamed(found: DataFrame, names: list[str] | tuple[str, ...]) -> list[Column]:
    """The numbered columns under their names again."""
    return [found[f"_{i}"].alias(n) for i, n in enumerate(names)]


def with_fields(fields: list[StructField], ddl: str) -> StructType:
    """Fields, and those of a DDL string after them."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def give_back() -> None:
    """Returns memory that this process no longer uses to the system: Arrow's pool and the C library's heap keep it otherwise, and a worker that serves several stages adds up what each of them needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What workers hold from task to task (tables of encoded pieces), each a dict.
HELD: list[dict] = []


def held() -> dict:
    """A dict that a worker keeps from task to task of operators that use it; tasks of other operators empty it, so that what one stage has gathered doesn't weigh on the next."""
    HELD.append({})
    return HELD[-1]


def let_go() -> None:
    """Empties what this worker holds. A function of this module, so that it is the worker's own that a task calls."""
    for table in HELD:
        table.clear()


def released(run, keeps: bool = False):
    """A function of mapInArrow that gives memory back before and after its task; keeps: it uses what is held()."""

    def own(batches):
        if not keeps:
            let_go()
        give_back()
        yield from run(batches)
        give_back()

    return own


def parts(df: DataFrame) -> int:
    """As many partitions as the session's shuffles have."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def set_up(spark: SparkSession, rows: int = 2000) -> None:
    """What these operators need of a session; each calls it, and only the first call changes anything. Users who want other values set them before.

    Arrow batches hold whole texts: Spark's default of 10,000 rows a batch takes several times the memory in executors and their Python, so that default becomes `rows`. Executors' Python finds this package by the root that
    is added to its PYTHONPATH, where driver and executors share a file system.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH", "")]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
