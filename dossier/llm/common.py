"""What the operators of this subpackage share: reading, shipping code to executors, cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that cross to Python at a time: texts may be long, and a batch is held whole on both sides.
ROWS = 512
#: Seconds between two collections of the driver's garbage.
RELEASE_S = 5.0
#: A key with more than one in HOT of all rows is hot, so there are at most HOT of them.
HOT = 1000

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it there; and see to it
    that no more than ROWS texts cross to them at a time."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    if getattr(sc, "_dossier_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(), "dossier_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("dossier", os.path.relpath(full, root)))
    sc.addPyFile(at)
    sc._dossier_shipped = True


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that gives a worker's freed memory back at the end, since workers live on between stages."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Collect this process's garbage and give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only on one machine where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(spark.sparkContext, "_dossier_shared", None)
        if at is None:
            at = "file://" + tempfile.mkdtemp(prefix="dossier-shared-")
            spark.sparkContext._dossier_shared = at
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends here, and a lost executor costs only the reread.

    The table goes when the application ends, or by `discard` where no lazy result needs it any more. In a folder of file://
    Hadoop starts several processes (chmod) for each file and its checksum file; these tables do without the latter.
    """
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    plain = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    df.write.options(**plain).parquet(at)
    fs, path = _place(df.sparkSession, at)
    fs.deleteOnExit(path)
    _written(df.sparkSession).append(at)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._dossier_at = at
    return out


def release(spark: SparkSession, now: bool = False) -> None:
    """Collect the driver's garbage, every few seconds at most unless `now`: shuffle files and broadcasts of ended jobs go when
    the objects that stand for them are collected, and a driver whose heap is far from full may not do that for long. What its
    two processes have freed outside the heap (compiler arenas, the many threads of ended exchanges) goes back to the system."""
    sc = spark.sparkContext
    if now or time.monotonic() - getattr(sc, "_dossier_released", 0.0) > RELEASE_S:
        give_back()
        sc._jvm.System.gc()
        _trim_jvm(spark)
        sc._dossier_released = time.monotonic()


def _trim_jvm(spark: SparkSession) -> None:
    """malloc_trim in the driver's JVM, by its diagnostic command; a JVM without that command goes on as it is."""
    sc = spark.sparkContext
    if not getattr(sc, "_dossier_trims", True):
        return
    jvm, array = sc._jvm, sc._gateway.new_array
    try:
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = array(jvm.Object, 0), array(jvm.String, 0)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        sc._dossier_trims = False


def _written(spark: SparkSession) -> list[str]:
    """Places of the tables that `cut` has written in this application and nobody has deleted."""
    sc = spark.sparkContext
    if not hasattr(sc, "_dossier_written"):
        sc._dossier_written = []
    return sc._dossier_written


def _place(spark: SparkSession, at: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def discard(*tables: DataFrame, at_once: bool = False) -> None:
    """Delete tables that `cut` has returned, once what was made of them is written; with `at_once`, ended jobs' shuffle files too."""
    places = [t._dossier_at for t in tables if hasattr(t, "_dossier_at")]
    if tables:
        _delete(tables[0].sparkSession, places)
    if at_once:
        release(tables[0].sparkSession, True)


def _delete(spark: SparkSession, places: list[str]) -> None:
    written = _written(spark)
    for at in places:
        if at in written:
            fs, path = _place(spark, at)
            fs.delete(path, True)
            written.remove(at)


def in_turn(stage: Callable) -> Callable:
    """A stage (spark, docs, sf_dir) of a pipeline whose results are written before the next stage is called: each call deletes
    the tables that the call before it has left behind for its lazy result."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        read = docs.inputFiles() if getattr(sc, "_dossier_left", None) else []
        _delete(spark, [at for at in getattr(sc, "_dossier_left", []) if not any(x.startswith(at) or x.startswith(at.replace("file://", "file:", 1)) for x in read)])
        release(spark, True)
        before = set(_written(spark))
        out = stage(spark, docs, sf_dir)
        sc._dossier_left = [at for at in _written(spark) if at not in before]
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def hot_keys(rows: DataFrame, key: str, least: int = 500) -> DataFrame | None:
    """(key, __hot) of the keys with more than one in HOT of all rows, and more than `least`; None if there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    if not total or most * HOT <= total or most <= least:
        return None
    return counts.filter((F.col("__n") * HOT > total) & (F.col("__n") > least)).select(key, F.lit(True).alias("__hot"))


def join_salted(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame | None, parts: int = 64) -> DataFrame:
    """Inner join with one row of `side` for each key; rows of hot keys are dealt to `parts` tasks, to which side's rows are copied."""
    if hot is None:
        return rows.join(side, key)
    hot = F.broadcast(hot)  # bounded: HOT keys
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(parts)).cast("int")).otherwise(0)
    copies = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.join(hot, key, "left").withColumn("__part", part).drop("__hot")
    return dealt.join(side.join(hot, key, "left").withColumn("__part", copies).drop("__hot"), [key, "__part"]).drop("__part")


def join_by_key(rows: DataFrame, side: DataFrame, key: str, weight: str) -> DataFrame:
    """`rows` left-joined with `side` (one row for each key, with the number `weight` of rows of that key).

    A key with more than one in HOT of all rows would meet in one task; there are at most HOT such keys, so they are joined
    by broadcast and only the others are dealt out by key.
    """
    total, most = side.agg(F.sum(weight), F.max(weight)).first()
    if not total or most * HOT <= total:
        return rows.join(side.drop(weight), key, "left")
    hot = side.filter(F.col(weight) * HOT > total)
    warm = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side.filter(F.col(weight) * HOT <= total).drop(weight), key, "left")
    return warm.unionByName(rows.join(F.broadcast(hot.drop(weight)), key))
