"""Shared building blocks: words, shingles, scratch tables, size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Written tables after which the driver's JVM collects its garbage.
_COLLECT_EVERY = 8
#: Percent of the heap that the JVM leaves free when it resizes it after a collection: 10 at least, 25 at most.
_FREE_RATIOS = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "25"}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Scratch:
    """Intermediate tables as Parquet in the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives lost executors; the shuffle files of its query are removed
    when it ends. Where the setting is absent a temporary folder of this machine is used, and removed when Python ends,
    but only under a local master: on a cluster the executors wouldn't share it, so that is an error.

    The driver keeps the plans and broadcasts of ended queries until its garbage is collected, for which its JVM first takes
    all the heap it may; so every few tables are followed by ``release``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            local = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            root = f"file://{local}"
        self.root = f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: set[str] = set()

    def write(self, df: DataFrame, partitions: int | None = None, by: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        if partitions:
            df = df.coalesce(partitions)
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        if self.count % _COLLECT_EVERY == 0:
            release(self.spark)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
            self.paths.discard(df._scratch_path)

    def drop_part(self, df: DataFrame, by: str, value: int) -> None:
        """Delete the rows of a table written ``by`` a column that have a value; reads must leave them out from then on."""
        part = self.spark._jvm.org.apache.hadoop.fs.Path(f"{df._scratch_path}/{by}={value}")
        part.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(part, True)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these, which a result still reads."""
        held = {df._scratch_path for df in frames}
        for path in sorted(self.paths - held):
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)
        self.paths = held


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage and give what it took back to the system.

    By default the heap stays at 3.3 times what is in use, and the C library keeps the memory that compilers and ended
    threads freed. A JVM without these options or commands only collects.
    """
    jvm = spark._jvm

    def array(kind: str, *values: object) -> object:
        out = spark.sparkContext._gateway.new_array(getattr(jvm.java.lang, kind), len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    # the server's own class isn't public: its method is called by the interface
    named = jvm.java.lang.Class.forName
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    method = named("javax.management.MBeanServer").getMethod("invoke", array("Class", *map(named, kinds)))
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()

    def invoke(bean: str, operation: str, *values: str) -> None:
        of = array("Object", *values), array("String", *["java.lang.String"] * len(values))
        with suppress(Py4JError):
            method.invoke(server, array("Object", jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation, *of))

    for option, percent in _FREE_RATIOS.items():
        invoke("HotSpotDiagnostic", "setVMOption", option, percent)
    jvm.System.gc()
    invoke("DiagnosticCommand", "systemTrimNativeHeap")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same, and much faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def words(text: Column, lower: bool = False) -> Column:
    """The maximal runs of characters other than space and U+0009..U+000D; none for null.

    A split at a single plain character is much faster than one at a regular expression.
    """
    text = F.coalesce(text, F.lit(""))
    text = ascii_lower(text) if lower else text
    for c in SEPARATORS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, wherever the optimizer moves the expression.

    A projected column doesn't give that: a filter pushed below it takes the whole expression along,
    and inside a lambda it would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(tokens: Column, k: int) -> Column:
    """64-bit hashes of all k-word shingles in order; a shorter text is one shingle; null for no words."""

    def roll(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, hashes).when(n > 0, F.array(F.xxhash64(w)))

    return let(tokens, roll)


def keyed(df: DataFrame, ids: DataFrame, key: str | list[str], how: str, limit: int = 1_000_000) -> DataFrame:
    """Semi or anti join with ``ids``: sent to all executors up to ``limit`` rows, shuffled beyond."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, how)


def fresh(columns: list[str], name: str) -> str:
    """A name that starts so and that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    return next(n for n in (f"{name}{i}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def by_value(module_name: str) -> None:
    """Send a module's functions to Python workers by value: workers need not have the library installed."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def id_remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus
