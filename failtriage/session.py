"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


# Small tables on one machine: use all cores although there are few bytes per core.
LOCAL_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.openCostInBytes": "64k",
}


#: Share of the driver's largest heap from which garbage is collected between steps.
HEAP_SHARE = 0.4
#: Seconds between two calls that give free native memory back; one may take some tenths of a second.
TRIM_SECONDS = 10.0
_trimmed = {"at": float("-inf")}


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("failtriage")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **LOCAL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on, such as splitting of hot join partitions, in a session of any origin."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    Taken from ``spark.checkpoint.dir``; a folder of our own is made only when
    that is unset and Spark runs on this machine alone.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="failtriage-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown past ``HEAP_SHARE`` of what it may take.

    What a finished step leaves (plans, their texts, task reports) is several
    times what is alive, and the heap keeps all room that it once had: a query
    of many steps would fill the limit, however little it needs. A whole
    collection gives that room back, and lets Spark remove the shuffles and
    broadcasts of finished steps. Now and then the C allocator gives back as well
    what the compiler and the buffers of many threads have freed.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        spark._jvm.java.lang.System.gc()
        if time.monotonic() - _trimmed["at"] > TRIM_SECONDS:
            trim(spark)
            _trimmed["at"] = time.monotonic()


def trim(spark: SparkSession) -> bool:
    """Give the system what the driver's C allocator holds free, and say whether this Java can do so.

    It is the command ``System.trim_native_heap`` within the process. Its class is
    not open to callers, so it is called as its public interface.
    """
    lang, bean = spark._jvm.java.lang, "javax.management."
    array = spark.sparkContext._gateway.new_array
    types, arguments = array(lang.Class, 4), array(lang.Object, 4)
    for i, name in enumerate((f"{bean}ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = lang.Class.forName(name)
    try:
        arguments[0] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        arguments[1] = "systemTrimNativeHeap"
        beans = lang.management.ManagementFactory.getPlatformMBeanServer()
        lang.Class.forName(f"{bean}MBeanServerConnection").getMethod("invoke", types).invoke(beans, arguments)
    except Py4JError:
        return False
    return True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Several consumers then read columns from Parquet instead of each running the
    whole lineage again, and a lost executor costs a re-read only. All tables of
    one application share a folder, which can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/failtriage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)
