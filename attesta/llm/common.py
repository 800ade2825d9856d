"""What the operators of this subpackage share: table reads and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.ship import ship

#: The ASCII white space that separates words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


#: Rows and bytes of a batch that goes to Python; the default of 10,000 rows may be whole books.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


#: Executors keep workers apart by their environment, and only some Python nodes set a variable for short tracebacks: a stage
#: of mapInArrow after one of an Arrow UDF would have workers of its own beside the idle ones of the other.
ONE_POOL = "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled"


def lean(spark: SparkSession) -> None:
    """Bound the batches of this session, have one pool of workers an executor, and see that workers have the package."""
    ship(spark)
    if str(spark.conf.get(ONE_POOL)).lower() != "false":
        spark.conf.set(ONE_POOL, "false")
    for key, most in ARROW.items():
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Only a local session without it (tests,
    a laptop) gets a temporary folder of its own; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/attesta-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor costs only its own tasks."""
    spark = df.sparkSession
    lean(spark)
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing lazy reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns that clash with none of df's (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def squeezed(text: Column) -> Column:
    """text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


#: Rows (of a few longs each) of a table that is broadcast.
BROADCAST = 500_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is proven to be small; else joins shuffle it."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df
