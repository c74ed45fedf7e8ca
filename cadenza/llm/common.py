"""Session helpers shared by the operators: tables, shared storage and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Bytes of a row group of tables between steps, which a writing task holds in memory.
ROW_GROUP_BYTES = 32 << 20
#: Ids (8 bytes each) that may be broadcast; larger sides are shuffled.
BROADCAST_IDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of `sf_dir`, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session unless the user has set a bound."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of a local session is made; a cluster has no default."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back; this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cadenza_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more; all that was made from them is written elsewhere.

    There is no public call to delete a path of any file system from Python, hence the one through the JVM."""
    for table_ in tables:
        jvm = table_.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table_.cadenza_path)
        path.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_IDS) -> DataFrame:
    """`df`, marked for broadcast only if its rows, counted here unless given, are at most `limit`."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of `docs` as the struct `row`, beside `columns`, so that no name of theirs clashes; select("row.*") has them back."""
    own = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(own, *[c.alias(name) for name, c in columns.items()])


def keep_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of `docs` whose doc_id is (or with left_anti is not) in `ids`; null ids match null ids.

    A small id table goes to the rows; a large one meets them in a shuffled join."""
    own = ids.select(F.col("doc_id").alias("id")).distinct()
    rows = wrapped(docs, own_id=docs["doc_id"])
    return rows.join(sized(own), F.col("own_id").eqNullSafe(F.col("id")), how).select("row.*")
