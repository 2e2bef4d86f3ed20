"""What the operators share: the words of a text, the shared folder, tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: blank and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not white space, in order."""
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local
    session without that setting gets a temporary folder."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, so
    a lost executor costs a read and not a recomputation."""
    return written(df, name, compression)[0]


def written(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """The same, and the table's path, for `delete` once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number that tells every row from all others and stays the same whenever a row is read, and that column's name.

    Rows of files that Spark numbers (Parquet) have that of their file, of which the driver holds the list, and their place in it. Rows that
    come from elsewhere are written once with a number."""
    name = "_n"
    while name in docs.columns or f"{name}file" in docs.columns:
        name += "_"
    try:
        metadata = docs.metadataColumn("_metadata")
        rows = docs.select("*", metadata["row_index"].alias(name), metadata["file_path"].alias(f"{name}file"))
        files = sorted(r[0] for r in rows.select(f"{name}file").distinct().collect())
    except AnalysisException:
        return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    of = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], f"{name}file string, {name}of long")
    rows = rows.join(F.broadcast(of), f"{name}file").withColumn(name, F.shiftleft(f"{name}of", 36) + F.col(name))
    return rows.select(*docs.columns, name), name
