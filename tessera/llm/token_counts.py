"""Token counts of documents in flat token files, by a separator scan.

A flat file holds the ids of one document after the other, each followed by the end-of-document id,
and no index. It is read in blocks of equal size, which cut documents anywhere. In each block
one vectorised comparison finds the separators; what lies between them are the block's pieces. A
prefix sum of the separator counts over the blocks of a file numbers the pieces, and pieces of one
number, the end of one block and the beginning of the next, add up to a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.tokens import WordEncoder, array_parts, ended

END = 49407
BLOCK = 1 << 16
DTYPE = "<u2"
#: Bytes of a file that one task reads.
WHOLE = 1 << 26

BLOCKS = "file string, block long, tokens binary"


def file_blocks(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = DTYPE, whole: int = WHOLE) -> DataFrame:
    """file, block, tokens: the flat token files under path, in blocks. Files of up to `whole` bytes are read by Spark, one
    by a task. Longer ones are dealt out in ranges of that size, and a task reads its range by itself, through the file
    systems that Arrow knows (local and shared folders, object stores, HDFS), so that a file may have any size."""
    import numpy as np

    width = np.dtype(dtype).itemsize * block
    wide = max(1, whole // width) * width

    def blocks(file: str, first: int, raw: pa.Buffer) -> Iterator[pa.RecordBatch]:
        for k in range(-(-raw.size // width)):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([first + k], pa.int64()), pa.array([raw[k * width : (k + 1) * width].to_pybytes()])], names=["file", "block", "tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from blocks(file, 0, content.as_buffer())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from pyarrow import fs

        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                with system.open_input_file(name) as f:
                    yield from blocks(file, offset // width, pa.py_buffer(f.read_at(min(wide, length - offset), offset)))

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(cut, BLOCKS)
    ranges = files.where(F.col("length") > whole).select("path", "length").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(wide).cast("long"))).alias("offset"), "length")
    return small.unionByName(ranges.repartition("path", "offset").mapInArrow(read, BLOCKS))


def flat_tokens(docs: DataFrame, vocabulary: str, end: int = END, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The blocks (file, block, tokens as unsigned 16-bit ids) of the flat token files that the tasks make of
    docs, one for each task, and which document is where in them (file, ordinal, doc_id). A null text has
    no tokens. Both are columns of one table, written once, in the shared folder."""
    width = 2 * block
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, name = WordEncoder(vocabulary, special_as_text=True), f"part-{TaskContext.get().partitionId()}"
        done = ordinal = 0
        rest = bytearray()

        def full(final: bool) -> pa.RecordBatch | None:
            nonlocal done, rest
            n = -(-len(rest) // width) if final else len(rest) // width
            cut = [bytes(rest[i * width : (i + 1) * width]) for i in range(n)]
            del rest[: n * width]
            done += n
            return n and pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(done - n, done), pa.int64()), pa.array(cut, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], schema=schema)
            ordinal += n
            for _, texts in array_parts(batch.column(1)):
                rest += ended(*encoder.encode(texts), end, np.dtype(DTYPE))[0].tobytes()
                if made := full(False):
                    yield made
        if made := full(True):
            yield made

    spark = docs.sparkSession
    both = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, BLOCKS + ", ordinal long, doc_id long")
    table = materialise(both, "flat-tokens", compression="zstd")
    return table.where("block is not null").select("file", "block", "tokens"), table.where("ordinal is not null").select("file", "ordinal", "doc_id")


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """file, ordinal (from 0), n_tokens: a row for each document of each file, separators not
    counted. Tokens behind the last separator of a file are its last document. Documents without tokens
    count 0. No blocks give no rows. A token must not be cut by the end of a block."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("separators", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lengths = []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                at = np.flatnonzero(ids == end)
                lengths.append(np.diff(at, prepend=-1, append=len(ids)) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) - 1 for x in lengths], pa.int64()), pa.array(lengths, schema.types[3])], schema=schema)

    found = blocks.select("file", "block", "tokens").mapInArrow(scan, "file string, block long, separators long, lengths array<long>")
    found = materialise(found, "separators")
    # A running sum over the counts alone: a row of three numbers for each block of a file.
    before = found.select("file", "block", (F.sum("separators").over(W.partitionBy("file").orderBy("block")) - F.col("separators")).alias("before"))
    pieces = found.join(before, ["file", "block"]).select("file", "before", "separators", F.posexplode("lengths").alias("k", "n"))
    pieces = pieces.select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n", (F.col("k") < F.col("separators")).alias("ends"))
    out = pieces.groupBy("file", "ordinal").agg(F.sum("n").alias("n_tokens"), F.max("ends").alias("ends"))
    return out.where("ends or n_tokens > 0").select("file", "ordinal", "n_tokens")


def document_tokens(docs: DataFrame, vocabulary: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens: a row for each row of docs (doc_id, text), through flat token files. The strings of special tokens
    are ordinary text here, so that the end id stands for ends alone.

    A null or empty text has no tokens. Rows that repeat are each counted, very long texts whole, in as many blocks as they
    fill. Other columns are ignored. An empty table gives an empty result."""
    blocks, where = flat_tokens(docs, vocabulary, end, block)
    return where.join(count_tokens(blocks, end), ["file", "ordinal"]).select("doc_id", "n_tokens")
