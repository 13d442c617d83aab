"""Token counts of documents in flat token files without an index.

A token file is a row of ids; a document ends with the end-of-text id, and nothing says
where.  Files are looked at in blocks.  A block finds its separators in one vectorised
comparison and reports the lengths between them, what comes before the first and what after
the last.  Documents that cross blocks are stitched by a prefix scan over the blocks of a
file: the tokens open at a block's begin are the tokens before it less the end of the last
document before it.

``token_blocks`` makes such a file per task from texts and keeps it as a table of blocks, so
any file system that Spark reaches will do; ``read_token_files`` reads files made elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .tokens import END_OF_TEXT, VOCABULARY, Encoder

BLOCK_TOKENS = 1 << 16
ID_TYPE = "<u2"          # the vocabulary has fewer than 65,536 ids


def token_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data, ends): flat ids of all texts, each followed by the end id.

    ``ends`` lists the keys of the documents that end in a block (not where).  Write the
    result before it is used: a task names its file by its number.
    """
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        name, block = f"task-{TaskContext.get().partitionId():06d}", 0
        held, size, ends = [], 0, []
        key_type = pa.int64()

        def take(last: bool):
            nonlocal held, size, ends, block
            ids = np.concatenate(held) if held else np.zeros(0, ID_TYPE)
            at = 0
            while size - at >= block_tokens or last and at < size:
                part = ids[at:at + block_tokens]
                n = int((part == END_OF_TEXT).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()),
                     pa.array([part.tobytes()], pa.binary()),
                     pa.array([ends[:n]], pa.list_(key_type))], ["file", "block", "data", "ends"])
                ends, block, at = ends[n:], block + 1, at + len(part)
            held, size = [ids[at:]], size - at

        for batch in batches:
            key_type = batch.column(0).type
            for s in K.slices(batch.column(1)):
                keys = batch.column(0).slice(s.first, s.rows).to_pylist()
                for i, k in enumerate(keys):
                    ids = encode(str(s.text(i), "utf-8"))
                    held.append(np.append(ids, END_OF_TEXT).astype(ID_TYPE))
                    size += len(ids) + 1
                    ends.append(k)
                    if size >= block_tokens:
                        yield from take(False)
        yield from take(True)

    return picked.mapInArrow(
        run, f"file string, block bigint, data binary, ends array<{kind}>")


def read_token_files(spark: SparkSession, path: str,
                     block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of flat files of little-endian 16-bit ids, each below 2 GB."""
    size = block_tokens * np.dtype(ID_TYPE).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(data.as_buffer() or b"")
                for i, at in enumerate(range(0, len(view), size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([i], pa.int64()),
                         pa.array([bytes(view[at:at + size])], pa.binary())],
                        ["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block bigint, data binary")


def count_tokens(blocks: DataFrame, end_id: int = END_OF_TEXT) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete, key): every document of every file.

    ``n_tokens`` leaves the end id out.  Ids after the last end id are a document that is not
    complete.  ``key`` is null unless the blocks list their ``ends``.  Empty files have none.
    """
    listed = "ends" in blocks.columns
    kind = blocks.schema["ends"].dataType.elementType.simpleString() if listed else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[i].as_buffer() or b"", ID_TYPE)
                at = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1),
                     pa.array([len(ids)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64())),
                     batch.column(3).slice(i, 1)], ["file", "block", "n", "at", "ends"])

    ends = F.col("ends") if listed else F.lit(None).cast(f"array<{kind}>")
    seen = blocks.select("file", "block", "data", ends.alias("ends")).mapInArrow(
        run, f"file string, block bigint, n bigint, at array<bigint>, ends array<{kind}>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    scan = (seen.withColumn("begin", F.coalesce(F.sum("n").over(before), none))
            .withColumns({
                "base": F.coalesce(F.sum(F.size("at")).over(before), none),
                "stop": F.when(F.size("at") > 0, F.col("begin") + F.element_at("at", -1) + 1)})
            .withColumns({"open": F.coalesce(F.max("stop").over(before), none),
                          "last": F.lead("block").over(order).isNull()}))
    stops = F.transform("at", lambda x: F.col("begin") + x)
    # past the last end id of a file
    total = F.col("begin") + F.col("n")
    rest = F.when(F.col("last") & (F.coalesce("stop", "open") < total), F.array(total)).otherwise(
        F.array().cast("array<bigint>"))
    rows = (scan.withColumns({"stops": F.concat(stops, rest), "ends_n": F.size("at")})
            .withColumn("starts", F.concat(F.array("open"), F.transform(
                "stops", lambda x: x + 1)))
            .select("file", "base", "ends_n", F.posexplode(F.arrays_zip(
                "starts", "stops", F.coalesce("ends", F.array().cast(f"array<{kind}>"))
                .alias("keys"))).alias("i", "x"))
            .where("x.stops IS NOT NULL"))
    return rows.select(
        "file", (F.col("base") + F.col("i")).alias("ordinal"), F.col("x.starts").alias("start"),
        (F.col("x.stops") - F.col("x.starts")).alias("n_tokens"),
        (F.col("i") < F.col("ends_n")).alias("complete"), F.col("x.keys").alias("key"))
