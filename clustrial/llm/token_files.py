"""Token ids in binary shards, document boundaries in Elias-Fano code."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clustrial.llm.elias_fano import EliasFano
from clustrial.llm.tokens import crc32, default_tokenizer, encoded_rows
from clustrial.sources.tables import input_bytes, shared_folder, sized, store

MAGIC = b"EFTOK001"
# Footer: width of an id, documents, documents without id, smallest id, bytes of both codes.
_FOOT = "<BQQqQQ8s"
SHARD_BYTES = 8 << 20  # of input, as read
AT_ONCE = 1024  # documents whose boundaries are read together


def write_token_files(
    df: DataFrame,
    folder: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> tuple[str, DataFrame]:
    """Write the ids of every text, an end id after each, in ascending order of document id.

    Returns the folder and a stored table of the shards: ``shard`` (their order), ``name``,
    ``n_docs``, ``n_ids`` and ``base``, the ids in all shards before it.

    A shard is the ids one after another, then the document boundaries and the document ids,
    both in Elias-Fano code, then a footer. The folder, by default one in the shared folder,
    is named by a URI that every executor can open with ``pyarrow.fs``. A repeated task
    writes the same shard again and moves it into place, so lost executors do no harm.

    Missing texts are empty and hold the end id only. Missing ids come first. Repeated ids
    are documents of their own, ordered by the hash of their text; an empty table gives no
    shard.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files/{uuid.uuid4().hex}"
    folder = folder if re.match(r"[a-z0-9]+:", folder) else "file://" + folder
    name = tokenizer or default_tokenizer()
    docs = sized(df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")))
    # Equal rows give equal documents in any order; the last key spreads them over shards.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    docs = docs.withColumn("tie", F.monotonically_increasing_id())
    shards = max(1, -(-input_bytes(docs) // shard_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = encoded_rows(batches, name)
        first = next(rows, None)
        if first is None:
            return
        task = TaskContext.get()
        shard = f"shard-{task.partitionId():08d}.eft"
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        part = f"{path}/_{shard}.{task.taskAttemptId()}"
        ends, ids, missing, width = [], [], 0, first[1].dtype.itemsize
        total = 0
        with system.open_output_stream(part) as out:
            while first is not None:
                key, found = first
                out.write(found.tobytes())
                total += len(found)
                ends.append(total)
                if key is None:
                    missing += 1
                else:
                    ids.append(key)
                first = next(rows, None)
            least = ids[0] if ids else 0
            starts = EliasFano.encode(np.array([0, *ends])).tobytes()
            keys = EliasFano.encode(np.array([k - least for k in ids], np.uint64)).tobytes()
            out.write(starts)
            out.write(keys)
            out.write(struct.pack(_FOOT, width, len(ends), missing, least, len(starts), len(keys), MAGIC))
        system.move(part, f"{path}/{shard}")
        yield pa.RecordBatch.from_pylist(
            [{"shard": task.partitionId(), "name": shard, "n_docs": len(ends), "n_ids": total}]
        )

    ranged = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    written = ranged.mapInArrow(write, "shard long, name string, n_docs long, n_ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, store(
        store(written, "shards").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))),
        "manifest",
    )


class TokenShard:
    """One shard held in memory: ids and places of any of its documents."""

    def __init__(self, data: memoryview | bytes):
        width, n, missing, least, starts, keys, magic = struct.unpack_from(_FOOT, data, len(data) - struct.calcsize(_FOOT))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        end = len(data) - struct.calcsize(_FOOT)
        self.n_docs, self.n_missing, self.least = n, missing, least
        self.keys = EliasFano.frombytes(data[end - keys : end])
        self.starts = EliasFano.frombytes(data[end - keys - starts : end - keys])
        self.ids = np.frombuffer(data, f"<u{width}", (end - keys - starts) // width)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.starts.select(i) : self.starts.select(i + 1)]

    def boundaries(self, first: int, last: int) -> np.ndarray:
        """Where the documents ``first`` up to ``last`` start, and where the last of them ends."""
        return self.starts.run(first, last + 1).astype(np.int64)

    def document_ids(self, first: int, last: int) -> list[int | None]:
        """The ids of the documents ``first`` up to ``last``; those without id come first."""
        missing = max(min(last, self.n_missing) - first, 0)
        keys = self.keys.run(max(first - self.n_missing, 0), max(last - self.n_missing, 0))
        return [None] * missing + [k + self.least for k in keys.tolist()]


def read_token_files(
    spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False
) -> DataFrame:
    """The documents in the shards: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    Boundaries come out of the Elias-Fano code through its kept places, ``AT_ONCE`` documents
    at a time; no table of all boundaries is made.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = TokenShard(memoryview(data.as_buffer()))
                for k in range(0, shard.n_docs, AT_ONCE):
                    last = min(k + AT_ONCE, shard.n_docs)
                    starts = shard.boundaries(k, last)
                    spans = list(zip(starts[:-1], starts[1:]))
                    found = [shard.ids[a:b] for a, b in spans]
                    out = {
                        "name": [path.rsplit("/", 1)[-1]] * len(spans),
                        "doc_id": pa.array(shard.document_ids(k, last), pa.int64()),
                        "place": [int(a) for a, _ in spans],
                        "n_tokens": [int(b - a) for a, b in spans],
                        "ids_crc32": [crc32(x) for x in found],
                    }
                    if with_ids:
                        out["ids"] = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "name string, doc_id long, place long, n_tokens long, ids_crc32 long"
    extra = ["ids"] if with_ids else []
    files = (
        spark.read.schema("path string, modificationTime timestamp, length long, content binary")
        .format("binaryFile").option("pathGlobFilter", "shard-*.eft").load(folder)
    ) if manifest.head(1) else spark.createDataFrame([], "path string, content binary")
    rows = files.select("path", "content").mapInArrow(read, schema + (", ids array<int>" if with_ids else ""))
    return rows.join(manifest.select("name", "base"), "name").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *extra
    )
