"""Flat files of token ids with 64-bit document offsets.

One shard per range of doc_id: ``<name>.ids`` holds all ids in a row, ``<name>.offsets`` the local start of
every document and the end, ``<name>.docs`` the doc_ids, all little-endian. The table ``index`` beside them
has one row per shard, with the number of ids in all earlier shards; base plus local offset is a document's
place in the whole. Names are unique per attempt and only shards named in the index count, so a task that
is run again does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outletry.llm.encoding import encoder
from outletry.llm.shipping import ship

_SHARD = (
    "name string, dtype string, n_docs long, n_null long, n_tokens long, first_doc long, first_hash long"
)
_READ_ROWS = 4096


def _write(batches: Iterable[pa.RecordBatch], folder: str, tokenizer: str, per_word: bool, end_id: int):
    encode = encoder(tokenizer, per_word)
    end = np.array([end_id], dtype=encode.kind).tobytes()
    width = np.dtype(encode.kind).itemsize
    store, path = fs.FileSystem.from_uri(folder)
    name, files, n_null, first = uuid.uuid4().hex, {}, 0, None
    n_docs, n_tokens = 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if not files:
            files = {k: store.open_output_stream(f"{path}/{name}.{k}") for k in ("ids", "offsets", "docs")}
            files["offsets"].write(np.array([0], dtype="<i8").tobytes())
            first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        ends = []
        for text in batch.column(2):
            data = encode(text.as_py())
            files["ids"].write(data)
            files["ids"].write(end)
            n_tokens += len(data) // width + 1
            ends.append(n_tokens)
        files["offsets"].write(np.array(ends, dtype="<i8").tobytes())
        files["docs"].write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        n_null += batch.column(0).null_count
        n_docs += batch.num_rows
    for file in files.values():
        file.close()
    if files:
        row = {
            "name": name, "dtype": encode.kind, "n_docs": n_docs, "n_null": n_null, "n_tokens": n_tokens,
            "first_doc": first[0], "first_hash": first[1],
        }
        types = {"name": pa.string(), "dtype": pa.string()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], names=list(row)
        )


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, per_word: bool = False, end_id: int = 1) -> None:
    """Encode every whole text of ``docs`` (doc_id, text), append ``end_id`` and write the files to ``folder``.

    * Documents come in ascending doc_id, null ones first; rows that share a doc_id are ordered by a hash
      of their text and then by the text, so every run gives the same order and one id can fill many shards.
    * A null text is empty and has the end id only. An empty table gives an index without rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rows = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    rows.mapInArrow(lambda b: _write(b, folder, tokenizer, per_word, end_id), _SHARD).write.parquet(f"{folder}/shards")
    # One row per shard, so the running sum is over few rows.
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_hash", "name").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shards = docs.sparkSession.read.schema(_SHARD).parquet(f"{folder}/shards")
    shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/index")


def _opened(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array; memory-mapped where the store is a local or mounted one."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype=dtype)


def _read(batches: Iterable[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    store, path = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for shard in batch.to_pylist():
            files = {
                k: _opened(store, f"{path}/{shard['name']}.{k}", t)
                for k, t in (("ids", shard["dtype"]), ("offsets", "<i8"), ("docs", "<i8"))
            }
            offsets = files["offsets"]
            for a in range(0, shard["n_docs"], _READ_ROWS):
                b = min(a + _READ_ROWS, shard["n_docs"])
                parts = [files["ids"][offsets[k] : offsets[k + 1]].astype("<u4") for k in range(a, b)]
                null = np.arange(a, b) < shard["n_null"]
                columns = {
                    "doc_id": pa.array(np.asarray(files["docs"][a:b]), mask=null),
                    "start": pa.array(shard["base"] + np.asarray(offsets[a:b])),
                    "n_tokens": pa.array(np.diff(offsets[a : b + 1])),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files of ``folder``."""
    ship(spark)
    index = spark.read.parquet(f"{folder}/index")
    shards = max(1, index.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return index.repartition(shards).mapInArrow(lambda b: _read(b, folder, with_ids), schema)
