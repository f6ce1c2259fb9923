"""Equal-length token sequences in Arrow stream files, and their readers.

A shard is two uncompressed Arrow stream files in one folder:

* ``NAME.sequences.arrows``: ``input_ids`` and ``mask``, fixed-size lists of ``length``
  values, in batches of ``ROWS_PER_BATCH`` rows. Document after document without gaps;
  the last row is filled up with ids 0 and mask false.
* ``NAME.documents.arrows``: ``doc_id, start, n_tokens``, where start counts the ids of
  the shard before the document.

No column is of variable length, so a memory-mapped file gives row i as row
i % ROWS_PER_BATCH of batch i // ROWS_PER_BATCH without a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortforge.llm.segments import encoder
from cohortforge.llm.tables import fresh_path, written
from cohortforge.llm.text import slices

ROWS_PER_BATCH = 256
MANIFEST = "shard string, first_doc long, last_doc long, n_documents long, n_ids long"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    """``wide``: ids need more than 16 bits."""
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def opened(path: str, write: bool = False):
    """A file in any store that Arrow knows; local ones are memory-mapped for reading."""
    store, name = pafs.FileSystem.from_uri(path) if "://" in path or ":/" in path else (pafs.LocalFileSystem(), path)
    if write:
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(name)
    return pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name)


class ShardWriter:
    """Writes one shard; memory holds one batch of sequences at most besides a document."""

    def __init__(self, path: str, length: int, wide: bool):
        self.length, self.dtype = length, np.dtype("<u4" if wide else "<u2")
        self.schema = sequence_schema(length, wide)
        self.files = [opened(f"{path}.{kind}.arrows", True) for kind in ("sequences", "documents")]
        self.sequences = pa.ipc.new_stream(self.files[0], self.schema)
        self.documents = pa.ipc.new_stream(self.files[1], DOCUMENTS)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Append one document."""
        self.rows.append((doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.length * ROWS_PER_BATCH:
            self._flush()
        if len(self.rows) >= 10_000:
            self._flush_rows()

    def _flush(self, last: bool = False) -> None:
        values, batch = np.concatenate(self.held or [np.zeros(0, self.dtype)]), self.length * ROWS_PER_BATCH
        at = 0
        while len(values) - at >= batch or (last and at < len(values)):
            part = values[at : at + batch]
            padded = -(-len(part) // self.length) * self.length
            mask = np.arange(padded) < len(part)
            full = np.zeros(padded, self.dtype)
            full[: len(part)] = part
            kinds = [f.type for f in self.schema]
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(v, t.value_type), type=t)
                for v, t in zip((full, mask), kinds, strict=True)
            ]
            self.sequences.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            at += batch
        self.held, self.n_held = [values[at:]], max(0, len(values) - at)

    def _flush_rows(self) -> None:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[], [], []]
        self.documents.write_batch(
            pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=DOCUMENTS)
        )
        self.rows = []

    def close(self) -> None:
        """Finish both files."""
        self._flush(last=True)
        self._flush_rows()
        for part in (self.sequences, self.documents, *self.files):
            part.close()


class ShardReader:
    """Random access to one shard; rows and masks are views of the mapped file."""

    def __init__(self, path: str):
        self.table = pa.ipc.open_stream(opened(f"{path}.sequences.arrows")).read_all()
        self.documents = pa.ipc.open_stream(opened(f"{path}.documents.arrows")).read_all()
        self.batches = [c.chunks for c in self.table.columns]
        self.length = self.table.schema.field("input_ids").type.list_size

    def __len__(self) -> int:
        return len(self.table)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of one sequence."""
        batch, at = divmod(row, ROWS_PER_BATCH)
        ids = self.batches[0][batch].values.to_numpy(zero_copy_only=True)
        mask = self.batches[1][batch].values
        part = slice(at * self.length, (at + 1) * self.length)
        return ids[part], mask[part].to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the shard, as unsigned 32-bit values."""
        out, step = [], self.length * ROWS_PER_BATCH
        while count > 0:
            batch, at = divmod(start, step)
            part = self.batches[0][batch].values.to_numpy(zero_copy_only=True)[at : at + count]
            out.append(part.astype("<u4"))
            start, count = start + len(part), count - len(part)
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def _write_shard(folder: str, tokenizer_path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, writer, seen = TaskContext.get(), encoder(tokenizer_path), None, []
        # Another attempt of the task writes under another name; the manifest lists the one that counts.
        shard = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            for at, texts in slices(batch.column(1), 2 << 20):
                writer = writer or ShardWriter(shard, length, encode.wide)
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                tokens, first = encode.batch(texts)
                for doc_id, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    writer.add(doc_id, np.append(tokens[a:b], np.uint32(end_id)))
                seen = [seen[0] if seen else ids[0], ids[-1], (seen[2] if seen else 0) + len(ids)]
        if writer:
            writer.close()
            values = [shard, *seen, writer.n_ids]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "first_doc", "last_doc", "n_documents", "n_ids"), values, strict=True))])

    return run


def write_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    length: int = 2048,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order; returns the manifest, a row per shard.

    The manifest has the shard's path, its first and last id, its counts and
    ``first_id``, the ids of all shards before it. Shards are ranges of ids, so the
    number of files and tasks grows with the table. Ids take 16 bits where the vocabulary
    allows, else 32.

    A null text is one end id; null doc ids come first; rows that repeat an id stand next
    to each other, ordered by text; an empty table gives no shards; other columns are not
    read. ``folder`` is in the shared checkpoint folder by default, by URI.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sequences")
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = written(
        ordered.mapInArrow(_write_shard(folder, tokenizer_path, length, end_id), MANIFEST), "sequence-shards"
    )
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), F.col("last_doc").asc_nulls_first(), "shard")
    before = F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return written(shards.withColumn("first_id", F.coalesce(before, F.lit(0)).cast("long")), "sequence-manifest")


def _read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader = ShardReader(row["shard"])
            for part in reader.documents.to_batches(2000):
                starts, counts = (part.column(k).to_pylist() for k in (1, 2))
                ids = [reader.ids(s, n).tobytes() for s, n in zip(starts, counts, strict=True)]
                start = pa.array([row["first_id"] + s for s in starts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), start, part.column(2), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def read_documents(manifest: DataFrame) -> DataFrame:
    """Documents of written shards: ``doc_id, start, n_tokens, ids`` (little-endian
    unsigned 32-bit); start counts the ids of all documents before."""
    shards = max(1, manifest.count())
    spread = manifest.select("shard", "first_id").repartition(shards, "shard")
    return spread.mapInArrow(_read_shard, "doc_id long, start long, n_tokens long, ids binary")
