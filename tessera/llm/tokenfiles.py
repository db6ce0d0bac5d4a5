"""Token ids in Arrow IPC files: batches of fixed-size lists, so equal-length sequences and masks are read without a copy."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lean, partitions, shared_dir, slices, stored, table, utf8
from tessera.llm.pretokens import WordTable, encode_texts

END_ID = 2
SEQUENCE, ROWS = 2048, 64
_WORDS: dict[str, WordTable] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_bpe(path: str) -> WordTable:
    """The tokenizers library behind this worker's word table. Texts that hold the string of an added token go to the library whole."""
    if path not in _WORDS:
        t = tokenizer(path)
        encode = lambda words: [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]
        _WORDS[path] = WordTable(encode, added=sorted(a.content.encode() for a in t.get_added_tokens_decoder().values()))
    return _WORDS[path]


def id_width(path: str) -> pa.DataType:
    """The narrowest type that holds all ids of a vocabulary and the end id."""
    return pa.uint16() if max([END_ID, *tokenizer(path).get_vocab(with_added_tokens=True).values()]) < 1 << 16 else pa.uint32()


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


class TokenWriter:
    """One file: a stream of ids cut into sequences of SEQUENCE; the last is padded and masked."""

    def __init__(self, uri: str, width: pa.DataType):
        self.fs, self.path = file_system(uri)
        self.part, self.width = f"{self.path}.{uuid.uuid4().hex}", width
        self.schema = pa.schema([("ids", pa.list_(width, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        both = [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.width), SEQUENCE), pa.FixedSizeListArray.from_arrays(mask, SEQUENCE)]
        self.file.write_batch(pa.RecordBatch.from_arrays(both, schema=self.schema))

    def write(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.width.to_pandas_dtype()))
        self.held += len(ids)
        whole = SEQUENCE * ROWS
        if self.held >= whole:
            every = np.concatenate(self.rest)
            for at in range(0, len(every) - whole + 1, whole):
                self._batch(every[at : at + whole], whole)
            self.rest = [every[len(every) - len(every) % whole :]]
            self.held = len(self.rest[0])

    def close(self) -> None:
        """The file takes its name only when it is whole, so a task that runs again puts an equal file in its place."""
        if self.held:
            every = np.concatenate(self.rest)
            self._batch(np.concatenate((every, np.zeros(-len(every) % SEQUENCE, every.dtype))), len(every))
        self.file.close()
        self.out.close()
        self.fs.move(self.part, self.path)


class TokenReader:
    """Random access to the ids of a file. A local file is mapped into memory: views, no copies."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path))

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and the mask of a batch's sequences."""
        b = self.file.get_batch(k)
        return b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        size = SEQUENCE * ROWS
        out = []
        while n > 0:
            k, at = divmod(start, size)
            got = self.file.get_batch(k).column(0).flatten().to_numpy()[at : at + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return np.concatenate(out) if len(out) != 1 else out[0]


def write_tokens(docs: DataFrame, folder: str, path: str, files: int) -> DataFrame:
    """(doc_id, text, ...) -> token files in `folder`, in ascending doc_id order over files and within them.

    Returns the index: file, doc_id, at (ids before it in its file), n_tokens with the end id. Null texts are empty and
    have the end id only; a null doc_id comes first, equal doc_ids are ordered by text (a doc_id that many rows share is
    dealt by the head of its texts too); an empty table makes no file. Other columns are ignored. Texts are read 1 MB at a
    time, a longer one at once.
    """
    width = id_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out, at = byte_bpe(path), None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                ids, counts = encode_texts(words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], END_ID)
                out = out or TokenWriter(f"{folder}/tokens-{part:06d}.arrow", width)
                out.write(ids)
                ends = at + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part)), batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(ends - counts), pa.array(counts)], ["file", "doc_id", "at", "n_tokens"])
                at = int(ends[-1])
        if out:
            out.close()

    ordered = docs.select("doc_id", "text").repartitionByRange(files, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(lean(run), "file long, doc_id long, at long, n_tokens long"), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """The index and the files -> doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for batch in batches:
            crc = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
                if file != opened:
                    opened, reader = file, TokenReader(f"{folder}/tokens-{file:06d}.arrow")
                crc.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a file: the running total is over the number of files only.
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = index.join(base, "file").select("file", "at", "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens")
    return rows.sortWithinPartitions("file", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    index = write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), partitions(spark))
    return read_tokens(index, folder)
