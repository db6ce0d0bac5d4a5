import glob
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import tokenfiles as T

SF = "/root/testdata/sf0.001"


def test_files_hold_every_text_in_order(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i * 3 % 50, f"Document {i}'s text\n\n" + "word é " * (i * 7), "x") for i in range(50)] + [(60, None, "x"), (61, "", "x"), (62, "long " * 400_000, "x"), (7, "again", "x"), (63, "see <|endoftext|> here", "x"), (None, "first", "x"), (None, "again first", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    index = T.write_tokens(docs, str(tmp_path), T.tokenizer_path(), 3)
    out = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_tokens(index, str(tmp_path)).collect())
    want, at = [], 0
    for d, text, _ in sorted(((-1 if d is None else d, t, x) for d, t, x in rows), key=lambda r: (r[0], r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [T.END_ID]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert out == want
    real = 0
    for name in glob.glob(f"{tmp_path}/*.arrow"):
        with pa.memory_map(name) as f:
            file = pa.ipc.open_file(f)
            for k in range(file.num_record_batches):
                b = file.get_batch(k)
                assert b.schema.field("ids").type == pa.list_(pa.uint16(), T.SEQUENCE) and b.column("ids").flatten().buffers()[1].address
                real += np.asarray(b.column("mask").flatten()).sum()
    assert real == at


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_tokens(T.write_tokens(docs, str(tmp_path), T.tokenizer_path(), 2), str(tmp_path)).count() == 0


def test_the_query_reads_whole_texts_in_order(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    want, at = [], 0
    for d, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = T.op8_token_files(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect())) == want
