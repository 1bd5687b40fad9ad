import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.conftest import DATA
from weftline.llm import registry
from weftline.llm import token_shards as ts

VOCABULARY = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
ODD = [
    "", None, " \n\t ", "Don't they're 'That's we'll I'd", "Äpfel, Über; ÉCOLE! naïve? İstanbul. ıİ ŉ ǅ ǆ", "ΟΔΥΣΣΕΥΣ, σς Σ.", "á ́x é. ́.", "—. …! «x».", "x　y\x85z\x1cw v",
    "<|endoftext|> a<|startoftext|>b <|EndOfText|>", "12,5 2nd ½. ²! x²y", "日本語。テスト 😀😀 👍🏽!", "ẛ̣ Å ﬁ.", "A" * 300 + ".", "word...?! ,lead",
]


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def expected(rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_query_by_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(registry.queries()["op12_token_shards"](spark, DATA)) == expected(rows)


@pytest.mark.parametrize("memo", [3, 50, 100_000])
def test_pieces_as_whole_texts(memo):
    encoder = ts.Encoder(VOCABULARY, memo)
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choices([t for t in ODD if t], k=6)) for _ in range(40))]
    for a in range(0, len(texts), 7):
        found = encoder.encode(pa.array(texts[a : a + 7], pa.string()))
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [whole(t)[:-1] for t in texts[a : a + 7]]


def test_texts_over_a_block(monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 40)
    texts = ["short", None, "Many words, more than a block. " * 5, "a", "", "x" * 90 + " y", " \n" * 60]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = [i for _, ids in ts._encoded_rows(iter([batch]), 0, ts.Encoder(VOCABULARY), b"\1\0\0\0") for i in ids]
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [whole(t) for t in texts]


def test_shards_odd_rows_and_fetch(spark, tmp_path):
    rows = [(k * 3, t) for k, t in enumerate(ODD)] + [(None, "no id."), (6, ODD[2]), (6, ODD[2])] + [(1000, "Long text. " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS hash", "2 AS ids")
    path = f"file://{tmp_path}/s"
    ts.write_shards(df, path, VOCABULARY, 1, max_bytes=120)
    back = ts.read_shards(spark, path)
    found = sorted((tuple(r) for r in back.collect()), key=lambda r: r[1])
    assert [(i, s, n, zlib.crc32(ids)) for i, s, n, ids in found] == expected(rows)
    assert len(list((tmp_path / "s").glob("*.tok"))) > 3
    assert ts.fetch(path, 9).tolist() == whole(ODD[3]) and ts.fetch(path, 1000).tolist() == whole(rows[-1][1]) and ts.fetch(path, 10) is None and ts.fetch(path, 10**6) is None
    shard = next((tmp_path / "s").glob("*.tok"))
    data = shard.read_bytes()
    shard.write_bytes(data[:8] + b"x" * 32 + data[40:])
    with pytest.raises(Exception, match="another dictionary"):
        back.collect()
    shard.write_bytes(data[:-9])
    with pytest.raises(Exception, match="ends early"):
        back.collect()


def test_no_rows(spark, tmp_path):
    ts.write_shards(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/s", VOCABULARY, 1)
    assert ts.read_shards(spark, f"{tmp_path}/s").count() == 0 and ts.fetch(f"{tmp_path}/s", 1) is None


def test_dictionary_makes_short_documents_smaller(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dictionary = ts.train_dictionary(docs, VOCABULARY, 1)
    texts = [np.array(whole(r.text[:400]), "<u4").tobytes() for r in docs.limit(100).collect()]
    import zstandard as z

    with_it = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(dictionary))
    assert sum(len(with_it.compress(t)) for t in texts) < 0.9 * sum(len(z.compress(t, 3)) for t in texts)
