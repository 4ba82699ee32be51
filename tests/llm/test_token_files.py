import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rateloom.llm import token_files as tf
from rateloom.session import scratch

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path(tf.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_give_the_ids_of_the_whole_text(plain):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "don't", "It's", "42", "x1", "é", "漢字", "!?", " ", " ", "\x1c", "\x85", "<|endoftext|>", "word", ".", "​", "'ll", "🙂"]
    encode = tf.Encoder(PATH)
    texts = ["", " ", "  a", "a ", " a", "a  ", "  a", "a b c", "x\n y"] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    got = encode(texts)
    for t, b in zip(texts, got, strict=True):
        assert np.frombuffer(b, f"<u{encode.width}").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_records_are_checked():
    whole = tf.frame(b"abcd")
    assert tf.unframe(whole) == b"abcd"
    for k in range(len(whole)):
        bad = bytearray(whole)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            tf.unframe(bytes(bad))


def test_round_trip(spark, plain):
    rows = [(5, "five five", "en", "s", 0), (None, "none", "en", "s", 0), (1, "one", None, None, None), (1, "one", None, None, None), (3, None, "", "", 0), (4, "", "x", "y", 0), (9, "long text " * 60000, "x", "y", 0), (-7, "minus", "x", "y", 0)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS part", "2 AS start")
    manifest = tf.write_records(docs, scratch(spark, "test"), PATH, files=3)
    found = sorted((r.asDict() for r in tf.read_records(manifest).collect()), key=lambda r: r["start"])
    want = sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for got, (i, t) in zip(found, want, strict=True):
        ids = ids_of(plain, t)
        assert got == {"doc_id": i, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        at += len(ids)
    first = manifest.orderBy("part").first()
    assert tf.read_record(first["file"], 0)[0] is None
    assert tf.read_record(first["file"], 0)[1].tolist() == ids_of(plain, "none")
    assert tf.read_records(tf.write_records(docs.limit(0), scratch(spark, "test"), PATH, files=3)).count() == 0


def test_query_against_the_plain_tokenizer(spark, plain):
    sf = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in tf.op8_token_records(spark, sf).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = ids_of(plain, r["text"])
        got = found[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
