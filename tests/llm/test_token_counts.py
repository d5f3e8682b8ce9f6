import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SF001
from versio.llm import token_counts as tc

TEXTS = ["Hello  world\n x", "a▁b", " lead and trail  ", "é漢字\U0001f600 \x00\t", "ﬁ Å ²¾", "\n\n", "x" * 3000 + " " * 900, "The quick brown fox " * 5000, "<s> </s> <unk> <0x41>", "in­ter​national", "▁▁▁ ▁", "", None, " ", "漢" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tc.MODEL)


@pytest.mark.parametrize("frequent", [1, 5, tc.FREQUENT])
def test_counts_are_the_librarys(spark, library, frequent):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "x"), (None, TEXTS[0], "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tc_tokens string")
    got = tc.token_counts(df, frequent=frequent).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > tc.LIMIT) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.digest(tc.token_counts(docs)).collect()}
    rows = docs.collect()
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 4096) for r in rows}


def test_random_texts_are_cut_without_loss(spark, library):
    rng = np.random.default_rng(7)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(pieces, 60)) for _ in range(200)]
    texts += ["".join(map(chr, rng.choice([*range(1, 0x250), *range(0x400, 0x460), 0x4E00, 0x3042, 0x1F600], 80))) for _ in range(200)]
    cuts = tc.Cuts(tc.MODEL)
    assert max(map(len, cuts.units(np.frombuffer("".join(texts[200:]).encode(), np.uint8), np.array([0, len("".join(texts[200:]).encode())]))[0].to_pylist())) < 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["tc_tokens"] for r in tc.token_counts(df, frequent=50).collect()} == {i: len(library.encode(t)) for i, t in enumerate(texts)}


def test_no_rows_no_text_bad_bytes(spark, library):
    assert tc.token_counts(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    assert tc.token_counts(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, 0, False)]
    broken = spark.range(2).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF2062")).cast("string").alias("text"))
    assert {r["tc_tokens"] for r in tc.token_counts(broken).collect()} == {len(library.encode("a� b"))}
