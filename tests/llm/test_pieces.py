import numpy as np
import pytest
import sentencepiece

from versio.llm import pieces as sp

TEXTS = ["Hello  world\n x", "a▁b", " lead and trail  ", "é漢\U0001f600 \x00\t", "ﬁ Å", "\n\n", "x" * 300 + " " * 90, "The quick brown fox " * 3000, "", None]


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Pieces(sp.MODEL, sp.ALPHA)


def test_round_trip_rows_and_keys(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "s"), (None, TEXTS[7], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sp_ids string")
    done = sp.decode(sp.encode(df)).collect()
    assert len(done) == len(rows)
    for r in done:
        assert r["sp_lossless"] and r["decoded"] == r["text"] and (r["sp_ids"] is None) == (r["text"] is None)
    again = sp.encode(df.repartition(5)).collect()
    assert {(r["doc_id"], tuple(r["sp_ids"] or ())) for r in done} == {(r["doc_id"], tuple(r["sp_ids"] or ())) for r in again}
    assert next(r["sp_ids"] for r in done if r["doc_id"] is None) != next(r["sp_ids"] for r in done if r["doc_id"] == 7)
    assert sp.encode(df.limit(0)).count() == 0


def test_ids_are_the_librarys(vocabulary):
    own = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = [t for t in TEXTS if t and "▁" not in t]
    ids, at = vocabulary.sample(texts, np.arange(len(texts), dtype=np.uint64))
    assert [own.decode(ids[a:z].tolist()) for a, z in zip(at[:-1], at[1:], strict=True)] == texts


@pytest.mark.parametrize("word", ["tionst", "the", "他们a"])
def test_sampling_follows_the_lattice(vocabulary, word):
    own = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    ids_of = {own.id_to_piece(i).replace("▁", " "): i for i in range(3, own.get_piece_size()) if not own.is_byte(i)}

    def segmentations(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids_of:
                for rest in segmentations(s[k:]):
                    yield (ids_of[s[:k]], *rest)

    every = list(segmentations(" " + word))
    p = np.exp([sum(vocabulary.weight[i] for i in x) for x in every])
    n = 60_000
    ids, at = vocabulary.sample([word] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    count = {}
    for a, z in zip(at[:-1], at[1:], strict=True):
        x = tuple(ids[a:z].tolist())
        count[x] = count.get(x, 0) + 1
    assert set(count) <= set(every)
    assert max(abs(count.get(x, 0) / n - q) for x, q in zip(every, p / p.sum(), strict=True)) < 0.01
