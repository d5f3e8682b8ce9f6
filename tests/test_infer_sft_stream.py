"""Batch inference (X1), clean-up, resume; SFT table (F14); streaming sink; entry contract."""
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F


from versio.operators import infer, sft
from versio.streaming.predictions import prompt_stream, stream_predictions


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Echo:
    """Stand-in model returning a fixed suffix per prompt; records batch sizes."""

    def __call__(self):
        def gen(prompts):
            assert 1 <= len(prompts) <= 3
            return [p + " + out\n\nmore" for p in prompts]
        return gen


def prompts_df(spark, n=10):
    return spark.createDataFrame([("eng_2_hin", i, f"prompt {i}") for i in range(n)],
                                 "direction string, ordinal long, prompt string")


def test_predictions_clean_and_stop(spark):
    df = prompts_df(spark)
    got = {r.ordinal: r.pred for r in infer.predictions(df, "prompt", Echo(), ["direction", "ordinal"],
                                                         batch_size=3, stop="\n\n").collect()}
    assert got[4] == "+ out"
    got = {r.ordinal: r.pred for r in infer.predictions(df, "prompt", Echo(), ["direction", "ordinal"],
                                                         batch_size=3).collect()}
    assert got[4] == "+ out\n\nmore"


def test_engine_output_count_checked(spark):
    class Bad:
        def __call__(self):
            return lambda ps: ps[:-1]
    with pytest.raises(Exception, match="outputs"):
        infer.generate(prompts_df(spark), "prompt", Bad(), ["ordinal"]).collect()


def test_resume_skips_written(spark):
    df = prompts_df(spark)
    done = df.where("ordinal < 4").select("direction", "ordinal")
    assert infer.pending(df, done, ["direction", "ordinal"]).count() == 6


def test_copy_between():
    gen = infer.CopyBetween("<u>", "</u>")()
    assert gen(["<s>x</s><u>doc</u><a>", "nothing"]) == ["doc", "nothing"]


def test_pad_truncate(spark):
    df = spark.createDataFrame([("eng_hin", 0, "a b c d e", "x y")],
                               "pair string, ordinal long, src_txt string, tgt_txt string")
    t = {r.direction: r for r in sft.training_table(df, max_length=8).collect()}
    e = t["eng_2_hin"]
    assert e.prompt == "Translate from eng to hin:\n\na b c d e\n\nTranslation:"
    assert e.input_ids == ["Translate", "from", "eng", "to", "hin:", "a", "b", "c"]
    assert e.attention_mask == [1] * 8
    assert e.labels == ["x", "y"] + ["<pad>"] * 6
    h = t["hin_2_eng"]
    assert h.attention_mask == [1] * 8 and h.labels[:5] == ["a", "b", "c", "d", "e"]


def test_user_tokenizer(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    tok = sft.user_tokenizer(lambda: (lambda s: s.split()))
    assert [r.x for r in df.select(tok("t").alias("x")).collect()] == [["a", "b"], ["c"]]


def test_streaming_predictions_exactly_once(spark, tmp):
    src, out, ck = tmp + "/prompts", tmp + "/preds", tmp + "/ck"
    schema = "direction string, ordinal long, model_input string"
    spark.createDataFrame([("d", i, f"p{i}") for i in range(5)], schema).write.parquet(src + "/a")
    q = stream_predictions(prompt_stream(spark, src + "/*", schema), Echo(), ["direction", "ordinal"], out,
                           checkpoint_location=ck, batch_size=2)
    q.awaitTermination()
    spark.createDataFrame([("d", i, f"p{i}") for i in range(5, 8)], schema).write.parquet(src + "/b")
    q = stream_predictions(prompt_stream(spark, src + "/*", schema), Echo(), ["direction", "ordinal"], out,
                           checkpoint_location=ck, batch_size=2)
    q.awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted(r.ordinal for r in got) == list(range(8))


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "prompt" in df.columns


class CountingFactory:
    """Stand-in model that records every build in a folder (one file per build)."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        import os
        import uuid
        open(os.path.join(self.folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda ps: ps


def test_engine_built_once_per_worker(spark, tmp):
    import os
    df = spark.range(0, 400, 1, 32).select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("prompt"))
    infer.generate(df, "prompt", CountingFactory(tmp), ["ordinal"]).write.format("noop").mode("overwrite").save()
    builds = os.listdir(tmp)
    pids = {b.split("-")[0] for b in builds}
    assert len(builds) == len(pids) <= 8   # one build per Python worker, not one per task (32)


def test_integer_tokens_with_ignore_index(spark):
    df = spark.createDataFrame([("eng_hin", 0, "a b", "x y z")],
                               "pair string, ordinal long, src_txt string, tgt_txt string")
    tok = sft.user_tokenizer(lambda: (lambda s: [len(w) for w in s.split()]), element="long")
    t = {r.direction: r for r in sft.training_table(df, max_length=10, tokenize=tok, pad=0, label_pad=-100).collect()}
    e = t["eng_2_hin"]
    assert e.input_ids == [9, 4, 3, 2, 4, 1, 1, 12, 0, 0]
    assert e.labels == [1, 1, 1] + [-100] * 7
    assert e.attention_mask == [1] * 8 + [0, 0]


def test_predictions_export_view(spark):
    import json
    from versio.sources.sinks import predictions_jsonl_view
    df = spark.createDataFrame([("eng_2_hin", 0, 'say "hi"\n')], "direction string, ordinal long, pred string")
    r = predictions_jsonl_view(df).first()
    assert (r.direction, r.ordinal) == ("eng_2_hin", 0) and json.loads(r.value) == ['say "hi"\n']


def test_user_tokenizer_holds_the_tokens_of_a_few_texts(spark):
    """The tokens of a batch are not held together; rows, order, nulls and long texts come back whole."""
    import pandas as pd
    from pyspark.sql import functions as F
    texts = [None, "", "ab c", "x" * 3_000_000, "tail", None, "y z"] + ["word " * 4000] * 200
    cut = list(sft.pieces(pd.Series(texts, dtype=object)))
    assert [x for s in cut for x in s] == texts
    assert all(len(s) == 1 or sum(len(x or "") for x in s) <= sft.TOKEN_CHARS for s in cut) and len(cut) > 8
    assert list(sft.pieces(pd.Series([], dtype=object))) == []

    tok = sft.user_tokenizer(lambda: str.split)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: r.n for r in df.select("id", F.size(tok(F.col("text"))).alias("n")).collect()}
    assert got == {i: (None if t is None else len(t.split())) for i, t in enumerate(texts)}
