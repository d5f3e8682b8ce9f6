"""End-to-end jobs with written outputs: E1 (predictions + scores), E2 (CSV), E3, S1 pruning."""
import glob
import json

import pytest
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import SF001
from versio.functions import prompts as P
from versio.operators import infer
from versio.plans import jobs
from versio.sources.corpus import fixture_corpus, scan_parallel, write_parallel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

USER = P.DEFAULT_CHAT_MARKUP["open"].replace("{role}", "user")
COPY = infer.CopyBetween(USER, P.DEFAULT_CHAT_MARKUP["close"])


def test_translation_job_writes_and_scores(spark, tmp):
    corpus = fixture_corpus(spark, SF001)
    cfg = jobs.JobConfig(ks=[1], dialect="bare", chat="system_user", model="org/Some-Model:v1",
                              expected_pairs=["eng_hin"])
    out = jobs.run_translation_job(spark, corpus, COPY, cfg, out_root=tmp)
    scores = {r.direction: r for r in out["scores"].collect()}
    assert set(scores) == {"eng_2_fr", "fr_2_eng", "eng_2_de", "de_2_eng", "eng_2_es", "es_2_eng"}
    assert all(r.status == "ok" and r.n_segments == r.n_ref > 0 for r in scores.values())
    assert glob.glob(tmp + "/predictions/pair=eng_fr/model=Some-Model_v1/shot=shot1/direction=eng_2_fr/*.parquet")
    tsv = glob.glob(tmp + "/scores/model=Some-Model_v1/shot=shot1/*.csv")
    assert tsv and open(tsv[0]).readline().strip().split("\t") == ["pair", "direction", "hyp_file", "n_docs", "status", "chrf"]
    cov = {r.direction: r.status for r in out["coverage"].collect()}
    assert cov["eng_2_hin"] == "missing_ref_and_hyp" and cov["eng_2_fr"] == "ok"
    t = out["tally"].first()
    assert (t.n_ok, t.n_failed) == (6, 2)
    assert out["top"].count() == 5
    # The model ran once per prompt: predictions equal the stripped source documents.
    preds = out["predictions"].where("direction = 'eng_2_fr'").select("ordinal", "pred")
    src = corpus.where("subset = 'test' AND pair = 'eng_fr'").select("ordinal", F.col("src_txt").alias("pred"))
    assert preds.exceptAll(src).count() == 0 and src.exceptAll(preds).count() == 0


def test_quickstart_csv(spark, tmp):
    corpus = fixture_corpus(spark, SF001)
    qs = infer.CopyBetween(P.between(P.QUICKSTART_TEMPLATE, "system", "text"), P.between(P.QUICKSTART_TEMPLATE, "text", None))
    out = jobs.quickstart(corpus, qs, n=3, pair="eng_de", out_csv=tmp + "/qs")
    rows = out.collect()
    assert len(rows) == 3 and all(r.pred_txt == r.src_txt for r in rows)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(tmp + "/qs")
    assert back.count() == 3 and "pred_txt" in back.columns


def test_training_set_written(spark, tmp):
    corpus = fixture_corpus(spark, SF001)
    t = jobs.build_training_set(corpus, max_length=16, out_path=tmp + "/sft")
    back = spark.read.parquet(tmp + "/sft")
    assert back.count() == 2 * corpus.count()
    assert back.where(F.size("input_ids") != 16).count() == 0


def test_scan_parallel_prunes_partitions(spark, tmp):
    corpus = fixture_corpus(spark, SF001)
    write_parallel(corpus, tmp + "/parallel")
    df = scan_parallel(spark, tmp + "/parallel", subset="dev", pair="eng_fr", columns=["ordinal", "src_txt"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subset" in plan and "pair" in plan
    assert df.count() == corpus.where("subset = 'dev' AND pair = 'eng_fr'").count()


def test_jsonl_tree_to_scores(spark, tmp):
    """The user path: JSONL tree -> ingest -> stored table -> job -> same scores as the direct computation."""
    import json
    import os
    from versio.operators import chrf as C
    from versio.operators.directions import expand_directions
    from versio.sources.corpus import ingest_jsonl
    corpus = fixture_corpus(spark, SF001)
    rows = corpus.orderBy("subset", "pair", "ordinal").collect()   # small fixture only
    for r in rows:
        a, b = r.pair.split("_")
        d = f"{tmp}/data/{r.subset}/{r.pair}"
        os.makedirs(d, exist_ok=True)
        for lang, text in ((a, r.src_txt), (b, r.tgt_txt)):
            with open(f"{d}/doc.{lang}.jsonl", "a", encoding="utf-8") as f:
                f.write(json.dumps([text], ensure_ascii=False) + "\n")
    parallel, rejects, check = ingest_jsonl(spark, f"{tmp}/data", strict=True)
    assert rejects.count() == 0 and parallel.count() == len(rows)
    write_parallel(parallel, f"{tmp}/parallel")
    stored = scan_parallel(spark, f"{tmp}/parallel")
    cfg = jobs.JobConfig(ks=[1], dialect="bare", chat="system_user")
    out = jobs.run_translation_job(spark, stored, COPY, cfg)
    got = {r.direction: r.chrf for r in out["scores"].collect()}
    d = expand_directions(corpus.where("subset = 'test'"))
    want = {r.direction: r.chrf for r in C.chrf_by(d, "src", "tgt", ["direction"], ["ordinal"]).collect()}
    assert got == want


def test_prediction_overwrite_keeps_other_runs(spark, tmp):
    from versio.sources.sinks import write_predictions
    schema = "pair string, model string, shot string, direction string, ordinal long, pred string"
    a = spark.createDataFrame([("eng_hin", "m1", "shot1", "eng_2_hin", 0, "a")], schema)
    b = spark.createDataFrame([("eng_hin", "m2", "shot1", "eng_2_hin", 0, "b")], schema)
    write_predictions(a, tmp + "/p", mode="overwrite")
    write_predictions(b, tmp + "/p", mode="overwrite")
    write_predictions(b.withColumn("pred", F.lit("b2")), tmp + "/p", mode="overwrite")
    got = sorted((r.model, r.pred) for r in spark.read.parquet(tmp + "/p").collect())
    assert got == [("m1", "a"), ("m2", "b2")]


class RecordingCopy:
    """CopyBetween stand-in that records how many prompts each model call saw."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        import os
        import uuid
        inner = COPY()

        def gen(prompts):
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(str(len(prompts)))
            return inner(prompts)
        return gen


def test_resume_runs_only_pending_prompts(spark, tmp):
    import os
    corpus = fixture_corpus(spark, SF001)
    calls1, calls2 = tmp + "/calls1", tmp + "/calls2"
    os.makedirs(calls1)
    os.makedirs(calls2)
    cfg = jobs.JobConfig(ks=[1], dialect="bare", chat="system_user", model="m", resume=True)
    first = corpus.where("pair = 'eng_fr'")
    jobs.run_translation_job(spark, first, RecordingCopy(calls1), cfg, out_root=tmp + "/run")
    out = jobs.run_translation_job(spark, corpus, RecordingCopy(calls2), cfg, out_root=tmp + "/run")
    seen = [sum(int(open(os.path.join(d, f)).read()) for f in os.listdir(d)) for d in (calls1, calls2)]
    n_test = corpus.where("subset = 'test'").count()
    n_fr = first.where("subset = 'test'").count()
    assert seen == [2 * n_fr, 2 * (n_test - n_fr)]
    scores = out["scores"].collect()
    assert len(scores) == 6 and all(r.status == "ok" for r in scores)


def test_score_run_files_matches_python_reader_and_chrf(spark, tmp):
    """Files in the evaluation layout -> scores equal to Python loading + Counter chrF."""
    import json
    import os
    from plain_chrf import py_chrf
    refs = {"hin": ['["ref one"]', "   ", '["second reference text"]', '["third"]'],
            "eng": ['{"translation": "an english line"}', '"quoted"', '["last one"]']}
    hyps = {"eng_2_hin": ['["ref  one"]', '["second text"]', "raw third line"],
            "hin_2_eng": ['["english line"]', "", '{"other": 1}', '["last"]']}
    os.makedirs(f"{tmp}/data/test/eng_hin")
    for lang, lines in refs.items():
        write_lines_(f"{tmp}/data/test/eng_hin/doc.{lang}.jsonl", lines)
    for d, lines in hyps.items():
        folder = f"{tmp}/res/eng_hin/my-model/shot1/{d}"
        os.makedirs(folder)
        write_lines_(f"{folder}/doc.{d}.1.pred.jsonl", lines)

    def load(lines):   # the score reader's semantics, written out in Python
        out = []
        for ln in lines:
            if not ln.strip():
                continue
            obj = json.loads(ln) if ln.strip().startswith(("[", "{", '"')) else [ln]
            out.append((obj[0] if isinstance(obj, list) else obj.get("translation", "") if isinstance(obj, dict) else obj).strip())
        return out

    out = jobs.score_run_files(spark, f"{tmp}/data", f"{tmp}/res", "my-model", k=1, expected_pairs=["eng_tam"])
    got = {r.direction: r for r in out["scores"].collect()}
    want_e = round(py_chrf(load(hyps["eng_2_hin"]), load(refs["hin"])), 4)
    want_h = round(py_chrf(load(hyps["hin_2_eng"]), load(refs["eng"])), 4)
    assert got["eng_2_hin"].chrf == pytest.approx(want_e, abs=1e-4) and got["eng_2_hin"].status == "ok"
    assert got["hin_2_eng"].chrf == pytest.approx(want_h, abs=1e-4) and got["hin_2_eng"].status == "ok"
    assert got["eng_2_hin"].line == f"doc.eng_2_hin.1.pred.jsonl\t{want_e:.4f}"
    cov = {r.direction: r.status for r in out["coverage"].collect()}
    assert cov == {"eng_2_hin": "ok", "hin_2_eng": "ok", "eng_2_tam": "missing_ref_and_hyp",
                   "tam_2_eng": "missing_ref_and_hyp"}


def write_lines_(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        for ln in lines:
            f.write(ln + "\n")


def test_quickstart_falsy_n_means_every_document(spark):
    corpus = fixture_corpus(spark, SF001)
    qs = infer.CopyBetween(P.between(P.QUICKSTART_TEMPLATE, "system", "text"), P.between(P.QUICKSTART_TEMPLATE, "text", None))
    n_dev = corpus.where("subset = 'dev' AND pair = 'eng_es'").count()
    assert jobs.quickstart(corpus, qs, n=0, pair="eng_es").count() == n_dev
    assert jobs.quickstart(corpus, qs, n=None, pair="eng_es").count() == n_dev
    assert jobs.quickstart(corpus, qs, n=2, pair="eng_es").count() == min(2, n_dev)


def test_score_tables_of_models_and_sweeps_stay_apart(spark, tmp):
    corpus = fixture_corpus(spark, SF001)
    for model in ("m1", "m2"):
        cfg = jobs.JobConfig(ks=[0, 1], dialect="fewshot", chat="system_user", model=model)
        out = jobs.run_translation_job(spark, corpus, COPY, cfg, out_root=tmp)
    back = spark.read.option("sep", "\t").option("header", True).csv(tmp + "/scores")
    keys = [(r.model, r.shot, r.direction, r.hyp_file) for r in back.collect()]
    assert len(keys) == len(set(keys)) == 2 * 2 * 6
    assert all(f.endswith(f".{s[4:]}.pred.jsonl") for _, s, _, f in keys)
    assert out["tally"].first().n_expected == 12 and out["tally"].first().n_ok == 12


def test_misaligned_directions_have_no_score_or_rank(spark):
    from versio.operators import align, report
    from versio.operators.chrf import score_aligned
    refs = spark.createDataFrame([("a_2_b", 0, "x y"), ("a_2_b", 1, "z"), ("b_2_a", 0, "x")], "direction string, ordinal long, ref string")
    hyps = spark.createDataFrame([("a_2_b", 0, "x y"), ("b_2_a", 0, "q")], "direction string, ordinal long, pred string")
    scores = score_aligned(hyps, refs, ["direction", "ordinal"], ["direction"])
    assert {r.direction: (r.status, r.chrf) for r in scores.collect()} == {"a_2_b": ("length mismatch", None), "b_2_a": ("ok", 0.0)}
    assert [(r.direction, r.rank) for r in report.rank_scores(scores).collect()] == [("b_2_a", 1)]
    exp = spark.createDataFrame([("a", "b"), ("b", "a")], "src_lang string, tgt_lang string")
    t = report.tally(report.evaluated(align.coverage(exp, refs, hyps), scores)).first()
    assert (t.n_ok, t.n_failed) == (1, 1)


def test_jsonl_sink_keeps_key_order_over_many_files(spark, tmp):
    import glob as g

    from versio.sources import sinks
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'dev', 'test') AS subset", "id AS ordinal", "concat('t', id) AS text").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_documents(df, tmp + "/docs", ["subset"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(g.glob(tmp + "/docs/subset=test/part-*"))
    lines = [json.loads(x)[0] for f in files for x in open(f)]
    assert len(files) > 2 and lines == [f"t{i}" for i in range(20_000) if i % 3]


class FailsOn:
    """Copies like COPY but fails on one text; records what it was asked, one file per prompt."""

    def __init__(self, folder, text):
        self.folder, self.text = folder, text

    def __call__(self):
        import uuid
        inner = COPY()

        def gen(prompts, params):
            assert params == {"max_new_tokens": 99, "sampling": True, "temperature": 0.5, "top_p": 0.8}
            for p in prompts:
                if self.text and self.text in p:
                    raise RuntimeError("engine lost")
                with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
            return inner(prompts)

        return gen


def test_crash_keeps_committed_units_and_resume_sends_the_rest(spark, tmp):
    import os
    rows = [("test" if i % 5 else "dev", "eng_fr", i, f"source number {i} .", f"cible {i}") for i in range(60)]
    corpus = spark.createDataFrame(rows, "subset string, pair string, ordinal long, src_txt string, tgt_txt string")
    cfg = jobs.JobConfig(ks=[0], dialect="bare", chat="system_user", model="m", resume=True, commit_units=6,
                         max_new_tokens=99, sampling=True, temperature=0.5, top_p=0.8)
    for d in ("a", "b"):
        os.makedirs(f"{tmp}/{d}")
    with pytest.raises(Exception):
        jobs.run_translation_job(spark, corpus, FailsOn(f"{tmp}/a", "source number 33 ."), cfg, out_root=tmp + "/run")
    committed = spark.read.parquet(tmp + "/run/predictions").count()
    out = jobs.run_translation_job(spark, corpus, FailsOn(f"{tmp}/b", None), cfg, out_root=tmp + "/run")
    assert 0 < committed < 96 and len(os.listdir(f"{tmp}/b")) == 96 - committed
    assert out["predictions"].count() == 96 and all(r.status == "ok" for r in out["scores"].collect())
