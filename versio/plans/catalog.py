"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group.

Every query reads the driver's tables (or frames Spark derives from them) in
full; none runs on made-up input alone. Column names match ``oracle.py``.
Queries whose point is a stored layout (the keyed corpus, prediction files, the
ledger) ingest the fixture first, as a deployment has done before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.text import clean_generation, in_word_band, scrub, split_lines, stop_cut, strip_ws, word_count
from ..operators import align as align_op
from ..operators import chrf as chrf_op
from ..operators import fewshot, infer, report, sft
from ..operators.directions import expand_directions, pair_langs, shot_sweep, with_labels
from ..plans import jobs
from ..session import materialize, stored_path
from ..sources import readers, sinks
from ..sources.corpus import first_documents, fixture_corpus, fixture_ranked_documents, keyed_fixture_corpus, table, zip_sides
from ..sources.sinks import jsonl_line

PROMPT_COLS = ["pair", "src_lang", "tgt_lang", "direction", "k", "ordinal", "prompt"]


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


@register("fewshot_prompt")
def q_fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the 1-shot prompt for every test document in every direction."""
    corpus = fixture_corpus(spark, sf_dir)
    return fewshot.build_prompts(corpus, [1]).select(*PROMPT_COLS)


# --- sources, text and directions ---------------------------------------------------


DEMO_MODEL = "example-org/Demo-Model:v1"


@register("corpus_scan_counts")
def q_corpus_scan_counts(spark, sf_dir):
    """Documents per split and pair, with the pair's languages."""
    c = fixture_corpus(spark, sf_dir)
    a, b = pair_langs("pair")
    return (c.groupBy("subset", "pair")
             .agg(F.count(F.lit(1)).alias("n_docs"),
                  F.sum(F.length("src_txt")).alias("src_chars"),
                  F.sum(F.length("tgt_txt")).alias("tgt_chars"))
             .select("subset", "pair", a.alias("src_lang"), b.alias("tgt_lang"), "n_docs", "src_chars", "tgt_chars"))


@register("jsonl_encode_decode")
def q_jsonl_encode_decode(spark, sf_dir):
    """S2 -> S3/S4/S5: every document through the JSONL encoding and the three readers."""
    d = table(spark, sf_dir, "documents").select("doc_id", jsonl_line(F.col("text")).alias("value"))
    d = readers.drop_blank(d)
    return d.select("doc_id",
                    readers.parse_strict(F.col("value"))["text"].alias("strict_text"),
                    readers.parse_prompt(F.col("value"))["text"].alias("prompt_text"),
                    readers.parse_score(F.col("value"))["text"].alias("score_text"))


def _dialect_lines(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    arr = jsonl_line(F.col("text"))
    form = F.pmod(F.col("item_id"), F.lit(4))
    line = (F.when(form == 0, arr)
             .when(form == 1, F.to_json(F.struct(F.col("text").alias("prompt"), F.col("text").alias("translation"))))
             .when(form == 2, F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"))
             .otherwise(F.col("text")))
    return b.select("item_id", form.alias("form"), line.alias("value"))


@register("reader_dialects")
def q_reader_dialects(spark, sf_dir):
    """S3/S4/S5 on the four line shapes (array, object, JSON string, raw text)."""
    d = readers.drop_blank(_dialect_lines(spark, sf_dir))
    s = readers.parse_strict(F.col("value"))
    return d.select("item_id", "form", s["text"].alias("strict_text"), s["error"].isNull().alias("strict_ok"),
                    readers.parse_prompt(F.col("value"))["text"].alias("prompt_text"),
                    readers.parse_score(F.col("value"))["text"].alias("score_text"))


@register("strip_and_blank_filter")
def q_strip_and_blank_filter(spark, sf_dir):
    """P8 on raw web pages: split lines, drop blank lines, strip the rest."""
    pg = table(spark, sf_dir, "pages")
    lines = split_lines("html")
    kept = F.filter(F.transform(lines, lambda x: strip_ws(x)), lambda x: x != F.lit(""))
    return pg.select("page_id", F.size(lines).alias("n_lines"), F.size(kept).alias("n_kept"),
                     F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("kept_chars"),
                     F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


@register("word_band_filter")
def q_word_band_filter(spark, sf_dir):
    """Documents whose stripped text has 101..200 words."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", word_count(strip_ws("text")).alias("n_words"))
    return d.where(in_word_band(F.col("n_words")))


@register("directions_with_labels")
def q_directions_with_labels(spark, sf_dir):
    """Directions present in the corpus, labels, names, layout."""
    c = fixture_corpus(spark, sf_dir).where(F.col("subset") == "test")
    per = c.groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    d = with_labels(expand_directions(per.withColumn("src_txt", F.lit(None).cast("string"))
                                      .withColumn("tgt_txt", F.lit(None).cast("string"))))
    k = F.lit(1)
    pf = P.prompt_file_name(F.col("src_lang"), F.col("tgt_lang"), k)
    hf = P.prompt_file_name(F.col("src_lang"), F.col("tgt_lang"), k, pred=True)
    parsed = P.parse_file_name(hf)
    return d.select(
        "pair", "direction", "src_lang", "tgt_lang", "src_label", "tgt_label", "n_docs",
        F.when(F.col("src_lang") == "eng", F.lit("src")).when(F.col("tgt_lang") == "eng", F.lit("tgt")).alias("eng_side"),
        pf.alias("prompt_file"), hf.alias("pred_file"),
        parsed["src_lang"].alias("parsed_src"), parsed["tgt_lang"].alias("parsed_tgt"), parsed["k"].alias("parsed_k"),
        F.concat_ws("/", F.col("pair"), P.model_dir_name(F.lit(DEMO_MODEL)), F.lit("shot1"), F.col("direction"),
                    hf).alias("run_path"))


# --- scoring --------------------------------------------------------------------------


SCORE_COLS = ["pair", "direction", "n_ref", "n_hyp", "status", "n_segments", "chrf"]


def copy_source_directions(spark, sf_dir):
    """Test documents in both directions; the copy-source baseline is the hypothesis."""
    c = fixture_corpus(spark, sf_dir).where(F.col("subset") == "test")
    return expand_directions(c)


def score_directions(hyps, refs, keys=("pair", "direction", "ordinal"), groups=("pair", "direction")):
    return chrf_op.score_aligned(hyps, refs, list(keys), list(groups))


@register("chrf_by_direction")
def q_chrf_by_direction(spark, sf_dir):
    """Corpus chrF per direction over whole test documents."""
    d = copy_source_directions(spark, sf_dir)
    hyps = d.select("pair", "direction", "ordinal", F.col("src").alias("pred"))
    refs = d.select("pair", "direction", "ordinal", F.col("tgt").alias("ref"))
    return score_directions(hyps, refs).select(*SCORE_COLS)


STATUS_RUNS = [(m, k) for m in ("a", "b") for k in (0, 1)]


@register("eval_status")
def q_eval_status(spark, sf_dir):
    """J3, J6, T3, A3, S8 over two models and two shot counts, with one hypothesis file cut short and one
    missing: status, score, rank among the aligned ones of the run, and the run's tally.

    The corpus is a keyed table: hypotheses meet their references bucket by
    bucket, and a text that several runs gave is counted once.
    """
    corpus = keyed_fixture_corpus(spark, sf_dir)
    d = expand_directions(corpus.where(F.col("subset") == "test"))
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in STATUS_RUNS]))
    short = (F.col("model") == "a") & (F.col("k") == 1) & (F.col("direction") == "eng_2_de") & (F.col("ordinal") < 10)
    gone = (F.col("model") == "b") & (F.col("k") == 0) & (F.col("direction") == "fr_2_eng")
    hyps = d.select("doc_key", "direction", "ordinal", F.col("src").alias("pred"), runs.alias("r")).select("*", "r.*").where(~short & ~gone)
    scores = chrf_op.score_runs(hyps, corpus, STATUS_RUNS, ["model", "k"])
    ranks = report.rank_scores(scores).select("model", "k", "direction", "rank")
    good = F.count_if(F.col("status") == "ok").over(Window.partitionBy("model", "k"))
    return (scores.withColumn("run_ok", good).join(ranks, ["model", "k", "direction"], "left")
            .select("model", "k", "pair", "direction", "n_ref", "n_hyp", "status", "chrf", "rank", "run_ok"))


FILES_MODEL = "Demo-Files"


@register("prediction_files_scored")
def q_prediction_files_scored(spark, sf_dir):
    """S2, S7, S5, J3, A1 over files: the corpus and the copy-source predictions are written as JSONL files (a
    directory of parts each), numbered and read back by the library's own readers, and scored."""
    corpus = materialize(fixture_corpus(spark, sf_dir).where(F.col("subset") == "test"))  # both writers read it
    data, result = stored_path(spark, "corpus-files"), stored_path(spark, "prediction-files")
    sinks.write_corpus_jsonl(corpus, data)
    preds = expand_directions(corpus).select("pair", "direction", "ordinal", F.lit(1).alias("k"), F.col("src").alias("pred"))
    sinks.write_predictions_jsonl(sinks.run_layout(preds, FILES_MODEL), result)
    return jobs.score_run_files(spark, data, result, FILES_MODEL, 1)["scores"].select(*SCORE_COLS)


# --- few-shot selection, dialects, quick start ---------------------------------------


SWEEP_KS = [0, 1, 3, 8]
QUICKSTART_N = 50
SFT_LENGTH = 512
CHAT_USER = P.DEFAULT_CHAT_MARKUP["open"].replace("{role}", "user")
CHAT_END = P.DEFAULT_CHAT_MARKUP["close"]
COPY_USER = infer.CopyBetween(CHAT_USER, CHAT_END)
COPY_QUICKSTART = infer.CopyBetween(P.between(P.QUICKSTART_TEMPLATE, "system", "text"),
                                     P.between(P.QUICKSTART_TEMPLATE, "text", None))


@register("fewshot_select_first_k")
def q_fewshot_select_first_k(spark, sf_dir):
    """The first k in-band dev examples per direction for k in 0, 1, 3, 8."""
    corpus = fixture_corpus(spark, sf_dir)
    sel = fewshot.select_examples(corpus.where(F.col("subset") == "dev"), max(SWEEP_KS))
    d = expand_directions(sel).select("pair", "direction", "rank", "ordinal")
    return shot_sweep(d, SWEEP_KS).where(F.col("rank") <= F.col("k")).select(
        "pair", "direction", "k", "rank", "ordinal")


@register("fewshot_shortfall")
def q_fewshot_shortfall(spark, sf_dir):
    """Examples found vs needed per direction and k."""
    return fewshot.shortfall_report(fixture_corpus(spark, sf_dir), SWEEP_KS)


@register("fewshot_prompt_dialect2")
def q_fewshot_prompt_dialect2(spark, sf_dir):
    """example blocks with a trailing newline."""
    return fewshot.build_prompts(fixture_corpus(spark, sf_dir), [1], dialect="fewshot_nl").select(*PROMPT_COLS)


@register("bare_prompt")
def q_bare_prompt(spark, sf_dir):
    """zero-shot bare prompt (the document alone)."""
    return fewshot.build_prompts(fixture_corpus(spark, sf_dir), [0], dialect="bare").select(*PROMPT_COLS)


@register("fewshot_prompt_k3")
def q_fewshot_prompt_k3(spark, sf_dir):
    """F5 with up to three examples (k sweep reuses one selection)."""
    return fewshot.build_prompts(fixture_corpus(spark, sf_dir), [3]).select(*PROMPT_COLS)


@register("first_n_slice")
def q_first_n_slice(spark, sf_dir):
    """The first N documents of every split and pair, by a filter on the stored dense position."""
    first = first_documents(keyed_fixture_corpus(spark, sf_dir), QUICKSTART_N)
    return first.select("subset", "pair", "ordinal", (F.col("position") + 1).cast("int").alias("row"), F.length("src_txt").alias("src_chars"))


@register("quickstart_prompt")
def q_quickstart_prompt(spark, sf_dir):
    """First N dev documents of each pair -> F7 chat markup -> X1 -> table with pred_txt."""
    c = first_documents(keyed_fixture_corpus(spark, sf_dir).where(F.col("subset") == "dev"), QUICKSTART_N)
    a, b = pair_langs("pair")
    c = c.withColumn("prompt", P.quickstart_prompt(F.col("src_txt"), a, b))
    g = infer.generate(c, "prompt", COPY_QUICKSTART, ["subset", "pair", "ordinal"], batch_size=10)
    out = g.select("subset", "pair", "ordinal", "prompt", strip_ws("output").alias("pred_txt"))
    return out


@register("quickstart_csv")
def q_quickstart_csv(spark, sf_dir):
    """The quick start's CSV, written and read back: both texts and the prediction."""
    path = stored_path(spark, "quickstart")
    jobs.quickstart(keyed_fixture_corpus(spark, sf_dir), COPY_QUICKSTART, QUICKSTART_N, out_csv=path)
    return sinks.read_csv(spark, path, jobs.QUICKSTART_CSV)


@register("chat_messages_render")
def q_chat_messages_render(spark, sf_dir):
    """Single-user and system+user message lists rendered with chat markup."""
    pr = fewshot.build_prompts(fixture_corpus(spark, sf_dir), [1])
    pr = with_labels(pr)
    return pr.select(
        "pair", "direction", "ordinal",
        P.render_chat(P.user_messages(F.col("prompt"))).alias("user_chat"),
        P.render_chat(P.system_user_messages(F.col("src"), F.col("tgt_label"))).alias("system_chat"))


SAMPLING_RUNS = (
    ("greedy", dict(sampling=False, temperature=0.7, top_p=0.9, max_new_tokens=8000), 10),
    ("sampled", dict(sampling=True, temperature=0.7, top_p=0.9, max_new_tokens=5000), 16),
)


@register("sampling_params")
def q_sampling_params(spark, sf_dir):
    """The decoding parameters that reach the model, per direction and run configuration.

    Every test document is sent in both runs to a stand-in that answers with what it was given.
    """
    prompts = fewshot.build_prompts(fixture_corpus(spark, sf_dir), [0], dialect="bare")
    out = None
    for run, given, batch in SAMPLING_RUNS:
        g = infer.generate(prompts, "prompt", infer.EchoParameters(), ["pair", "direction"], batch, params=infer.run_parameters(**given))
        said = F.split("output", r"\|")
        g = g.select("pair", "direction", F.lit(run).alias("run"), (said[0] == "True").alias("sampling"), said[1].cast("double").alias("eff_temperature"),
                     said[2].cast("double").alias("eff_top_p"), said[3].cast("int").alias("max_new_tokens"), F.lit(batch).alias("batch_size")).distinct()
        out = g if out is None else out.unionByName(g)
    return out


@register("stop_and_clean")
def q_stop_and_clean(spark, sf_dir):
    """first line as prompt, the lines after it as model output cut at a line end, echo removed."""
    d = table(spark, sf_dir, "documents").select("doc_id", strip_ws("text").alias("gen"))
    prompt = F.split_part(F.col("gen"), F.lit("\n"), F.lit(1))
    output = F.substring(F.col("gen"), F.length(prompt) + 2, 1 << 30)
    return d.select("doc_id", clean_generation(F.concat(prompt, stop_cut(output, "\n")), prompt).alias("pred"))


@register("batch_infer")
def q_batch_infer(spark, sf_dir):
    """1-shot prompts rendered as chat, through a stand-in model in Arrow batches."""
    pr = fewshot.build_prompts(fixture_corpus(spark, sf_dir), [1])
    pr = pr.withColumn("chat", P.render_chat(P.user_messages(F.col("prompt"))))
    g = infer.predictions(pr, "chat", COPY_USER, ["pair", "direction", "ordinal"], batch_size=10)
    return g.select("pair", "direction", "ordinal", "pred")


@register("scrub_text")
def q_scrub_text(spark, sf_dir):
    """every third text gets a byte that begins no character at its end, every other third a cut
    character at its begin; undecodable bytes are replaced, good text stays."""
    d = table(spark, sf_dir, "documents")
    damage = F.pmod("doc_id", F.lit(3))
    raw = (F.when(damage == 1, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))))
            .when(damage == 2, F.concat(F.unhex(F.lit("C328")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary")))
    d = d.select("doc_id", raw.cast("string").alias("raw"))
    s = scrub("raw")
    return d.select("doc_id", F.length(s).alias("n_chars"), F.is_valid_utf8("raw").alias("was_valid"), F.md5(s).alias("scrubbed_md5"))


class FourCharacters:
    """Stand-in tokenizer: runs of four characters."""

    def __call__(self):
        return lambda text: [text[i:i + 4] for i in range(0, len(text), 4)]


@register("user_tokenizer")
def q_user_tokenizer(spark, sf_dir):
    """A tokenizer of the caller's own, loaded once per Python worker, over whole documents."""
    tok = sft.user_tokenizer(FourCharacters())
    d = table(spark, sf_dir, "documents").select("doc_id", tok(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


@register("sft_dataset")
def q_sft_dataset(spark, sf_dir):
    """F6 prompt, whitespace tokens, truncate/pad to 512, both directions."""
    t = sft.training_table(fixture_corpus(spark, sf_dir), max_length=SFT_LENGTH)
    return t.select("pair", "direction", "ordinal",
                    F.size("input_ids").alias("input_len"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.size(F.filter("labels", lambda x: x != F.lit(sft.PAD))).alias("n_label_real"),
                    F.md5(F.array_join("input_ids", " ")).alias("input_md5"),
                    F.md5(F.array_join("labels", " ")).alias("labels_md5"))


def _side_counts(spark, sf_dir, by_subset):
    """Documents per (subset,) language, with the English count beside every other language.

    Counts are a partial aggregate; the window runs over that tiny table only.
    """
    r = fixture_ranked_documents(spark, sf_dir)
    keys = []
    if by_subset:
        r = r.withColumn("subset", F.when(F.pmod(F.col("ordinal"), F.lit(5)) == 0, F.lit("dev")).otherwise(F.lit("test")))
        keys = ["subset"]
    c = r.groupBy(*keys, "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    c = c.withColumn("n_src", F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("n"))).over(w), F.lit(0)))
    return c.where(F.col("lang") != "en").select(
        *keys, F.concat(F.lit("eng_"), F.col("lang")).alias("pair"), "n_src", F.col("n").alias("n_tgt"))


@register("pair_strict_mismatch")
def q_pair_strict_mismatch(spark, sf_dir):
    """Per split and pair, English vs other-side document counts and the strict status."""
    return align_op.strict_check(_side_counts(spark, sf_dir, True))


@register("pair_truncating_zip")
def q_pair_truncating_zip(spark, sf_dir):
    """Pairs kept by the truncating zip and rows left over on each side, per pair."""
    counts = _side_counts(spark, sf_dir, False)
    pairs = fixture_corpus(spark, sf_dir).groupBy("pair").agg(F.count(F.lit(1)).alias("n_pairs"))
    return align_op.truncating_counts(counts, pairs, ["pair"])


# --- evaluation reports and the end-to-end job -------------------------------------


E2E = jobs.JobConfig(ks=[1], dialect="bare", chat="system_user", model=DEMO_MODEL,
                          expected_pairs=P.TASK_PAIRS)


def _e2e(spark, sf_dir, cfg=E2E):
    corpus = keyed_fixture_corpus(spark, sf_dir)
    return jobs.run_translation_job(spark, corpus, COPY_USER, cfg)


@register("end_to_end_scores")
def q_end_to_end_scores(spark, sf_dir):
    """Bare prompts -> system+user chat -> model (stand-in) -> clean -> align -> chrF -> rank."""
    out = _e2e(spark, sf_dir)
    return out["ranked"].select("pair", "direction", "k", "n_ref", "n_hyp", "status", "n_segments", "chrf", "rank")


E2E_FEWSHOT = jobs.JobConfig(ks=[1], dialect="fewshot", chat="user", model=DEMO_MODEL, expected_pairs=P.TASK_PAIRS)


@register("end_to_end_fewshot")
def q_end_to_end_fewshot(spark, sf_dir):
    """E1 with T1, J4, F5: few-shot prompts -> user chat -> model (stand-in) -> clean -> align -> chrF -> rank."""
    out = jobs.run_translation_job(spark, keyed_fixture_corpus(spark, sf_dir), infer.CopyLastSource(CHAT_USER, CHAT_END), E2E_FEWSHOT)
    return out["ranked"].select("pair", "direction", "k", "n_ref", "n_hyp", "status", "n_segments", "chrf", "rank")


@register("eval_coverage")
def q_eval_coverage(spark, sf_dir):
    """Every expected direction (task pairs and corpus pairs) with its reference/hypothesis status."""
    corpus = fixture_corpus(spark, sf_dir)
    refs = jobs.references(corpus, [1])
    hyps = corpus.where(F.col("subset") == "test").select("pair").distinct()
    hyps = expand_directions(hyps.withColumn("src_txt", F.lit("")).withColumn("tgt_txt", F.lit("")))
    hyps = hyps.where(F.col("src_lang") == "eng").select("direction")
    exp = jobs.expected_directions(spark, corpus, P.TASK_PAIRS)
    return align_op.coverage(exp, refs, hyps)


@register("coverage_of_run")
def q_coverage_of_run(spark, sf_dir):
    """J6, S7 over stored outputs: predictions of a run without one direction are written and read back; the
    references of one pair are missing."""
    corpus = fixture_corpus(spark, sf_dir)
    preds = expand_directions(corpus.where(F.col("subset") == "test")).where(F.col("direction") != "fr_2_eng")
    root = stored_path(spark, "predictions")
    sinks.write_predictions(sinks.run_layout(preds.select("pair", "direction", "ordinal", F.lit(1).alias("k"), F.col("src").alias("pred")), DEMO_MODEL), root)
    hyps = jobs.read_predictions(spark, root, E2E)
    refs = jobs.references(corpus.where(F.col("pair") != "eng_de"), [1])
    exp = jobs.expected_directions(spark, hyps.select("pair").unionByName(refs.select("pair")), P.TASK_PAIRS)
    return align_op.coverage(exp, refs, hyps)


LEDGER_RUN = jobs.JobConfig(ks=[0, 1], dialect="bare", chat="user", model=DEMO_MODEL, resume=True, commit_units=4, unit_rows=10_000)


@register("run_ledger")
def q_run_ledger(spark, sf_dir):
    """E1, S7 as a resumable run: what its ledger says of the committed units, and the predictions each holds."""
    root = stored_path(spark, "run")
    jobs.run_translation_job(spark, keyed_fixture_corpus(spark, sf_dir), COPY_USER, LEDGER_RUN, root)
    ledger = spark.read.schema(jobs.LEDGER).parquet(f"{root}/ledger")
    held = jobs.committed(spark, f"{root}/predictions", f"{root}/ledger").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_predictions"))
    return ledger.join(held, "unit_id", "left").select("unit", "model", "ks", "first_key", "last_key", "n_rows", "n_predictions")


@register("eval_tally")
def q_eval_tally(spark, sf_dir):
    """A3: successful and failed evaluations over the coverage table."""
    return report.tally(q_eval_coverage(spark, sf_dir))


@register("score_ranking_top5")
def q_score_ranking_top5(spark, sf_dir):
    """Directions ranked by chrF, top 5, with the score-table line."""
    d = copy_source_directions(spark, sf_dir)
    scores = chrf_op.chrf_by(d, "src", "tgt", ["pair", "src_lang", "tgt_lang", "direction"], ["ordinal"])
    top = report.rank_scores(scores.select("pair", "src_lang", "tgt_lang", "direction", "chrf"), 5)
    return report.score_lines(top, 1).select("rank", "pair", "direction", "chrf", "hyp_file", "line")


@register("reader_rejects")
def q_reader_rejects(spark, sf_dir):
    """S3-S6 on damaged lines made from every benchmark text: cut, glued, trailing, wrong type.

    Per line and reader whether it is taken and why not; nothing unreadable becomes a text.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.array("text")).alias("a"), F.to_json(F.struct("text")).alias("o"),
                                                 F.to_json(F.struct(F.col("text").alias("prompt"))).alias("p"))
    kinds = {"good": F.col("a"), "broken": F.expr("left(a, length(a) - 2)"), "glued": F.concat("a", "a"), "trailing": F.concat("a", F.lit(" tail")),
             "number": F.lit("[1]"), "null": F.lit("[null]"), "empty": F.lit("[]"), "object": F.col("o"), "objects": F.concat("o", "o"), "prompt": F.col("p")}
    lines = b.select("item_id", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds.values()))).alias("damage", "line"))
    v = F.col("line")
    s3, s4, s5 = readers.parse_strict(v), readers.parse_prompt(v), readers.parse_score(v)
    return lines.select("item_id", "damage", s3["error"].alias("strict_error"), s4["error"].alias("prompt_error"), s5["error"].alias("score_error"),
                        F.md5(F.coalesce(s3["text"], F.lit("-"))).alias("strict_md5"), F.md5(F.coalesce(s5["text"], F.lit("-"))).alias("score_md5"),
                        readers.parse_text_object(v).isNotNull().alias("paired"))


def _partners(spark, sf_dir):
    """The pairs of English with every other language, as a scalar subquery (one short array)."""
    other = table(spark, sf_dir, "documents").where(F.col("lang") != "en")
    return other.agg(F.collect_set(F.concat(F.lit("eng_"), F.col("lang")))).scalar()


@register("jsonl_ingest_zip")
def q_jsonl_ingest_zip(spark, sf_dir):
    """S2 -> S3 -> J1/D9: every document as a JSONL line of its language file, zipped back into pairs.

    Lines carry their keys (split, pair, language, line position) as the file
    layout would; blank lines would reject their pair without shifting it.
    """
    r = fixture_ranked_documents(spark, sf_dir)
    subset = F.when(F.pmod(F.col("ordinal"), F.lit(5)) == 0, F.lit("dev")).otherwise(F.lit("test"))
    # English lines appear once per pair file set (one copy per partner language).
    eng = r.where(F.col("lang") == "en").select(
        subset.alias("subset"), F.explode(_partners(spark, sf_dir)).alias("pair"),
        F.lit("eng").alias("lang"), "ordinal", jsonl_line(F.col("text")).alias("value"))
    oth = r.where(F.col("lang") != "en").select(
        subset.alias("subset"), F.concat(F.lit("eng_"), F.col("lang")).alias("pair"), "lang", "ordinal",
        jsonl_line(F.col("text")).alias("value"))
    parallel, rejects, check = zip_sides(eng.unionByName(oth))
    return parallel


@register("conversation_turns_render")
def q_conversation_turns_render(spark, sf_dir):
    """F10 per turn of every conversation; the generation cue follows each conversation's last turn.

    Turns are rendered where they are (no grouping of text); the last turn per
    conversation is a partial aggregate joined back on ``conv_id``.
    """
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    cue = P.DEFAULT_CHAT_MARKUP["generation_cue"]
    msg = P.render_message(F.col("role"), F.coalesce(F.col("text"), F.lit("")))
    return (c.join(last, "conv_id")
             .select("conv_id", "turn", "role",
                     F.when(F.col("turn") == F.col("_last"), F.concat(msg, F.lit(cue))).otherwise(msg)
                      .alias("rendered")))


@register("sft_text_pairs")
def q_sft_text_pairs(spark, sf_dir):
    """Every document as a ``{"text": ...}`` line of its language file, zipped per pair.

    English lines appear once per pair (its own file); texts are taken as the
    training reader sees them (not stripped).
    """
    r = fixture_ranked_documents(spark, sf_dir)
    obj = F.to_json(F.struct(F.col("text").alias("text")))
    src = r.where(F.col("lang") == "en").select(
        F.explode(_partners(spark, sf_dir)).alias("pair"), "ordinal", obj.alias("value"))
    tgt = r.where(F.col("lang") != "en").select(
        F.concat(F.lit("eng_"), F.col("lang")).alias("pair"), "ordinal", obj.alias("value"))
    good, rejects = readers.zip_text_objects(src, tgt, ["pair", "ordinal"])
    return good.select("pair", "ordinal", F.md5("src").alias("src_md5"), F.md5("tgt").alias("tgt_md5"),
                       F.length("src").alias("src_chars"), F.length("tgt").alias("tgt_chars"))


@register("fewshot_prompt_parity")
def q_fewshot_prompt_parity(spark, sf_dir):
    """D1 parity: the instruction keeps its literal ``{tgt_lbl}`` placeholder, as the reference wrote it."""
    return fewshot.build_prompts(fixture_corpus(spark, sf_dir), [1], parity=True).select(*PROMPT_COLS)


def _damaged(text: Column, ordinal: Column, cut: int, listed: int, number: int) -> Column:
    """A ``{"text"}`` line; every 7th, 11th and 13th from the given places is cut, a list or holds a number."""
    line = F.to_json(F.struct(text.alias("text")))
    return (F.when(F.pmod(ordinal, F.lit(7)) == cut, F.expr("left(_line, length(_line) - 2)"))
             .when(F.pmod(ordinal, F.lit(11)) == listed, F.concat(F.lit("["), line, F.lit("]")))
             .when(F.pmod(ordinal, F.lit(13)) == number, F.lit('{"text": 3}')).otherwise(line))


@register("paired_rejects")
def q_paired_rejects(spark, sf_dir):
    """S6, J2, F13 over files: every document as a ``{"text"}`` line of its training file, some lines damaged; all
    pairs are read in one pass, and each skipped pair comes with its 1-based line and the reason."""
    both = expand_directions(fixture_corpus(spark, sf_dir)).withColumn("_line", F.to_json(F.struct(F.col("src").alias("text"))))
    eng = F.col("src_lang") == "eng"
    value = F.when(eng, _damaged(F.col("src"), F.col("ordinal"), 3, 4, 5)).otherwise(_damaged(F.col("src"), F.col("ordinal"), 1, 4, 2))
    # One file per pair and language, its lines in key order; the pair's lines lie at the same places.
    lines = both.select("pair", F.col("src_lang").alias("lang"), "ordinal", value.alias("value"))
    root = stored_path(spark, "training-files")
    sinks.write_lines(lines, root, ["pair", "lang"])
    return readers.read_text_pair_tree(spark, root)[1]
