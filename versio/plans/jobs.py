"""End-to-end jobs (E1 full pipeline, E2 quick start, E3 training set).

One Spark job covers every pair, direction and shot count; the reference ran
one process per direction and reloaded the model for each. Stages hand over
DataFrames keyed by ``(pair, direction, k, ordinal)``; predictions are written
before scoring so the model runs exactly once per prompt.

A run reads the corpus once: its requests (key, source text, cost) and its
example sets are stored, cut into units of bounded size by key range, and the
prompts are rendered where the model runs. A resumable run commits waves of
units; the ledger, one row per committed unit, says which predictions count.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.text import strip_ws
from ..operators import align as align_op
from ..operators import chrf as chrf_op
from ..operators import fewshot, infer, report, sft
from ..operators.directions import expand_directions, pair_langs, pair_of, shot_sweep
from ..session import materialize, stored_path
from ..sources import sinks
from ..sources.corpus import LAYOUT_RE, first_documents
from ..sources.keyed import doc_key, layout, read_keyed
from ..sources.ordinals import dense_positions, join_ranks, rank_table
from ..sources.readers import read_scored

KEYS = ["pair", "src_lang", "tgt_lang", "direction", "k", "ordinal"]
LEDGER = "unit_id string, unit long, model string, ks string, first_key string, last_key string, n_rows long"


@dataclass
class JobConfig:
    ks: list[int] = field(default_factory=lambda: [1])
    dialect: str = "fewshot"           # fewshot | fewshot_nl | bare
    chat: str = "user"                 # user (F8) | system_user (F9) | none
    chat_markup: dict | None = None    # F10 markup strings (the model's template)
    stop: str | None = None            # F11; the reference default path used "\n\n"
    batch_size: int = 10
    model: str = "model"
    parity: bool = False
    expected_pairs: list[str] | None = None
    top: int = 5
    resume: bool = False               # commit in units; skip prompts already predicted under out_root
    commit_units: int = 8              # a resumable run has at least so many units, committed in ``waves``,
    unit_rows: int = 10_000            # and none of more than so many requests (document and direction)
    tasks: int | None = None           # tasks of equal cost that run the model (default: shuffle partitions)
    max_new_tokens: int = 256          # P10, handed to the engine
    sampling: bool = False
    temperature: float = 0.7
    top_p: float = 0.9


def model_input(prompts: DataFrame, cfg: JobConfig) -> DataFrame:
    """F8/F9 + F10: the text the model receives."""
    if cfg.chat == "none":
        return prompts.withColumn("model_input", F.col("prompt"))
    if cfg.chat == "system_user":
        msgs = P.system_user_messages(F.col("prompt"),
                                      P.label_of(F.col("tgt_lang"), labels=P.chat_labels(cfg.parity)))
    else:
        msgs = P.user_messages(F.col("prompt"))
    return prompts.withColumn("model_input", P.render_chat(msgs, cfg.chat_markup))


@dataclass
class Requests:
    """A run's stored prompts in normal form: ``documents`` (one row per document and direction, with its source
    text, its length and its unit) and ``sets`` (the example sets they name); None where no k needs examples."""
    documents: DataFrame
    sets: DataFrame | None
    units: list


def store_requests(corpus: DataFrame, cfg: JobConfig) -> Requests:
    """The requests of a run, stored once. Units are ranges of the key (pair, direction, position): of
    ``unit_rows`` requests at most, and at least ``commit_units`` of them."""
    tests = corpus.where(F.col("subset") == "test")
    if "position" not in tests.columns:
        tests = dense_positions(tests, ["subset", "pair"], "ordinal")
    # Rows per direction are those of its pair; their running sum numbers all requests (one row per direction).
    dirs = expected_directions(corpus.sparkSession, tests, None).withColumn("pair", pair_of(F.col("src_lang"), F.col("tgt_lang")))
    sizes = dirs.withColumn("direction", P.direction_name(F.col("src_lang"), F.col("tgt_lang"))).join(
        tests.groupBy("pair").agg(F.count(F.lit(1)).alias("_n")), "pair")
    before = Window.orderBy("pair", "direction").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy())
    rows = F.least(F.lit(cfg.unit_rows), F.greatest(F.lit(1), F.ceil(total / cfg.commit_units)))
    sizes = materialize(sizes.select("pair", "direction", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), rows.cast("long").alias("_rows")))
    unit = F.floor((F.col("_before") + F.col("position")) / F.col("_rows")).cast("long")
    requests = expand_directions(tests).join(F.broadcast(sizes), ["pair", "direction"])  # bounded: one row per direction
    requests = requests.select("pair", "src_lang", "tgt_lang", "direction", "ordinal", "src", F.length("src").alias("chars"), unit.alias("unit"))
    path = stored_path(corpus.sparkSession, "requests")
    requests.hint("rebalance", "unit").write.partitionBy("unit").parquet(path)
    documents = corpus.sparkSession.read.schema(requests.schema).parquet(path)
    key = F.struct("pair", "direction", "ordinal")
    units = documents.groupBy("unit").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect()
    sets = materialize(fewshot.example_sets(corpus, cfg.ks, cfg.dialect)) if cfg.dialect != "bare" and max(cfg.ks) > 0 else None
    return Requests(documents, sets, units)


def predict(requests: DataFrame, sets: DataFrame | None, engine_factory, cfg: JobConfig, carried: tuple = ()) -> DataFrame:
    """Requests (with ``k``) -> tasks of equal cost -> prompts -> model -> cleaned predictions keyed by ``KEYS``, each
    with the ``carried`` columns of its request."""
    cost = F.col("chars")
    if sets is not None:
        extra = sets.select("example_set_id", F.length(F.array_join("blocks", P.BLOCK_SEP)).alias("_extra"))
        named = requests.withColumn("example_set_id", fewshot.example_set_id(F.col("pair"), F.col("direction"), F.col("k")))
        requests = named.join(F.broadcast(extra), "example_set_id", "left")  # bounded: one number per direction and k
        cost = cost + F.coalesce("_extra", F.lit(0))
    tasks = cfg.tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = infer.balanced(requests.select(*KEYS, *carried, "src", cost.cast("long").alias("cost")), "cost", KEYS, tasks)
    mi = model_input(fewshot.render_prompts(dealt, sets, cfg.dialect, cfg.parity), cfg)
    params = infer.run_parameters(cfg.max_new_tokens, cfg.sampling, cfg.temperature, cfg.top_p)
    return infer.predictions(mi, "model_input", engine_factory, [*KEYS, *carried], cfg.batch_size, cfg.stop, params=params)


def run_predictions(corpus: DataFrame, engine_factory, cfg: JobConfig) -> DataFrame:
    """Prompts -> model -> cleaned predictions keyed by ``KEYS``, for a whole corpus at once."""
    made = store_requests(corpus, cfg)
    return predict(shot_sweep(made.documents, cfg.ks), made.sets, engine_factory, cfg)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, root: str, ledger: str | None) -> DataFrame:
    """Stored predictions that count: those of runs that are no units, and of units that the ledger names. What a
    crashed unit has left behind is in neither."""
    preds = read_keyed(spark, root)
    ids = spark.createDataFrame([("",)], "unit_id string")
    if ledger and _exists(spark, ledger):
        ids = ids.unionByName(spark.read.schema(LEDGER).parquet(ledger).select("unit_id"))
    return preds.join(F.broadcast(ids), "unit_id", "left_semi")  # bounded: one short id per unit


def read_predictions(spark: SparkSession, root: str, cfg: JobConfig, ledger: str | None = None) -> DataFrame:
    """Predictions of this model and these shots from the run layout: ``doc_key``, ``KEYS``, ``pred``."""
    return (committed(spark, root, ledger)
            .where((F.col("model") == P.model_dir_name(F.lit(cfg.model)))
                   & F.col("shot").isin([f"shot{k}" for k in cfg.ks]))
            .withColumn("k", F.regexp_extract("shot", r"^shot(\d+)$", 1).cast("int"))
            .withColumn("src_lang", F.split_part("direction", F.lit("_2_"), F.lit(1)))
            .withColumn("tgt_lang", F.split_part("direction", F.lit("_2_"), F.lit(2)))
            .select("doc_key", *KEYS, "pred"))


#: Units that one write takes at most.
WAVE_UNITS = 32


def waves(units: list, most: int = WAVE_UNITS) -> list[list]:
    """``units`` in order, in waves of 1, 1, 2, 4, ... up to ``most``: each as large as all before it."""
    out, a = [], 0
    while a < len(units):
        out.append(units[a : a + min(most, max(1, a))])
        a += len(out[-1])
    return out


def commit_units(spark: SparkSession, made: Requests, engine_factory, cfg: JobConfig, root: str, ledger: str) -> None:
    """The resumable run: predictions are written and then their units named in the ledger, one row each. Units
    read their own rows of the stored requests; prompts with a committed prediction are not sent again.

    A write takes a wave of units, so that its jobs and files do not multiply with the units: a crash loses the wave
    that runs, which is never more than is committed already, nor more than ``WAVE_UNITS`` units."""
    todo, done = made.units, None
    if layout(spark, root) is not None:  # keys only, fixed before this run appends
        done = materialize(read_predictions(spark, root, cfg, ledger).select(*KEYS))
        open_units = infer.pending(shot_sweep(made.documents, cfg.ks), done, KEYS).select("unit").distinct()
        left = {r.unit for r in open_units.collect()}  # bounded: one number per unit
        todo = [u for u in todo if u.unit in left]
    model = cfg.model.split("/")[-1]
    for wave in waves(todo):
        asked = shot_sweep(made.documents.where(F.col("unit").isin([u.unit for u in wave])), cfg.ks)
        if done is not None:
            asked = infer.pending(asked, done, KEYS)
        ids = {u.unit: uuid.uuid4().hex for u in wave}
        names = F.create_map(*[x for u, name in ids.items() for x in (F.lit(u).cast("long"), F.lit(name))])
        preds = predict(asked, made.sets, engine_factory, cfg, ("unit",))
        preds = preds.withColumn("unit_id", F.element_at(names, F.col("unit"))).drop("unit")
        sinks.write_predictions(sinks.run_layout(preds, cfg.model), root, mode="append")
        rows = []
        for u in wave:
            key = ["/".join(map(str, (x.pair, x.direction, x.ordinal))) for x in (u.first, u.last)]
            rows.append((ids[u.unit], u.unit, model, ",".join(map(str, cfg.ks)), *key, u.n))
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(ledger)


def references(corpus: DataFrame, ks: list[int]) -> DataFrame:
    d = expand_directions(corpus.where(F.col("subset") == "test"))
    d = d.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return d.select(*KEYS, F.col("tgt").alias("ref"))


def score(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """J3 + A1 per (pair, direction, k): alignment check and corpus chrF."""
    groups = ["pair", "src_lang", "tgt_lang", "direction", "k"]
    return chrf_op.score_aligned(preds, refs, KEYS, groups)


def expected_directions(spark: SparkSession, corpus: DataFrame, extra_pairs: list[str] | None) -> DataFrame:
    """Both directions of every pair present in ``corpus`` (any frame with ``pair``) and of ``extra_pairs``."""
    pairs = corpus.select("pair").distinct()
    if extra_pairs:
        pairs = pairs.unionByName(spark.createDataFrame([(p,) for p in extra_pairs], "pair string")).distinct()
    a, b = pair_langs("pair")
    return pairs.select(F.explode(F.array(F.struct(a.alias("src_lang"), b.alias("tgt_lang")),
                                          F.struct(b.alias("src_lang"), a.alias("tgt_lang")))).alias("d")).select("d.*")


def run_translation_job(spark: SparkSession, corpus: DataFrame, engine_factory, cfg: JobConfig,
                        out_root: str | None = None) -> dict[str, DataFrame]:
    """Corpus -> prompts -> predictions -> scores -> coverage, ranking, top-k.

    With ``out_root`` predictions and the score table are written
    (``predictions/`` partitioned by pair, model, shot, direction; ``scores/``
    TSV; ``ledger/`` of a resumable run); otherwise predictions are stored in
    the shared folder. With ``cfg.resume`` predictions are committed in units, and
    a run over an existing ``out_root`` sends only prompts without a committed
    prediction to the model. Over a keyed corpus (``corpus.write_keyed_corpus``)
    scoring exchanges no text.
    """
    root = f"{out_root}/predictions" if out_root else stored_path(spark, "predictions")
    ledger = f"{out_root}/ledger" if out_root else None
    made = store_requests(corpus, cfg)
    if out_root and cfg.resume:
        commit_units(spark, made, engine_factory, cfg, root, ledger)
    else:
        preds = predict(shot_sweep(made.documents, cfg.ks), made.sets, engine_factory, cfg)
        sinks.write_predictions(sinks.run_layout(preds, cfg.model), root, mode="overwrite")
    # Directions of an earlier, larger corpus may still lie there; they are no part of this run.
    run = corpus.where(F.col("subset") == "test").select("pair").distinct()
    preds = read_predictions(spark, root, cfg, ledger)
    keyed = corpus if "doc_key" in corpus.columns else corpus.withColumn("doc_key", doc_key())
    scores = chrf_op.score_runs(preds, keyed, [(k,) for k in cfg.ks], ["k"])
    preds = preds.select(*KEYS, "pred").join(F.broadcast(run), "pair", "left_semi")  # bounded: one row per pair
    if out_root:
        scores = materialize(scores)
    ranked = report.rank_scores(scores)
    expected = expected_directions(spark, corpus, cfg.expected_pairs).withColumn("k", F.explode(F.array(*[F.lit(k) for k in cfg.ks])))
    cov = report.evaluated(align_op.coverage(expected, references(corpus, cfg.ks), preds), scores)
    out = {
        "predictions": preds,
        "scores": scores,
        "ranked": ranked,
        "top": report.rank_scores(scores, cfg.top),
        "coverage": cov,
        "tally": report.tally(cov),
    }
    if out_root:
        lines = report.score_lines(sinks.run_layout(scores, cfg.model)).select(
            "pair", "direction", "hyp_file", F.col("n_ref").alias("n_docs"), "status", "chrf", "model", "shot")
        sinks.write_scores(lines, f"{out_root}/scores")
    return out


QUICKSTART_CSV = "subset string, pair string, src_txt string, tgt_txt string, pred_txt string"


def quickstart(corpus: DataFrame, engine_factory, n: int = 50, subset: str = "dev",
               pair: str | None = None, batch_size: int = 10, out_csv: str | None = None) -> DataFrame:
    """First ``n`` documents (per pair) -> F7 prompt -> model -> ``pred_txt`` (-> CSV).

    Over a keyed corpus the first ``n`` are a pushed filter; else positions are ranked on keys first.
    """
    c = corpus.where(F.col("subset") == subset)
    if pair:
        c = c.where(F.col("pair") == pair)
    if n:                                   # falsy n = every document (P9)
        c = first_documents(c if "position" in c.columns else dense_positions(c, ["subset", "pair"], "ordinal"), n)
    a, b = pair_langs("pair")
    c = c.withColumn("prompt", P.quickstart_prompt(F.col("src_txt"), a, b))
    g = infer.generate(c, "prompt", engine_factory, ["subset", "pair", "ordinal", "src_txt", "tgt_txt"], batch_size)
    out = g.select("subset", "pair", "ordinal", "src_txt", "tgt_txt", strip_ws("output").alias("pred_txt"))
    if out_csv:
        out = materialize(out)
        sinks.write_csv(out.drop("ordinal"), out_csv)
    return out


def build_training_set(pairs: DataFrame, max_length: int = 512, tokenize=None,
                       out_path: str | None = None) -> DataFrame:
    """Both directions of every pair -> F6 -> tokens -> fixed length; written by pair."""
    t = sft.training_table(pairs, max_length, tokenize)
    if out_path:
        (t.hint("rebalance", "pair")
          .write.mode("overwrite").partitionBy("pair").parquet(out_path))
    return t



def _scored_positions(spark: SparkSession, root: str, matching: str) -> DataFrame:
    """S5 over files: ``_file, pos, text`` with ``pos`` the 0-based position among
    the file's non-blank lines (the reader drops blank lines before zipping)."""
    lines, _ = read_scored(spark, root, strict=True, matching=matching, positions=True)
    return lines.select("_file", "pos", "text")


def score_run_files(spark: SparkSession, data_root: str, result_root: str, model: str, k: int = 1,
                    split: str = "test", expected_pairs: list[str] | None = None) -> dict[str, DataFrame]:
    """Score an existing run laid out as files (the evaluation script's layout).

    References: ``<data_root>/<split>/<pair>/doc.<lang>.jsonl``; hypotheses:
    ``<result_root>/<pair>/<model>/shot<k>/<src>_2_<tgt>/doc.<src>_2_<tgt>.<k>.pred.jsonl``;
    or the directories of parts that ``sinks.write_corpus_jsonl`` and
    ``sinks.write_predictions_jsonl`` write. Lines are read with the score
    dialect (S5) and aligned by position among non-blank lines, per direction
    (J3). Returns ``scores`` (with the TSV ``line``), ``coverage`` (J6) and
    ``tally`` (A3).
    """
    f = F.col("_file")
    run = rf"/(?:model=)?\Q{model}\E/(?:shot=)?shot{int(k)}/(?:direction=)?([^/]+?)_2_([^/.]+)(?:/doc\.[^/]+\.{int(k)}\.pred\.jsonl)?$"
    h = _scored_positions(spark, result_root, run)
    hyps = h.select(F.regexp_extract(f, run, 1).alias("src_lang"), F.regexp_extract(f, run, 2).alias("tgt_lang"), "pos",
                    F.col("text").alias("pred"))
    hyps = hyps.withColumn("pair", pair_of(F.col("src_lang"), F.col("tgt_lang")))
    r = _scored_positions(spark, data_root, LAYOUT_RE.replace("(?:subset=)?([^/]+)", rf"(?:subset=)?(\Q{split}\E)", 1))
    pair = F.regexp_extract(f, LAYOUT_RE, 2)
    lang = F.concat(F.regexp_extract(f, LAYOUT_RE, 3), F.regexp_extract(f, LAYOUT_RE, 4))
    a, b = pair_langs(pair)
    refs = r.select(pair.alias("pair"), F.when(lang == b, a).otherwise(b).alias("src_lang"),
                    lang.alias("tgt_lang"), "pos", F.col("text").alias("ref"))
    hyps = hyps.withColumn("direction", P.direction_name(F.col("src_lang"), F.col("tgt_lang")))
    refs = refs.withColumn("direction", P.direction_name(F.col("src_lang"), F.col("tgt_lang")))
    groups = ["pair", "src_lang", "tgt_lang", "direction"]
    scores = chrf_op.score_aligned(hyps, refs, groups + ["pos"], groups)
    scores = report.score_lines(scores, k)
    present = refs.select("pair").unionByName(hyps.select("pair"))
    cov = report.evaluated(align_op.coverage(expected_directions(spark, present, expected_pairs), refs, hyps), scores)
    return {"scores": scores, "coverage": cov, "tally": report.tally(cov)}


__all__ = ["JobConfig", "run_translation_job", "quickstart", "build_training_set", "score_run_files"]
