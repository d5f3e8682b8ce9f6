"""Few-shot example selection and prompt assembly.

Plan shape, for every direction in one job:

* T1: dev rows whose English side has 101..200 words, first ``k_max`` per pair
  in ordinal order: ``row_number() <= k`` lets Catalyst plan a partial
  ``WindowGroupLimit`` before the exchange, so each task ships at most k rows
  per pair. Both directions of a pair select the same rows (the band is
  measured on the English side), so selection runs per pair and directions
  are expanded after it.
* Example blocks are rendered once per direction and collected into one row
  per direction: at most ``k_max`` blocks, a bound fixed by construction.
* J4: that table (directions x 1 row) is broadcast to the test documents; a
  left join keeps documents of a direction with no examples.
* P3: the k sweep reuses the max-k selection and slices it, so the corpus is
  scanned once for every k.
* F5 in normal form: ``example_sets`` and the requests that name them can be
  stored apart; ``render_prompts`` puts them together where the model runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.text import in_word_band, word_count
from .directions import english_side, expand_directions, pair_langs, shot_sweep, with_labels

DIALECTS = ("fewshot", "fewshot_nl", "bare")


def select_examples(dev: DataFrame, k_max: int, low: int = 100, high: int = 200,
                    eng_code: str = "eng") -> DataFrame:
    """T1 on a corpus split: ``pair, rank, ordinal, src_txt, tgt_txt`` (rank 1..k_max).

    Only keys are ranked and shuffled; the texts of the few chosen keys are
    fetched by a join (at most k_max rows per pair).
    """
    if k_max < 0:
        raise ValueError("few_shot must be >= 0")
    a, b = pair_langs("pair")
    eng = english_side(a, b, F.col("src_txt"), F.col("tgt_txt"), eng_code)
    cand = dev.where(eng.isNotNull() & in_word_band(word_count(eng), low, high))
    w = Window.partitionBy("pair").orderBy("ordinal")
    chosen = cand.select("pair", "ordinal", F.row_number().over(w).alias("rank")).where(F.col("rank") <= F.lit(k_max))
    return (dev.select("pair", "ordinal", "src_txt", "tgt_txt").join(chosen, ["pair", "ordinal"])
               .select("pair", "ordinal", "src_txt", "tgt_txt", "rank"))


def example_blocks(selected: DataFrame, dialect: str = "fewshot", labels: dict | None = None,
                   src_label: str | None = None, tgt_label: str | None = None) -> DataFrame:
    """Per direction: ``pair, direction, blocks array<string>`` ordered by rank."""
    d = with_labels(expand_directions(selected), src_label, tgt_label, labels)
    block = P.example_block(F.col("src"), F.col("tgt"), F.col("src_label"), F.col("tgt_label"),
                            trailing_newline=(dialect == "fewshot_nl"))
    per_dir = (d.groupBy("pair", "direction")
                .agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), block.alias("b")))).alias("_ex")))
    return per_dir.select("pair", "direction", F.transform("_ex", lambda e: e["b"]).alias("blocks"))


def example_sets(corpus: DataFrame, ks: list[int], dialect: str = "fewshot", labels: dict | None = None,
                 src_label: str | None = None, tgt_label: str | None = None, example_subset: str = "dev") -> DataFrame:
    """``example_set_id, blocks``: the rendered examples of every direction and shot count, at most ``k`` blocks a row.

    With the requests that name them this is a run's prompts in normal form:
    no example is stored once per document.
    """
    sel = select_examples(corpus.where(F.col("subset") == example_subset), max(ks))
    blocks = example_blocks(sel, dialect, labels, src_label, tgt_label)
    return shot_sweep(blocks, [k for k in ks if k > 0]).select(
        example_set_id(F.col("pair"), F.col("direction"), F.col("k")).alias("example_set_id"), F.slice("blocks", 1, F.col("k")).alias("blocks"))


def example_set_id(pair: Column, direction: Column, k: Column) -> Column:
    return F.concat_ws("/", pair, direction, k.cast("string"))


def render_prompts(requests: DataFrame, sets: DataFrame | None, dialect: str = "fewshot", parity: bool = False,
                   labels: dict | None = None, src_label: str | None = None, tgt_label: str | None = None) -> DataFrame:
    """``requests`` (``pair, src_lang, tgt_lang, direction, k, src, ...``) with ``prompt``; J4: the example sets are
    broadcast (one row per direction and shot count, at most k blocks each), a request without one keeps none."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    asked = with_labels(requests, src_label, tgt_label, labels)
    final = P.final_block(F.col("src"), F.col("src_label"), F.col("tgt_label"), bare=(dialect == "bare"))
    if dialect == "bare":
        prompt = final
    else:
        blocks = F.lit(None)
        if sets is not None:
            asked = asked.withColumn("example_set_id", example_set_id(F.col("pair"), F.col("direction"), F.col("k")))
            asked = asked.join(F.broadcast(sets), "example_set_id", "left")
            blocks = F.col("blocks")
        prompt = P.fewshot_prompt(blocks, final, P.instruction(F.col("tgt_label"), parity))
    return asked.withColumn("prompt", prompt).drop("example_set_id", "blocks")


def build_prompts(corpus: DataFrame, ks: list[int] | int = 1, dialect: str = "fewshot",
                  parity: bool = False, labels: dict | None = None,
                  src_label: str | None = None, tgt_label: str | None = None,
                  test_subset: str = "test", example_subset: str = "dev") -> DataFrame:
    """Prompts for every test document of every direction and every k.

    Output: ``pair, src_lang, tgt_lang, direction, k, ordinal, src, tgt, prompt``.
    """
    ks = [ks] if isinstance(ks, int) else list(ks)
    tests = shot_sweep(expand_directions(corpus.where(F.col("subset") == test_subset)), ks)
    sets = None
    if dialect != "bare" and max(ks) > 0:
        sets = example_sets(corpus, ks, dialect, labels, src_label, tgt_label, example_subset)
    return render_prompts(tests, sets, dialect, parity, labels, src_label, tgt_label).select(
        "pair", "src_lang", "tgt_lang", "direction", "k", "ordinal", "src", "tgt", "prompt")


def shortfall_report(corpus: DataFrame, ks: list[int], example_subset: str = "dev") -> DataFrame:
    """Per direction and k, examples found vs needed.

    Output: ``pair, direction, k, n_found, shortfall``.
    """
    k_max = max(ks)
    pairs = corpus.select("pair").distinct()
    dirs = expand_directions(pairs.withColumn("src_txt", F.lit(None).cast("string"))
                                  .withColumn("tgt_txt", F.lit(None).cast("string")))
    dirs = shot_sweep(dirs.select("pair", "direction"), ks)
    sel = select_examples(corpus.where(F.col("subset") == example_subset), k_max)
    found = sel.groupBy("pair").agg(F.count(F.lit(1)).alias("_avail"))
    out = dirs.join(found, "pair", "left").select(
        "pair", "direction", "k",
        F.least(F.coalesce(F.col("_avail"), F.lit(0)), F.col("k")).alias("n_found"))
    return out.withColumn("shortfall", F.col("n_found") < F.col("k"))
