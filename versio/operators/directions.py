"""Directions and run parameters.

A pair ``eng_x`` yields two directions, ``eng -> x`` and ``x -> eng``; rows
swap their source and target columns. Expansion is a projection + explode,
so it never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import direction_name, label_of


def pair_langs(pair: Column | str) -> tuple[Column, Column]:
    """``eng_x`` -> (``eng``, ``x``)."""
    p = F.col(pair) if isinstance(pair, str) else pair
    return F.split_part(p, F.lit("_"), F.lit(1)), F.split_part(p, F.lit("_"), F.lit(2))


def pair_of(src_lang: Column, tgt_lang: Column, eng_code: str = "eng") -> Column:
    """P4 back: the non-English side gives the pair."""
    return F.concat(F.lit(eng_code + "_"), F.when(src_lang == eng_code, tgt_lang).otherwise(src_lang))


def expand_directions(df: DataFrame, src_col: str = "src_txt", tgt_col: str = "tgt_txt",
                      pair_col: str = "pair") -> DataFrame:
    """Each pair row becomes an ``eng->x`` and an ``x->eng`` row.

    Output adds ``src_lang, tgt_lang, direction, src, tgt`` and drops the two
    text columns. Only a side index is exploded; languages and texts are
    chosen in the projection after it, so a consumer that does not read the
    texts lets Catalyst prune them from the scan, and no text is copied into
    intermediate structs.
    """
    a, b = pair_langs(pair_col)
    rest = [c for c in df.columns if c not in (src_col, tgt_col)]
    d = df.select(*rest, src_col, tgt_col, F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"))
    fwd = F.col("_side") == 0
    src_lang = F.when(fwd, a).otherwise(b)
    tgt_lang = F.when(fwd, b).otherwise(a)
    return d.select(*rest, src_lang.alias("src_lang"), tgt_lang.alias("tgt_lang"),
                    direction_name(src_lang, tgt_lang).alias("direction"),
                    F.when(fwd, F.col(src_col)).otherwise(F.col(tgt_col)).alias("src"),
                    F.when(fwd, F.col(tgt_col)).otherwise(F.col(src_col)).alias("tgt"))


def english_side(src_lang: Column, tgt_lang: Column, src: Column, tgt: Column,
                 eng_code: str = "eng") -> Column:
    """P5: the English text of a row; null when neither side is English."""
    return F.when(src_lang == eng_code, src).when(tgt_lang == eng_code, tgt)


def with_labels(df: DataFrame, src_override: str | None = None, tgt_override: str | None = None,
                labels: dict[str, str] | None = None) -> DataFrame:
    """P1 on a directions frame: ``src_label``, ``tgt_label``."""
    so = F.lit(src_override) if src_override else None
    to = F.lit(tgt_override) if tgt_override else None
    return (df.withColumn("src_label", label_of(F.col("src_lang"), so, labels))
              .withColumn("tgt_label", label_of(F.col("tgt_lang"), to, labels)))


def shot_sweep(df: DataFrame, ks: list[int], col: str = "k") -> DataFrame:
    """One copy of each row per shot count (a literal array, no join)."""
    if any(k < 0 for k in ks):
        raise ValueError("few_shot must be >= 0")
    return df.withColumn(col, F.explode(F.array(*[F.lit(int(k)) for k in ks])))


def resolve_sampling(cfg: DataFrame) -> DataFrame:
    """P10: greedy unless sampling is on (temperature 0, top_p 1)."""
    s = F.coalesce(F.col("sampling"), F.lit(False))
    return (cfg.withColumn("eff_temperature", F.when(s, F.col("temperature")).otherwise(F.lit(0.0)))
               .withColumn("eff_top_p", F.when(s, F.col("top_p")).otherwise(F.lit(1.0))))
