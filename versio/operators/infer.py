"""Batch inference through a user-supplied model function.

The model is reached through ``engine_factory``: a zero-argument callable,
pickled to the executors, that returns ``generate(list[str]) -> list[str]``
(model outputs, without the prompt). The engine is built once per Python
worker and reused by every task and every direction that worker runs.
Arrow batches from ``mapInPandas`` are cut into model batches of
``batch_size`` prompts. No model ships with the library.

Inference is the costly, non-idempotent stage: write (``sinks.write_predictions``)
or ``session.materialize`` its output before anything reads it twice.
``pending`` turns a partial run into a resumable one: it anti-joins the
prompts against predictions already written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from inspect import signature

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_generation, stop_cut
from ..functions.worker import resource, resource_key

def run_parameters(max_new_tokens: int, sampling: bool, temperature: float, top_p: float) -> dict:
    """P10 for one run: greedy unless sampling is on (temperature 0, top_p 1)."""
    return {"max_new_tokens": max_new_tokens, "sampling": bool(sampling),
            "temperature": float(temperature) if sampling else 0.0, "top_p": float(top_p) if sampling else 1.0}


#: Bins of the cost histogram for each doubling of the cost.
BINS = 16


def balanced(df: DataFrame, cost: str, keys: list[str], tasks: int) -> DataFrame:
    """``df`` dealt into ``tasks`` partitions of about equal total ``cost``, each sorted by cost, longest first.

    A histogram of the costs (a few hundred bins, whatever the input) gives the running cost before each bin; a row's
    place on that axis is its bin's begin plus a share of the bin drawn from its keys, and the axis is cut into
    equal parts. So a split or a direction that holds most of the work is spread over all tasks, a task's prompts
    are of similar length (the model pads a batch to its longest), and every row keeps its keys.
    """
    bin_of = F.floor(F.log2(F.greatest(F.col(cost), F.lit(1)).cast("double")) * BINS).cast("int")
    bins = df.select(bin_of.alias("bin"), F.greatest(F.col(cost), F.lit(1)).alias("c")).groupBy("bin").agg(F.sum("c").cast("double").alias("c")).orderBy("bin").collect()
    total, before, places = sum(r.c for r in bins), 0.0, []
    for r in bins:
        places += [F.lit(r.bin), F.struct(F.lit(before / total).alias("at"), F.lit(r.c / total).alias("of"))]
        before += r.c
    if not places:
        return df
    place = F.element_at(F.create_map(*places), bin_of)
    share = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    task = F.least(F.floor((place["at"] + place["of"] * share) * tasks), F.lit(tasks - 1)).cast("int")
    return df.withColumn("_task", task).repartitionById(tasks, "_task").drop("_task").sortWithinPartitions(F.desc(cost))


def generate(df: DataFrame, prompt_col: str, engine_factory, keys: list[str],
             batch_size: int = 10, out_col: str = "output", params: dict | None = None) -> DataFrame:
    """``keys + [prompt_col, out_col]``; the prediction stays on its row.

    An engine that takes a second argument gets the run's ``params``. A row
    without a prompt is not sent and has no output.
    """
    base = df.select(*keys, prompt_col)
    fields = [f for f in base.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` string"
    key = resource_key(engine_factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = resource(engine_factory, key)
        call = (lambda x: gen(x, params or {})) if len(signature(gen).parameters) > 1 else gen
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):  # each model batch goes on as soon as it is done
                out = pdf.iloc[i:i + batch_size].reset_index(drop=True)
                asked = out[prompt_col].notna()
                chunk = out.loc[asked, prompt_col].tolist()
                res = list(call(chunk)) if chunk else []
                if len(res) != len(chunk):
                    raise RuntimeError(f"engine returned {len(res)} outputs for {len(chunk)} prompts")
                out[out_col] = pd.Series(res, index=out.index[asked], dtype="object")
                yield out

    return base.mapInPandas(run, schema)


def predictions(df: DataFrame, prompt_col: str, engine_factory, keys: list[str],
                batch_size: int = 10, stop: str | None = None, out_col: str = "pred",
                params: dict | None = None) -> DataFrame:
    """X1 + F11 + F12: ``keys + [out_col]``.

    ``stop`` cuts each output at its first occurrence (the reference default
    path used ``"\\n\\n"``); the clean-up removes every occurrence of the prompt
    from prompt + output and strips, as the reference does.
    """
    g = generate(df, prompt_col, engine_factory, keys, batch_size, params=params)
    cut = stop_cut(F.col("output"), stop)
    return g.select(*keys, clean_generation(F.concat(F.col(prompt_col), cut), F.col(prompt_col)).alias(out_col))


def pending(prompts: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: prompts whose keys have no prediction yet."""
    return prompts.join(written.select(*keys), keys, "left_anti")


# --- deterministic stand-in engines (tests, fixtures, dry runs) ---------------------

class CopyBetween:
    """Stand-in model: returns the text between the last ``open`` marker and the
    next ``close`` marker of the prompt (e.g. the user message of a rendered
    chat). With no marker it returns the prompt."""

    def __init__(self, open_marker: str, close_marker: str):
        self.open_marker = open_marker
        self.close_marker = close_marker

    def __call__(self) -> Callable[[list[str]], list[str]]:
        o, c = self.open_marker, self.close_marker

        def gen(prompts: list[str]) -> list[str]:
            out = []
            for p in prompts:
                i = p.rfind(o)
                if i < 0:
                    out.append(p)
                    continue
                body = p[i + len(o):]
                j = body.find(c)
                out.append(body if j < 0 else body[:j])
            return out

        return gen


class CopyLastSource(CopyBetween):
    """Stand-in model for few-shot prompts: finds the last message's last labelled source among its
    example blocks and returns it."""

    def __call__(self) -> Callable[[list[str]], list[str]]:
        message = super().__call__()
        return lambda prompts: [m.split("\n\n")[-2].split(": ", 1)[1] for m in message(prompts)]


class EchoParameters:
    """Stand-in model: answers every prompt with the run parameters it was given."""

    def __call__(self) -> Callable[[list[str], dict], list[str]]:
        def gen(prompts: list[str], params: dict) -> list[str]:
            said = "|".join(str(params[k]) for k in ("sampling", "temperature", "top_p", "max_new_tokens"))
            return [said] * len(prompts)

        return gen
