"""Fine-tuning-set preparation (E3: S6 -> F13 -> P2 -> F6 -> X2 -> F14 -> U1).

The output is the training table; model training itself is not data work
and is not built. Tokens default to whitespace tokens (JVM-side); a model
tokenizer is a user callable run by an Iterator pandas UDF (X2), loaded once
per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import sft_prompt
from ..functions.text import WS, strip_ws
from ..functions.worker import resource, resource_key
from .directions import expand_directions

PAD = "<pad>"


def whitespace_tokens(c: Column) -> Column:
    """Default tokenizer: ``str.split()`` tokens."""
    t = strip_ws(c)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, WS + "+", -1))


#: Characters of the texts whose tokens a worker holds at once (a longer text is held alone): a token is an object of
#: its own, some twenty times the size of its characters.
TOKEN_CHARS = 1 << 19


def pieces(texts: pd.Series, limit: int = TOKEN_CHARS) -> Iterator[pd.Series]:
    """``texts`` in order, cut into runs of about ``limit`` characters, one text at least."""
    ends = np.cumsum([0 if x is None else len(x) for x in texts])
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield texts.iloc[a:z]
        a = z


def user_tokenizer(factory: Callable[[], Callable[[str], list]], element: str = "string") -> Callable:
    """Wrap ``factory() -> tokenize(str) -> list`` as an Iterator pandas UDF.

    A batch of rows goes back in pieces of about ``TOKEN_CHARS`` characters, so a worker's memory does not
    follow the rows that Spark puts into a batch."""
    rtype = T.ArrayType(T.StringType() if element == "string" else T.LongType())
    key = resource_key(factory)

    @F.pandas_udf(rtype)
    def tok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = resource(factory, key)      # loaded once per Python worker
        for batch in batches:
            for s in pieces(batch):
                yield s.map(lambda x: list(fn(x)) if x is not None else None)

    return tok


def pad_to(tokens: Column, length: int, pad: Column | None = None) -> Column:
    """truncate to ``length``, then pad to exactly ``length``."""
    pad = pad if pad is not None else F.lit(PAD)
    t = F.slice(tokens, 1, length)
    return F.concat(t, F.array_repeat(pad, F.greatest(F.lit(length) - F.size(t), F.lit(0))))


def attention_mask(tokens: Column, length: int) -> Column:
    n = F.least(F.size(tokens), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def training_table(pairs: DataFrame, max_length: int = 512, tokenize: Callable[[Column], Column] | None = None,
                   pad: str | int = PAD, label_pad: str | int | None = None) -> DataFrame:
    """Both directions of every pair row -> one training row each (U1 by explode).

    Input: ``pair, ordinal, src_txt, tgt_txt`` (+ any key columns).
    Output adds ``src_lang, tgt_lang, direction, prompt, input_ids, attention_mask, labels``.
    Labels are padded with ``pad`` as in the reference (D12) unless
    ``label_pad`` is given (e.g. an ignore index such as -100 for integer ids).
    """
    tok = tokenize or whitespace_tokens
    d = expand_directions(pairs)
    d = d.withColumn("prompt", sft_prompt(F.col("src"), F.col("src_lang"), F.col("tgt_lang")))
    d = d.withColumn("_pt", tok(F.col("prompt"))).withColumn("_tt", tok(F.col("tgt")))
    return (d.withColumn("input_ids", pad_to(F.col("_pt"), max_length, F.lit(pad)))
             .withColumn("attention_mask", attention_mask(F.col("_pt"), max_length))
             .withColumn("labels", pad_to(F.col("_tt"), max_length, F.lit(pad if label_pad is None else label_pad)))
             .drop("_pt", "_tt"))
