import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF001
from versio.llm import spelling


def one_edit(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            for c in letters:
                yield w[:i] + c + w[i + 1 :]


def plain_version(rows):
    """The contract read word for word, one text at a time."""
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return led({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})


def led(words):
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in one_edit(w, letters) if x in words and x != w} for w in words}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-words[x], x))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def result(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    got = result(spelling.digest(spelling.variants(docs)))
    assert got == plain_version([tuple(r) for r in docs.collect()])
    assert sum(x[0] is not None for x in got.values()) > 100 and any(x[0] != x[1] for x in got.values() if x[0])


def random_words(rng, n):
    """Words over few letters: long common beginnings, runs of one letter, many neighbours."""
    out = {"aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "ababab", "bababa", "é" * 9, "é" * 8}
    while len(out) < n:
        out.add("".join(rng.choice(list("abé"), rng.integers(5, 9), p=[0.6, 0.3, 0.1])))
    return sorted(out)


@pytest.mark.parametrize("largest,block", [(4096, 1024), (4096, 3), (40, 16), (3, 5), (1, 1)])
def test_groups_of_any_size_lose_and_repeat_nothing(spark, largest, block):
    rng = np.random.default_rng(largest + block)
    words = {w: int(n) for w, n in zip(random_words(rng, 700), rng.integers(3, 2000, 700), strict=True)}
    near = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), 5, largest, block).collect()}
    letters = sorted({c for w in words for c in w})
    for w in words:
        xs = {x for x in one_edit(w, letters) if x in words and x != w}
        best = min(xs, key=lambda x: (-words[x], x)) if xs else None
        assert near.get(w) == ((len(xs), best, words[best]) if xs else None), w


def test_refined_groups_are_bounded(spark):
    words = spark.createDataFrame([("inter" + "".join(chr(97 + (i // 26**k) % 26) for k in range(4)), 3) for i in range(3000)], "word string, n long")
    sizes = spelling.groups(words, largest=100).groupBy(*spelling.GROUP).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 100


def test_long_words_chains_nulls_and_no_rows(spark):
    long = "ab" * 30_000
    chain = ["color", "colour", "colouur", "colouuur"]
    text = " ".join(["colour"] * 48 + ["color"] * 20 + ["colouur"] * 12 + ["colouuur"] * 6 + [long] * 9 + [long[:-1]] * 3 + ["COLOR É", "Été", "a-b"])
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = result(spelling.digest(spelling.variants(df)))
    assert got == plain_version(rows)
    assert got["colouuur"][:2] == ("colouur", "colour") and set(chain) <= set(got) and long in got
    assert spelling.digest(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert spelling.digest(spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string"))).count() == 0
