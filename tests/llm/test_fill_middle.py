import hashlib
import re

from pyspark.sql import functions as F

from versio.llm import fill_middle as fm

TEXTS = ["a b  c\n", "  lead and trail \t ", "é漢\U0001f600 x y  z", "", None, " \n\t", "has <P> in it", "<S", "P> <", "word " * 60_000, "x" * 500_000, "a<\n<P" * 3, "\x00 \x0b\x0c\x0d q"]


def plain_version(doc, text, seed=42):
    """The contract read word for word, one text at a time."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    sha = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_the_plain_version_and_restores(spark):
    rows = [(k * 100 + i, t, "x") for k in range(9) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[0], "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, FIM_n string")
    done = fm.restore(fm.fill_in_middle(df))
    assert done.columns == ["doc_id", "text", "fim_form", "fim_n", "fim_prefix_chars", "fim_middle_chars", "fim_output", "fim_restored"]
    got = done.collect()
    assert len(got) == len(rows) and {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["fim_n"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_output"]) == plain_version(r["doc_id"], r["text"])
        assert r["fim_restored"] == (r["text"] or "")
    again = fm.fill_in_middle(df.repartition(7)).collect()
    assert sorted((repr(r["doc_id"]), r["fim_output"]) for r in again) == sorted((repr(r["doc_id"]), r["fim_output"]) for r in got)


def test_empty_table_and_damaged_outputs(spark):
    df = spark.createDataFrame([("psm", "<S>a<P>b<M>c"), ("spm", "no marks"), ("other", "<P>a<S>b<M>c"), (None, "x"), ("plain", None), ("psm", "<P>a<S>b<M>c"), ("spm", "<S>b<P>a<M>c")], "fim_form string, fim_output string")
    assert [r["fim_restored"] for r in fm.restore(df).collect()] == [None, None, None, None, None, "acb", "acb"]
    assert fm.digest(fm.restore(fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_rates_and_bytes_that_are_no_utf8(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    count = {r["fim_form"]: r["count"] for r in fm.fill_in_middle(df).groupBy("fim_form").count().collect()}
    assert 0.46 < count["plain"] / 4000 < 0.54 and 0.75 < count["spm"] / (4000 - count["plain"]) < 0.85
    every = {r["fim_form"] for r in fm.fill_in_middle(df, rate=100, suffix_first=100).select("fim_form").distinct().collect()}
    assert every == {"spm"}
    broken = spark.range(40).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF2062")).cast("string").alias("text"))
    assert {r["fim_restored"] for r in fm.restore(fm.fill_in_middle(broken)).collect()} == {"a� b"}
