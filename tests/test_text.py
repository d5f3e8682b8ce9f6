"""Whitespace, band, strip, stop and clean-up semantics (unit, handmade rows)."""
import pytest
from pyspark.sql import functions as F

from versio.functions import text as T


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("s", ["a b", "a\u001cb", "a b", "a　b", "a\tb\nc", " a  b ", "", "   "])
def test_word_count_matches_python_split(spark, s):
    assert one(spark, T.word_count, s) == len(s.split())


@pytest.mark.parametrize("s", ["a​b", "a﻿b", "a᠎b"])
def test_not_whitespace(spark, s):
    assert one(spark, T.word_count, s) == 1


@pytest.mark.parametrize("s", ["  a b 　", " abc ", "\x1c\x1dq\x85", "x", "", "​ x ​"])
def test_strip_matches_python(spark, s):
    assert one(spark, T.strip_ws, s) == s.strip()


def test_whitespace_class_is_python_isspace():
    import sys
    chars = {c for c in T.WS_CHARS}
    assert chars == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


@pytest.mark.parametrize("n,inside", [(100, False), (101, True), (200, True), (201, False)])
def test_word_band(spark, n, inside):
    s = " ".join(["w"] * n)
    got = spark.createDataFrame([(s,)], "v string").select(T.in_word_band(T.word_count("v")).alias("x")).first().x
    assert got is inside


def test_blank_lines(spark):
    df = spark.createDataFrame([("   ",), ('[""]',), ("x",)], "v string")
    assert [r.v for r in df.where(~T.is_blank("v")).collect()] == ['[""]', "x"]


def test_stop_cut_and_echo_removal(spark):
    df = spark.createDataFrame([("p1\n\np2", "ab", "abXab")], "g string, p string, o string")
    r = df.select(T.stop_cut("g", "\n\n").alias("cut"), T.clean_generation(F.col("o"), F.col("p")).alias("clean"),
                  T.clean_generation(F.col("o"), F.lit("")).alias("noop")).first()
    assert r.cut == "p1" and r.clean == "X" and r.noop == "abXab"


def test_code_points_not_graphemes(spark):
    assert one(spark, lambda c: F.length(c), "हिन्दी क") == 8
    assert one(spark, lambda c: F.length(T.remove_ws(c)), "हिन्दी क") == 7


def test_make_valid_utf8_on_read(spark, tmp):
    from conftest import write_lines
    p = tmp + "/bad.txt"
    write_lines(p, [b"x\xff\xfey"], raw=True)
    got = spark.read.text(p).select(T.scrub("value").alias("v")).first().v
    assert got == b"x\xff\xfey".decode("utf-8", "replace") == "x��y"


def test_split_lines_only_on_newlines(spark):
    s = "a b\u0085c\r\nd\re\nf"
    got = one(spark, T.split_lines, s)
    assert got == ["a b\u0085c", "d", "e", "f"]


def test_chat_label_tables(spark):
    from versio.functions import prompts as P
    df = spark.createDataFrame([("ori",), ("tel",), ("eng",), ("xx",)], "c string")
    got = [r.l for r in df.select(P.label_of(F.col("c"), labels=P.chat_labels()).alias("l")).collect()]
    assert got == ["Odia", "Telugu", "English", "xx"]
    par = [r.l for r in df.select(P.label_of(F.col("c"), labels=P.chat_labels(parity=True)).alias("l")).collect()]
    assert par == ["Odiya", "tel", "eng", "xx"]
