"""Reader dialects S3/S4/S5, ordinals over files, paired reader S6, sink S2 round trip."""
import json

import pytest
from pyspark.sql import functions as F

from conftest import write_lines
from versio.sources import readers
from versio.sources.sinks import jsonl_line, write_documents


def test_strict_reader_and_quarantine(spark, tmp):
    p = tmp + "/doc.eng.jsonl"
    write_lines(p, ['["  hello "]', "   ", '[""]', '"bare"', "[]", "[1.0]", "[null]", '{"a": 1}', "raw text"])
    good, bad = readers.read_documents(spark, p)
    g = sorted((r.ordinal, r.text) for r in good.collect())
    assert g == [(0, "hello"), (2, ""), (3, "bare")]
    b = sorted((r.ordinal, r.error) for r in bad.collect())
    assert [o for o, _ in b] == [4, 5, 6, 7, 8]
    assert dict(b)[4] == "empty array"


def test_strict_reader_raises(spark, tmp):
    import pytest
    p = tmp + "/d.jsonl"
    write_lines(p, ['["ok"]', "{}"])
    good, _ = readers.read_documents(spark, p, strict=True)
    with pytest.raises(Exception, match="bad document line"):
        good.collect()


def test_prompt_reader(spark, tmp):
    p = tmp + "/p.jsonl"
    write_lines(p, ['["a b"]', '{"prompt": "p"}', "raw line  ", '"bare"', "  "])
    got = [r.prompt for r in readers.read_prompts(spark, p)[0].orderBy("ordinal").collect()]
    assert got == ["a b", "p", "raw line", '"bare"']


def test_score_reader(spark, tmp):
    p = tmp + "/h.jsonl"
    write_lines(p, ['[" t "]', '{"translation": "x"}', "{}", '"bare"', "plain ", '[""]'])
    got = [r.text for r in readers.read_scored(spark, p)[0].orderBy("ordinal").collect()]
    assert got == ["t", "x", "", "bare", "plain", ""]


def test_line_ordinals_across_many_splits(spark, tmp):
    import os
    d = tmp + "/many"
    os.makedirs(d)
    expected = {}
    for f in range(3):
        lines = [json.dumps([f"file{f} line{i} " + "é" * (i % 7)], ensure_ascii=False) for i in range(3000)]
        write_lines(f"{d}/f{f}.jsonl", lines)
        expected[f] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = readers.numbered_lines(spark, d).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 9000
    for r in rows:
        f = int(r._file.rsplit("/f", 1)[1].split(".")[0])
        assert expected[f][r.ordinal] == r.value


def test_paired_reader_rejects(spark, tmp):
    s, t = tmp + "/s.jsonl", tmp + "/t.jsonl"
    write_lines(s, ['{"text": "a"}', "{bad", '{"text": "c"}', '{"text": "d"}'])
    write_lines(t, ['{"text": "A"}', '{"text": "B"}', '{"text": 3}'])
    good, rej = readers.read_text_pairs(spark, s, t, "eng", "hin")
    assert sorted((r.ordinal, r.src, r.tgt) for r in good.collect()) == [(0, "a", "A")]
    assert sorted(r.line for r in rej.collect()) == [2, 3]


def test_jsonl_sink_round_trip(spark, tmp):
    texts = ['quote " and \\ slash /', "line\nbreak", " sep\u0085", "हिन्दी", "\U0001F600", "\x0b ctl"]
    df = spark.createDataFrame([("dev", "eng_hin", i, t) for i, t in enumerate(texts)],
                               "subset string, pair string, ordinal long, text string")
    out = tmp + "/out"
    write_documents(df, out, ["subset", "pair"])
    for line in open(next(__import__("glob").iglob(out + "/subset=dev/pair=eng_hin/*.txt")), encoding="utf-8"):
        pass
    back = readers.read_scored(spark, out + "/subset=dev/pair=eng_hin")[0].collect()
    assert sorted(r.text for r in back) == sorted(t.strip() for t in texts)
    enc = df.select(jsonl_line(F.col("text")).alias("j")).collect()
    for r, t in zip(enc, texts):
        assert json.loads(r.j) == [t]


def test_ingest_jsonl_layout(spark, tmp):
    import os
    import pytest
    from versio.sources.corpus import ingest_jsonl
    for subset in ("dev", "test"):
        os.makedirs(f"{tmp}/{subset}/eng_hin")
    write_lines(f"{tmp}/dev/eng_hin/doc.eng.jsonl", ['["e0"]', "  ", '["e2"]', '["e3"]'])
    write_lines(f"{tmp}/dev/eng_hin/doc.hin.jsonl", ['["h0"]', '["h1"]', '{"x": 1}', '["h3"]', '["h4"]'])
    write_lines(f"{tmp}/test/eng_hin/doc.eng.jsonl", ['[" a "]', '["b"]'])
    write_lines(f"{tmp}/test/eng_hin/doc.hin.jsonl", ['["A"]', '["B"]'])
    par, rej, check = ingest_jsonl(spark, tmp)
    got = sorted((r.subset, r.ordinal, r.src_txt, r.tgt_txt) for r in par.collect())
    assert got == [("dev", 0, "e0", "h0"), ("dev", 3, "e3", "h3"), ("test", 0, "a", "A"), ("test", 1, "b", "B")]
    reasons = {(r.subset, r.ordinal): r.reason for r in rej.collect()}
    assert reasons == {("dev", 1): "source: blank line", ("dev", 2): "target: line must be a string or a single-element list",
                       ("dev", 4): "no source line"}
    status = {r.subset: (r.n_src, r.n_tgt, r.status) for r in check.collect()}
    assert status == {"dev": (4, 5, "length mismatch"), "test": (2, 2, "ok")}
    with pytest.raises(ValueError, match="dev/eng_hin"):
        ingest_jsonl(spark, tmp, strict=True)


def test_random_texts_round_trip_through_all_readers(spark):
    import random
    from versio.sources.readers import parse_prompt, parse_score, parse_strict
    rnd = random.Random(11)
    pool = list("ab é\"\\/\n\r\t\x0b\x0c\x1c\x85   　​﻿") + ["\U0001F600", "हि", "{", "["]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    line = jsonl_line(F.col("t"))
    rows = df.select("i", line.alias("line"), parse_strict(line)["text"].alias("s"),
                     parse_prompt(line)["text"].alias("p"), parse_score(line)["text"].alias("c")).collect()
    for r in rows:
        t = texts[r.i]
        assert json.loads(r.line) == [t]
        assert r.s == t.strip() and r.c == t.strip() and r.p == t


def test_lone_surrogate_escapes_dropped_like_python(spark, tmp):
    from versio.sources.readers import read_text_pairs
    lines = ['{"text": "a\\ud800b"}', '{"text": "x\\udc00\\ud83d\\ude00y"}', '{"text": "keep \\\\ud800 literal"}']
    s, t = tmp + "/s.jsonl", tmp + "/t.jsonl"
    write_lines(s, lines)
    write_lines(t, ['{"text": "ok"}'] * 3)
    good, _ = read_text_pairs(spark, s, t, "eng", "hin")
    got = [r.src for r in good.orderBy("ordinal").collect()]
    want = [json.loads(x)["text"].encode("utf-8", "ignore").decode("utf-8", "ignore") for x in lines]
    assert got == want == ["ab", "x\U0001F600y", "keep \\ud800 literal"]


def test_a_replaced_table_changes_the_answer(spark, tmp):
    from versio.sources.corpus import fixture_corpus
    rows = [(0, "a", "en"), (1, "b", "de"), (2, "c", "en"), (3, "d", "de")]
    for n in (4, 2):
        spark.createDataFrame(rows[:n], "doc_id long, text string, lang string").coalesce(1).write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
        assert fixture_corpus(spark, tmp).count() == n // 2


def test_building_queries_stores_nothing(spark):
    import os
    from versio.plans.catalog import queries
    from conftest import SF001
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    for name in ("fewshot_prompt", "chrf_by_direction", "jsonl_ingest_zip", "sft_text_pairs", "corpus_scan_counts", "stop_and_clean"):
        queries()[name](spark, SF001)
    assert set(os.listdir(shared)) == before


def test_text_after_the_json_value_is_rejected(spark):
    from versio.sources.readers import parse_prompt, parse_score, parse_strict, parse_text_object
    bad = ['["a"] trailing', '["a"]["b"]', '"x" y', '"a","b"', '"a"] x', '"a"} x', '["a"]]', '{"text":"a"}{"text":"b"}', '["broken', '{"a":1}}', '"a","b":1']
    good = ['["a"]', '"x"', ' ["a"] ', '["a",{"b":[1,"]}"]}]']
    df = spark.createDataFrame([(x,) for x in bad + good], "line string")
    v = F.col("line")
    got = {r.line: r for r in df.select("line", parse_strict(v)["error"].alias("s"), parse_prompt(v)["error"].alias("p"),
                                        parse_score(v)["error"].alias("c"), parse_text_object(v).alias("o")).collect()}
    assert all(got[x].s == "not json" and got[x].o is None for x in bad) and all(got[x].s is None for x in good)
    assert all(got[x].p == "not json" for x in bad if x[0] in "[{") and all(got[x].c == "not json" for x in bad)
    assert df.where(parse_prompt(F.lit('{"nope":1}'))["error"].isNull()).count() == 0


def test_positions_among_the_lines_left_over_parts_splits_and_chunks(spark, tmp, monkeypatch):
    import os
    import random
    from versio.sources import ordinals
    from versio.sources.readers import read_scored
    monkeypatch.setattr(ordinals, "CHUNK", 8)
    rng = random.Random(3)
    want = []
    for f in range(2):
        d = f"{tmp}/in/direction=x{f}_2_eng"
        os.makedirs(d)
        lines = [[rng.choice(["", "  ", "　"]) if rng.random() < share else f'["{f} {part} {i}"]' for i in range(400)]
                 for part, share in enumerate((0.0, 0.3, 1.0, 0.9))]
        for part, x in enumerate(lines):
            write_lines(f"{d}/part-{part:05d}-a.c000.txt", x)
        numbered = [(i, x) for i, x in enumerate(sum(lines, [])) if x.strip()]
        want += [(f"x{f}", i, pos, x[2:-2]) for pos, (i, x) in enumerate(numbered)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        good, _ = read_scored(spark, f"{tmp}/in", strict=True, matching=r"direction=[^/]+_2_eng$", positions=True)
        got = [(r._file.split("direction=")[1][:2], r.ordinal, r.pos, r.text) for r in good.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted(want) and len(want) > 500


def test_positions_move_no_text_and_a_line_is_parsed_once(spark, tmp):
    """Positions came from a sort of all keys, which the texts then met in an exchange; a line was parsed for each use."""
    from versio.sources.readers import read_scored
    write_lines(f"{tmp}/x.jsonl", ['["a"]', "", "plain"])
    good, _ = read_scored(spark, f"{tmp}/x.jsonl", strict=True, positions=True)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    optimized = good._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.lower().count("parse_json") + optimized.count("parseJson") == 2  # once in an array, once in an object
    assert sorted((r.ordinal, r.pos, r.text) for r in good.collect()) == [(0, 0, "a"), (2, 1, "plain")]
    write_lines(f"{tmp}/bad.jsonl", ['["a"]', "", "[1"])
    with pytest.raises(Exception, match=r"bad scored line .*bad\.jsonl:3: not json"):
        read_scored(spark, f"{tmp}/bad.jsonl", strict=True, positions=True)[0].collect()
