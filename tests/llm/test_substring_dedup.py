import hashlib
import os
import random
import uuid

from versio.llm import substring_dedup as sd
from versio.llm.common import shared_dir


def brute(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                keep[i : i + length] = bytes(length)
            else:
                seen.add(w)
        n = sum(1 for i in range(len(b)) if not keep[i] and (i == 0 or keep[i - 1]))
        out.append((d, len(b), len(b) - sum(keep), n, hashlib.sha256(bytes(c for c, k in zip(b, keep, strict=True) if k)).hexdigest()))
    return sorted(out, key=repr)


def sample():
    r = random.Random(3)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(0, 700))) for _ in range(12)]
    rows = []
    for i in range(60):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 3)):
            if t:
                t[r.randrange(len(t))] = "x"
        rows.append((i, "".join(t) + (r.choice(base) if i % 5 == 0 else "")))
    return rows + [(None, base[3]), (500, None), (501, ""), (502, "a" * 3000), (503, "ab" * 900), (504, "z" * 99), (505, "z" * 101)]


def test_matches_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in sd.digest(sd.dedup_substrings(df)).collect()), key=repr) == brute(rows, 100)


def test_units_of_any_size_give_the_same_result(spark):
    rows = sample()[:40]
    df = spark.createDataFrame(rows, "doc long, text string")
    want = {d: n for d, _, n, *_ in brute(rows, 100)}
    for unit in (1, 5, 60):
        got = {d: set() for d in want}
        for x in sd.repeats(df, unit=unit).collect():
            got[x["doc"]] |= set(range(x["a"], x["z"]))
        assert {d: len(x) for d, x in got.items()} == want


def test_doubling_names_equal_windows_equally(spark):
    r = random.Random(5)
    for length in (7, 10, 16):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 60))) for _ in range(30)]
        df = spark.createDataFrame(list(enumerate(texts)), "number long, bytes binary")
        got, seen = {}, {}
        for x in sd.doubled(df, length, 60).collect():
            got.setdefault((x["x"], x["y"]), []).append((x["number"], x["at"]))
        for k, t in enumerate(texts):
            for i in range(len(t) - length + 1):
                seen.setdefault(t[i : i + length], []).append((k, i))
        named = sorted(sorted(x) for x in got.values())
        assert all(len({texts[k][i : i + length] for k, i in x}) == 1 for x in named)
        assert [x for x in named if len(x) > 1] == sorted(x for x in seen.values() if len(x) > 1)


def test_long_text_in_segments(spark):
    r = random.Random(9)
    word = "".join(r.choice("abcdefgh ") for _ in range(400))
    text = "".join(r.choice("abcdefgh ") for _ in range(sd.SEGMENT + 300)) + word
    rows = [(1, text), (2, word), (3, text[sd.SEGMENT - 250 : sd.SEGMENT + 50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in sd.digest(sd.dedup_substrings(df)).collect()}
    assert got == {1: 0, 2: 400, 3: 300}


def test_repeated_rows_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "q" * 10 + "abcdefghij" * 30, "s"), (1, "q" * 10 + "abcdefghij" * 30, "s"), (2, "abcdefghij" * 15, "s")], "doc_id long, text string, sd_kept string")
    got = sorted((r["doc_id"], len(r["sd_kept"]), r["sd_bytes"]) for r in sd.dedup_substrings(df).collect())
    assert got[0] == got[1] and got[2] == (2, 0, 150)
    assert sd.dedup_substrings(df.limit(0)).count() == 0


def test_passages_at_a_cut_of_a_later_long_text(spark):
    r = random.Random(11)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    cut, places = sd.SEGMENT - sd.LENGTH + 1, [-464, -430, -400, -370, -336, -64, -40, -20, -5, 0, 5, 20, 40, 64]
    rows, want = [], {}
    for i, at in enumerate(places):
        p = text(400)
        rows += [(i, p), (100 + i, text(cut + at) + p + text(500))]
        want |= {i: 0, 100 + i: 400}
    rows += rows[1::2][:5]  # repeated rows: none is earlier than the other
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sd.dedup_substrings(df).select("doc_id", "sd_removed").collect()
    at = {x["doc_id"]: [(y["a"], y["z"]) for y in x["sd_removed"]] for x in out}
    assert len(out) == len(rows) and {d: sum(z - a for a, z in x) for d, x in at.items()} == want
    assert all(at[100 + i] == [(cut + k, cut + k + 400)] for i, k in enumerate(places))


def test_texts_are_named_once_and_the_rows_of_all_anchors_go(spark, tmp_path):
    rows, seen = [(i, "the same hundred bytes and more " * 5 + str(i) * 200) for i in range(40)], str(tmp_path)

    def count(batches):
        for batch in batches:
            with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(batch.num_rows))
            yield batch

    docs = spark.createDataFrame(rows, "doc long, text string").mapInArrow(count, "doc long, text string")
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert sd.repeats(docs).count()
    # Once for the anchors, and once more for what the anchors left cover.
    assert sum(int((tmp_path / x).read_text()) for x in os.listdir(seen)) <= 2 * len(rows)
    assert not [x for x in set(os.listdir(folder)) - before if "all-anchors" in x]
