import hashlib
import random

import re

from versio.llm import decontaminate as dc


def brute(docs, items, window=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    own = []
    for i, t in items:
        w = word.findall((t or "").translate(low))
        own += [("" if i is None else str(i), w[a : a + window]) for a in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for d, t in docs:
        w, hit, ids = word.findall((t or "").translate(low)), set(), set()
        for i, x in own:
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit.update(range(a, a + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(found):
    return sorted((tuple(r) for r in dc.digest(found).collect()), key=repr)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "x"), (3, "ab CD"), (10, "tEn eleven, twelve!"), (None, "été à Z"), (4, ""), (5, None), (1, "zz yy xx")]


def test_matches_brute_force_with_odd_rows(spark):
    r = random.Random(1)
    vocabulary = "one two three four five six seven eight nine ten eleven twelve x ab cd été à z zz yy xx Ten".split()
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60)))) for i in range(80)]
    docs += [(i, "pre " + ITEMS[0][1].upper() + " post") for i in (100, 100)]  # repeated rows
    docs += [(None, "a x b"), (101, None), (102, ""), (103, "... --"), (104, "w " * 50_000 + ITEMS[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(dc.decontaminate(df, items)) == brute(docs, ITEMS)


def test_blocks_of_patterns_give_the_same(spark):
    docs = [(i, f"lead {ITEMS[i % 3][1]} x {ITEMS[0][1]} tail") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(dc.decontaminate(df, items, block_bytes=64)) == brute(docs, ITEMS)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x y", 7, "k")], "doc_id long, text string, dc_hit int, item string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = dc.decontaminate(df, none).first()
    assert (r["dc_words"], r["dc_hit"], r["dc_items"], r["item"]) == (2, 0, [], "k")
    assert dc.decontaminate(df.limit(0), none).count() == 0


def test_shift_table_skips_and_finds_all():
    r = random.Random(5)
    text = bytes(r.choice(b"ab ") for _ in range(20_000))
    patterns = sorted({text[p : p + r.randrange(9, 20)] for p in (r.randrange(19_000) for _ in range(50))})
    found = sorted(dc.WuManber(patterns, list(range(len(patterns)))).search(text + bytes(8)))
    assert found == sorted((p, k) for k, x in enumerate(patterns) for p in range(len(text)) if text.startswith(x, p))
