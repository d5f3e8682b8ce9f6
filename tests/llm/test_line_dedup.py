import random

from versio.llm import line_dedup as ld


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def brute(rows):
    lines = [(d, i, x.split()) for d, t in rows for i, x in enumerate((t or "").encode().split(b"\n"))]
    lines = [x for x in lines if x[2]]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    gone = {d: set() for d, _ in rows}
    for x in lines:
        for y in lines:
            if key(y) < key(x) and (x[2] == y[2] or min(len(x[2]), len(y[2])) >= ld.LEAST_WORDS and edits(x[2], y[2]) <= 1):
                gone[x[0]].add(x[1])
    out = []
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        out.append((d, kept, len([x for x in lines if x[0] == d]), len(gone[d])))
    return sorted(out, key=repr)


def sample():
    r = random.Random(2)
    words = "a b c d e é".split()
    base = [[r.choice(words) for _ in range(r.choice((3, 10, 11, 12, 13, 14)))] for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randrange(0, 6)):
            x = list(r.choice(base))
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(len(x))
                x[k : k + r.randrange(2)] = [r.choice(words)] * r.randrange(2)
                x = x or ["a"]
            lines.append("  ".join(x) + r.choice(("", " ", "\t")))
        rows.append((i, "\n".join(lines + [""] * r.randrange(2))))
    return rows + [(None, " ".join(base[0])), (90, None), (91, ""), (92, "\n\n"), (93, "w " * 20_000)]


def test_matches_brute_force(spark):
    rows = sample()
    done = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["text"], r["ld_lines"], r["ld_removed"]) for r in done.collect()), key=repr) == brute(rows)


def test_decisions_agree_with_texts(spark):
    rows = sample()
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_removed"], len([x for x in r["removed"].split(",") if x])) for r in ld.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d or -1 if d is None else d or -1, n, k, k) for d, _, n, k in brute(rows))


def test_one_edit_is_the_edit_distance():
    r = random.Random(4)
    for _ in range(2000):
        x, y = ([r.choice(b"abc") for _ in range(r.randrange(7))] for _ in range(2))
        assert ld.one_edit(x, y) == (edits(x, y) <= 1)


def test_variants_are_names_of_what_is_left():
    words = [b"a", b"b", b"b", b"c"]
    u, v = ld.variants(words)
    assert u[2] == u[3] and v[2] == v[3] and u[1] != u[2]  # without the first or the second b
    assert ld.variants([b"b", b"b", b"c"])[0][0] == u[1]


def test_repeated_rows_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "x y\nx y", 5), (1, "x y\nx y", 5), (2, "x y\nz", 6)], "doc_id long, text string, ld_lines int")
    got = sorted((r["doc_id"], r["text"], r["ld_lines"]) for r in ld.dedup_lines(df).collect())
    assert got == [(1, "x y", 2), (1, "x y", 2), (2, "z", 2)]
    assert ld.dedup_lines(df.limit(0)).count() == 0
