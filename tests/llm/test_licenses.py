import random
import re
from collections import Counter

from versio.llm import licenses as lic

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(t.translate(LOW))


def brute(text, t=lic.THRESHOLD):
    w = [(x, k) for k, line in enumerate((text or "").split("\n")) for x in words(line)]
    best = {}
    for name, body in lic.TEMPLATES:
        b = words(body)
        own = Counter(zip(b, b[1:]))
        for i in range(len(w) - 1):
            bag, common = Counter(), 0
            for j in range(i + 1, len(w)):
                if j - i > 2 * len(b):
                    break  # too long for any dice of the threshold
                g = (w[j - 1][0], w[j][0])
                bag[g] += 1
                common += bag[g] <= own[g]
                d = 2 * common / (j - i + len(b) - 1)
                if d >= t and (-d, i, j) < best.get(name, (0, 0, 0)):
                    best[name] = (-d, i, j)
    return [(n, -best[n][0], w[best[n][1]][1], w[best[n][2]][1]) for n in sorted(best)]


def test_matches_brute_force(spark):
    r = random.Random(1)
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(r.randrange(0, 6)):
            w = r.choice(lic.NOTICES)[1].split()
            if r.random() < 0.5 and len(w) > 4:
                w[r.randrange(len(w))] = "other"
            cut = r.randrange(len(w))
            lines += [" ".join(w)] if r.random() < 0.5 else [" ".join(w[:cut]), "", " ".join(w[cut:])]
        texts.append("\n".join(lines + ["some of the plain words"] * r.randrange(2)).upper() if r.random() < 0.3 else "\n".join(lines))
    texts += [None, "", "of the " * 20_000, "\n".join(["MIT"] * 40)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    found = lic.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS lic_found", "2 AS license"))
    got = sorted(((r_["doc_id"], r_["text"], [tuple(x) for x in r_["lic_found"]]) for r_ in found.collect()), key=repr)
    assert got == sorted(((d, t, brute(t) if len(t or "") < 20_000 else []) for d, t in rows), key=repr)
    assert lic.digest(found).count() == len(rows) and lic.scan(found.limit(0)).count() == 0


def test_notices_inside_lines_and_single_lines(spark):
    plain = "words of some other kind " * 30
    rows = [
        (1, "This project is released under the MIT License."), (2, "Copyright (c) 2020 Acme. Released under the MIT License. All is well."),
        (3, f"{plain}{lic.TEMPLATES[9][1]} {plain}"), (4, f"{plain}\n{plain}Released\nunder the MIT\nLicense, {plain}"), (5, plain), (6, "the MIT bus")]
    got = {r["doc_id"]: (r["licenses"], r["best_dice"], r["best_first"], r["best_last"]) for r in lic.digest(lic.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: ("MIT", 1.0, 0, 0), 2: ("MIT", 1.0, 0, 0), 3: ("ISC", 1.0, 0, 0), 4: ("MIT", 1.0, 1, 3), 5: ("", None, None, None), 6: ("", None, None, None)}


def test_full_texts_inside_other_words(spark):
    plain = "words of some other kind "
    rows = []
    for k, (_, text) in enumerate(lic.FULL_TEXTS):
        w = text.split()
        rows.append((k, f"{plain * 9}{' '.join(w[: len(w) // 2])}\n{' '.join(w[len(w) // 2 :])} {plain * 9}"))
    found = {r["doc_id"]: {x["license"]: x["dice"] for x in r["lic_found"]} for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, _) in enumerate(lic.FULL_TEXTS):
        assert found[k][name] == 1.0 and found[k] == {n: d for n, d, *_ in brute(rows[k][1])}


def test_common_bigrams_of_the_longest_windows():
    import numpy as np

    r = random.Random(6)
    for _ in range(200):
        n = r.randrange(1, 30)
        kind, counts = np.array([r.randrange(4) for _ in range(n)]), np.array([r.randrange(1, 4) for _ in range(4)])
        end = np.sort([r.randrange(n + 1) for _ in range(n)])
        end = np.minimum(np.maximum(end, np.arange(n) + 1), n)
        want = [sum(min(int(counts[k]), int((kind[i : end[i]] == k).sum())) for k in range(4)) for i in range(n)]
        assert lic._most_common(kind, counts, end).tolist() == want
