import random

import numpy as np
import xxhash

from versio.llm import simhash as sh


def plain(text, shingle=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(len(w) - shingle + 1)] or [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def closure(fps, distance):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= distance
    lab = np.arange(len(f))
    while True:
        new = np.array([lab[row].min() for row in near])
        if (new == lab).all():
            return lab.tolist()
        lab = new


def test_documents_match_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.choice((0, 1, 2, 3, 200)))] for _ in range(15)]
    rows = []
    for i in range(70):
        x = list(r.choice(base))
        if x and r.random() < 0.5:
            x[r.randrange(len(x))] = "Changed"
        rows.append((i, "\t".join(x)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "É é A"), (5, rows[5][1]), (300, "a b c " * 30_000)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in sh.digest(sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    ids, fps = [d for d, _ in rows], [plain(t) for _, t in rows]
    lab = closure(fps, 3)
    least = {k: min(d for d, x in zip(ids, lab, strict=True) if x == k) for k in lab}
    assert got == {d: (f"{f:016x}", least[k]) for d, f, k in zip(ids, fps, lab, strict=True)}


def test_planned_links_join_what_brute_force_joins(spark):
    r = random.Random(8)
    for distance in (0, 1, 3, 5):
        centers = [r.getrandbits(64) for _ in range(25)]
        fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 6))) for c in centers for _ in range(8)})
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
        # blocks of 3 split every larger bucket
        edges = sh.components(sh.links(df, distance, block=3)).collect()
        root = {e["u"] % 2**64: e["v"] % 2**64 for e in edges}
        lab = closure(fps, distance)
        groups = {}
        for f, k in zip(fps, lab, strict=True):
            groups.setdefault(k, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_allocation_is_the_cheapest():
    r = random.Random(3)
    cost = [[r.random() * 9 for _ in range(5)] for _ in range(3)]
    from itertools import product

    for total in (-3, 0, 1, 2):
        want = min(sum(cost[i][t + 1] for i, t in enumerate(ts)) for ts in product(range(-1, 4), repeat=3) if sum(ts) == total)
        got, ts = sh.allocate(cost, total)
        assert abs(got - want) < 1e-9 and sum(ts) == total


def test_close_fingerprints_do_not_make_the_search_send_more_rows(spark):
    """One large group of near copies: its candidates are links that cost little, so the plan stays that of a table
    without it, a row a partition."""
    r = random.Random(4)
    center = r.getrandbits(64)
    close = {center ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 4))) for _ in range(6000)}
    for fps in (close | {r.getrandbits(64) for _ in range(6000)}, {r.getrandbits(64) for _ in range(12000)}):
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)], "fp long")
        assert [t for _, t in sh.plan(df, 3)] == [0, 0, 0, 0]


def test_halves_of_the_flips_meet(spark):
    bits, r = list(range(10, 30)), random.Random(2)
    for t in range(6):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(bits, t))
        rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in (a, b)], "fp long").select(sh.near(bits, t).alias("v")).collect()
        assert set(rows[0]["v"]) & set(rows[1]["v"])


def test_correlated_bits_share_a_partition():
    bits = np.random.default_rng(1).integers(0, 2, (500, 64))
    bits[:, 40:56] = bits[:, 40:41]
    groups = sh.partitions(500, bits.T @ bits, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and list(range(40, 56)) in groups


def test_one_document_of_each_component_stays(spark):
    rows = [(3, "a b c d", "p"), (1, "A  b c d", "q"), (1, "a b c d", "r"), (7, "other text here now", "s"), (None, "a b c d", "t"), (None, "lonely null key words", "u"), (9, None, "v"), (8, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = sh.one_each(df).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 7, 8] and kept[0].asDict().keys() == {"doc_id", "text", "component"}
    assert sh.one_each(df.limit(0)).count() == 0 and sh.near_duplicates(df.limit(0)).count() == 0
