import math
import random

from versio.llm import topk


def brute(rows, k=10, every=100):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(math.floor(1024 * x) for x in v)))
    out = []
    for q in sorted({x for x in good if x[0] % every == 0}):
        s = sorted((-sum(a * b for a, b in zip(q[1], v, strict=False)), i) for i, v in good if i != q[0])
        out += [(q[0], r, i, -n) for r, (n, i) in enumerate(s[:k], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    return sorted((r["query"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **kw).collect())


def test_matches_brute_force_with_ties_and_odd_rows(spark):
    r = random.Random(1)
    same = [0.5] * 8
    rows = [(i, [r.randrange(-64, 64) / 64 for _ in range(8)] if i % 3 else same) for i in range(600)]
    rows += [(601, None), (602, [None] * 8), (603, [math.nan] * 8), (604, [math.inf] * 8), (None, same), (700, [1.0, 2.0]), (800, []), (5, rows[5][1]), (300, rows[300][1])]
    want = brute(rows)
    assert run(spark, [(i, v, 0) for i, v in rows]) == want
    assert run(spark, [(i, v, 0) for i, v in rows], block=3) == want


def test_wide_range_and_few_rows(spark):
    rows = [(0, [1e4, -1e4]), (100, [1e-4, 3e3]), (7, [2e4, 1.0]), (8, [-2e4, 1.0])]
    assert run(spark, [(i, v, 0) for i, v in rows]) == brute([(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows])


def test_empty_and_without_queries(spark):
    assert run(spark, []) == [] and run(spark, [(3, [1.0], 0)]) == []


def test_sql_has_the_same_rule_for_repeated_rows(spark, tmp_path):
    import duckdb

    from versio.llm import queries

    r = random.Random(8)
    rows = [(i, [r.randrange(-64, 64) / 64 for _ in range(4)], 0) for i in range(250)]
    rows += [rows[100], rows[7], (200, [1.0, 0.5, 0.25, 0.0], 0), (201, None, 0)]  # a query again, a candidate again, another query of one id
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op5_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(tuple(x) for x in got) == sorted(con.execute(queries.OP5_SQL).fetchall()) and len(got) == 40
