"""Property tests (hypothesis) and scale-shape assertions."""
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF001
from plain_chrf import py_chrf
from versio.functions.chrf import corpus_score, segment_stats

texts = st.text(alphabet=st.sampled_from(list("abcdé हि　\t\n")), max_size=60)


@given(texts, texts)
@settings(max_examples=300, deadline=None)
def test_segment_stats_equal_counter_definition(h, r):
    h, r = "".join(h.split()), "".join(r.split())
    want = []
    for n in range(1, 7):
        hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
        rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
        nr = sum(rc.values())
        want += [sum(hc.values()) if nr else 0, nr, sum((hc & rc).values())]
    assert segment_stats(h, r) == want


@given(texts)
@settings(max_examples=200, deadline=None)
def test_chrf_identity_is_100(x):
    if x.split():
        assert py_chrf([x], [x]) == pytest.approx(100.0)


@given(texts, texts)
@settings(max_examples=200, deadline=None)
def test_chrf_ignores_whitespace_edits(h, r):
    spaced = " ".join(h) + "\t"
    assert py_chrf([spaced], [r]) == py_chrf([h], [r])


@given(st.lists(st.tuples(texts, texts), max_size=6))
@settings(max_examples=100, deadline=None)
def test_score_bounded(pairs):
    s = corpus_score([sum(x) for x in zip(*[segment_stats("".join(h.split()), "".join(r.split()))
                                             for h, r in pairs])] if pairs else [0] * 18)
    assert 0.0 <= s <= 100.0


def test_directions_double_rows(spark):
    from versio.operators.directions import expand_directions
    from versio.sources.corpus import fixture_corpus
    c = fixture_corpus(spark, SF001)
    assert expand_directions(c).count() == 2 * c.count()


def test_truncating_zip_is_min_of_sides(spark):
    import __spark_entry__ as E
    for r in E.queries()["pair_truncating_zip"](spark, SF001).collect():
        assert r.n_pairs == min(r.n_src, r.n_tgt)


@pytest.mark.parametrize("name", ["fewshot_prompt", "chrf_by_direction", "sft_dataset", "batch_infer"])
def test_no_single_partition_exchange(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
