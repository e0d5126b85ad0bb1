"""The fitted feature pipeline against brute force."""

import pytest

from citspark.operators.pipeline import FeaturePipeline, PipelineSpec

ROWS = [(0, 1.5, "a", "u", 1.0, "Red red fox", [1.0, 3.0]), (1, None, "b", None, 0.0, None, None), (2, 2.0, "a", "u", 0.0, "fox", []), (3, 0.5, None, "v", 1.0, "", [2.0]), (4, 1.0, "a", "v", 1.0, "dog", [0.0]), (5, 1.0, "c", "v", None, "dog", [0.0])]
SCHEMA = "i long, x double, k string, m string, y double, t string, e array<float>"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_codes_means_and_frequencies(spark, table, tmp_path):
    spec = PipelineSpec(numeric=("x",), categorical=("k", "m"), combinations=(("k", "m"),), ctr=("k",), text=("t",), embedding=("e",), hash_dim=4)
    fitted, train = FeaturePipeline.fit_transform(table, spec, "y", "i", keep=["i"])
    got = {r.i: r for r in train.collect()}
    assert train.columns == ["i", *fitted.feature_names()]
    keys = sorted({r[2] or "__missing__" for r in ROWS})
    prior = sum(r[4] or 0 for r in ROWS) / len(ROWS)
    for at, r in enumerate(ROWS):
        own = [x[4] or 0 for x in ROWS[:at] if x[2] == r[2]]
        assert got[r[0]].k_code == keys.index(r[2] or "__missing__")
        assert got[r[0]].k_mean == pytest.approx((sum(own) + prior) / max(len(own) + 1, 1))
        share = sum(x[2] == r[2] for x in ROWS) / len(ROWS)
        assert got[r[0]].k_freq == pytest.approx((len(own) + share) / (at + 1))
    assert sum(got[0][f"t_hash_{i}"] for i in range(4)) == 3 and got[0].e_mean == 2 and got[1].e_dim == 0
    fitted.save(spark, f"file://{tmp_path}/p")
    again = FeaturePipeline.load(spark, f"file://{tmp_path}/p")
    new = spark.createDataFrame([(9, 1.0, "a", "u", None, "fox", None), (10, 1.0, "zz", "v", None, None, None)], SCHEMA)
    both = [{r.i: r for r in p.transform(new, keep=["i"]).collect()} for p in (fitted, again)]
    assert both[0] == both[1]
    assert both[0][9].k_mean == pytest.approx((2 + prior) / 4) and both[0][9].k_freq == pytest.approx((3 + 0.5) / 7)
    assert both[0][10].k_code is None and both[0][10].k_freq == 0 and both[0][10].k_mean == pytest.approx(prior)


def test_indicators_rare_keys_and_empty_tables(spark, table):
    spec = PipelineSpec(categorical=("k", "m"), one_hot=3, max_keys=3)
    out = {r.i: r for r in FeaturePipeline.fit(table, spec).transform(table, keep=["i"]).collect()}
    # m has three keys and becomes indicators; k has four: the most frequent two stay and one code is the others'.
    assert out[0].m_is_u == 1 and out[1].m_is_missing == 1 and out[3].m_is_u == 0
    assert [out[i].k_code for i in range(6)] == [1, 2, 1, 0, 1, 2]
    new = spark.createDataFrame([(9, 1.0, "zz", "q", None, None, None)], SCHEMA)
    r = FeaturePipeline.fit(table, spec).transform(new).first()
    assert r.k_code == 2 and r.m_is_u == r.m_is_v == r.m_is_missing == 0
    assert FeaturePipeline.fit(table.limit(0), spec).transform(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        FeaturePipeline.fit(table, PipelineSpec(ctr=("k",)))
