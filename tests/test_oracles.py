import pytest
from oracle import both

from quaywave.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf):
    rows, told = both(QUERIES[name], ORACLES[name], spark, sf)
    assert rows == told


@pytest.mark.parametrize("name", ["filter_zero_phase", "stockwell_de", "wavelet_logvar", "pca_variance", "csp_logpower", "csp_multiband", "lda_auto_fold_accuracy", "yeo_johnson", "filter_long_series", "ridge_fold_accuracy", "lda_fold_accuracy", "rbf_svm_fold_accuracy", "nested_grid", "forest_fold_accuracy", "stratified_group_greedy", "quantile_normal"])
def test_runs_without_sql(name, spark, sf):
    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(v is not None for r in rows for v in r)


def test_entry_runs(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
