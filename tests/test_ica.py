import numpy as np

from quaywave.functions import transforms


def test_ica_is_fitted_on_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.laplace(size=(2600, 3))
    x = (x - x.mean(axis=0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(x.T, bias=True))).T
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got, told = transforms.fit_ica(rows, "v", np.zeros(3), np.eye(3)), transforms.fast_ica(x)
    assert np.allclose(got, told, atol=1e-6) and not np.allclose(got, transforms.fast_ica(x[:2000]), atol=1e-3)


def test_ica_unmix_has_twenty_components(spark, sf):
    from quaywave.plans.catalogue import QUERIES

    assert QUERIES["ica_unmix"](spark, sf).select("idx").distinct().count() == 20
