from quaywave.plans import model_queries
from quaywave.plans.catalogue import QUERIES


def test_every_fold_is_tested(spark, sf):
    rows = model_queries._pooled(spark, sf)
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    out = QUERIES["logistic_pooled_fold_accuracy"](spark, sf).collect()
    assert len(sizes) == 3 and {r["fold"]: r["n"] for r in out} == sizes
    assert model_queries._ml_probabilities(rows, ["logistic_pooled"]).select("vec_id").distinct().count() == sum(sizes.values())


def test_models_have_the_sizes_of_the_reference(spark):
    made = {k: f() for k, f in model_queries._ESTIMATORS.items()}
    assert [(m.getNumTrees(), m.getMaxDepth()) for m in (made["forest"], made["extra_trees_substitute"])] == [(150, 12), (100, 10)]
    assert (made["gbt"].getMaxIter(), made["gbt"].getMaxDepth()) == (100, 5)
    assert (list(made["mlp"].getLayers()), made["mlp"].getMaxIter()) == ([64, 64, 32, 2], 300)


def test_no_window_of_a_trial_is_dropped(spark, sf, monkeypatch):
    from quaywave.plans import lifecycle

    whole, seen = lifecycle.cross_validate, {}

    def watch(table, k, top):
        seen["top"], seen["windows"] = top, {r["count"] for r in table.groupBy("session", "trial_idx").count().collect()}
        return whole(table, k=k, top=top)

    monkeypatch.setattr(lifecycle, "cross_validate", watch)
    assert QUERIES["recordings_to_accuracy"](spark, sf).columns and seen == {"top": 150, "windows": {3}}
