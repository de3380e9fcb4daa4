"""Feature lists by model name, and the report of how a dispersion was drawn."""

import pytest

from pollwarden.operators import metrics as M
from pollwarden.operators.cleaning import project_features
from pollwarden.schemas import FEATURES, PORT_FREE_FEATURES, model_features


def test_each_model_takes_its_own_list(spark):
    assert model_features("Random_Forest_Binary") == PORT_FREE_FEATURES and model_features("xgboost") == model_features(None) == FEATURES
    row = spark.createDataFrame([tuple(range(len(FEATURES) + 1))], ["label", *reversed(FEATURES)])
    assert project_features(row, "random_forest_binary").columns == PORT_FREE_FEATURES
    assert project_features(row, "random_forest").columns == FEATURES
    with pytest.raises(ValueError, match="tp_src"):
        project_features(row.drop("tp_src"), "random_forest")
    assert project_features(row.drop("tp_src"), "random_forest_binary").count() == 1


def test_dispersion_names_its_draws(spark):
    folds = spark.createDataFrame([("m", f"s{i}", i / 10, 0.5) for i in range(8)] + [("m", M.POOLED, 1.0, 1.0)],
                                  "model string, grp string, accuracy double, f1_macro double")
    row = M.dispersion_report(folds, ["accuracy", "f1_macro"], 100, 7).first()
    assert (row.bootstrap_unit, row.n_bootstrap, row.bootstrap_seed, row.n_scenarios) == ("held_out_scenario", 100, 7, 8)
    assert row.accuracy_ci95_low <= row.accuracy_mean <= row.accuracy_ci95_high
    assert row.f1_macro_ci95_low == row.f1_macro_ci95_high == 0.5
