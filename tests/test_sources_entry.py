import tempfile

import duckdb
import pandas as pd
import pytest

from regressa.plans.closed_form import QUERIES as CLOSED_FORM
from regressa.sources import files, synthetic
from tests.conftest import SF0001


def test_csv_roundtrip_and_predictions_sink(spark):
    d = tempfile.mkdtemp(prefix="regressa-csv-")
    pdf = pd.DataFrame({"a": [1.5, None, 3.0], "b": ["x", "y", None], "n": [1, 2, 3]})
    pdf.to_csv(f"{d}/in.csv", index=False)
    df = files.read_csv(spark, f"{d}/in.csv")
    assert dict(df.dtypes) == {"a": "double", "b": "string", "n": "int"}
    assert df.where("a IS NULL").count() == 1
    files.write_predictions(df, f"{d}/out")
    assert spark.read.option("header", True).csv(f"{d}/out").count() == 3


def test_generators(spark):
    hp = synthetic.house_prices(spark)
    assert hp.count() == 1000 and hp.agg({"price": "min"}).first()[0] >= 50000
    emp = synthetic.employee_performance(spark).toPandas()
    assert emp.performance_score.between(0, 100).all() and len(emp) == 600
    assert set(synthetic.sales(spark).columns) >= {"sales", "market_size"}
    st = synthetic.student(spark).toPandas()
    assert st.final_grade.between(0, 100).all()
    mk = synthetic.marketing_roi(spark).toPandas()
    assert (mk.roi >= 0).all() and len(mk) == 800


def test_in_memory_source(spark):
    pdf = pd.DataFrame({"a.b": [1.0, float("nan")], "s": ["x", None]})
    rows = files.from_pandas(spark, pdf).collect()
    assert [tuple(r) for r in rows] == [(1.0, "x"), (None, None)]


def test_report_sink(spark, tmp_path):
    import json

    from regressa.config import RegressionParams
    from regressa.plans import workflow

    df = synthetic.regression_dataset(spark, n_samples=120, n_features=2, random_state=1)
    params = RegressionParams(models_to_include=("linear", "ridge"), cv_folds=3, hyperparameter_tuning=False)
    res = workflow.run_workflow(df.drop("category_A", "category_B"), "target", params, ["id"])
    files.write_report(spark, f"{tmp_path}/r", res, params)
    summary = json.loads(spark.read.json(f"{tmp_path}/r/summary").first()["summary"])
    assert summary["success"] and summary["best_model"] == res.best_name
    assert summary["config"]["cv_folds"] == 3
    models = spark.read.json(f"{tmp_path}/r/models").collect()
    assert {r["Model"] for r in models} == {"linear", "ridge"}
    assert spark.read.json(f"{tmp_path}/r/cross_validation").count() == 6
    assert spark.read.json(f"{tmp_path}/r/dataset").first()["n_rows"] == 120


def test_missing_features_of_a_batch(spark):
    from types import SimpleNamespace

    from regressa.operators import score, validate

    df = spark.createDataFrame([(1, 2)], "a int, `b.c` int")
    assert validate.missing_features(df, ["b.c", "z", "a", "y"]) == ["z", "y"]
    assert score.check_batch_columns(df, SimpleNamespace(input_features=["a", "q"])) == ["q"]


def test_search_methods_name_their_candidates(caplog):
    from regressa.plans import tuning

    fixed = tuning.candidates("ridge", "random", 3, 42)
    assert fixed == [{"alpha": 0.1}, {"alpha": 1000.0}, {"alpha": 10.0}]
    assert tuning.candidates("random_forest", "bayesian", 7, 1) == tuning.candidates("random_forest", "random", 7, 1)
    assert "bayesian" in caplog.text
    grid = tuning.candidates("random_forest", "grid")
    assert len(grid) == 4 * 4 * 3 * 3 * 3 and len({tuple(map(str, c.values())) for c in grid}) == len(grid)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and rows[0]["test_r2"] >= rows[1]["test_r2"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


ORACLE_SAMPLE = ["validate_lineitem", "describe_lineitem", "impute_lineitem", "ffill_events",
                 "split_lineitem", "folds_lineitem", "onehot_lineitem", "ols_metrics_lineitem",
                 "qq_points_lineitem", "ks_drift_events", "degradation_lineitem", *CLOSED_FORM]


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_query_matches_duckdb_oracle(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    from regressa.sources.tables import TABLES

    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    got = entry.queries()[name](spark, SF0001).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(exp.columns)

    def norm(pdf):
        out = pdf[cols].astype(object).where(pdf[cols].notna(), None)
        rows = [tuple(round(float(v), 6) if isinstance(v, (float, int)) and not isinstance(v, bool)
                      else v for v in r) for r in out.itertuples(index=False, name=None)]
        return sorted(rows, key=repr)

    assert norm(got) == norm(exp)
