import __spark_entry__ as entry_module
import duckdb
import pytest

from checks.compare import canonical
from checks.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
SMOKE = ["tick_prices", "bars_full", "label_next_bar", "bars_dense_ffill", "class_report"]


def test_entry_has_a_stable_schema(spark):
    df = entry_module.entry(spark)
    assert {"symbol", "session", "bar_ts", "mean_mid_price_variation_class"} <= set(df.columns)
    assert df.schema == entry_module.entry(spark).schema and df.count() >= 0


def test_every_query_with_sql_is_registered():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {name for name in queries if name in REGISTRY}
    assert own - set(oracles) == {"adf", "rf_importance", "shap_importance", "pca_selection", "seq_classifier", "seq_regressor"}


@pytest.mark.parametrize("name", SMOKE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    df = entry_module.queries()[name](spark, FOLDER)
    cursor = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)
