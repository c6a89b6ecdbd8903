"""The entry points."""

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    assert {"interval_profile", "track_features", "stratified_split", "confusion_matrix", "power_spectrum", "knn_predict"} <= set(sql)
