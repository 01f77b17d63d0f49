import duckdb
import pytest

from acervo.operators import evaluate
from acervo.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["field_scores", "evaluation_summary", "project_details", "previews"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("part", "orders", "customer", "documents"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    columns = sorted(names)
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want))


def test_scores(spark):
    cases = [("Querétaro ", "queretaro", True, 1.0), ("San Juan", "San Juan del Río", False, 0.85), ("a1 b2 c3", "c3 b2 a1", False, 1.0), ("a1 b2 c3", "b2 a1 d4", False, 0.5), ("a1 b2", "c3", False, 0.0), ("!", "", True, 1.0), ("", "x", False, 0.0), (None, None, True, 1.0), (None, "x", False, 0.0)]
    rows = spark.createDataFrame([(i, "f", t, p) for i, (t, p, _, _) in enumerate(cases)], "item int, field string, truth string, predicted string")
    assert [(r.exact, r.score) for r in evaluate.match_fields(rows).orderBy("item").collect()] == [(e, s) for _, _, e, s in cases]
    assert evaluate.field_scores(rows.limit(0)).count() == 0
