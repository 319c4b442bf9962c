import duckdb
import pytest

from cardwarden.llm.queries import ORACLE, QUERIES
from tests.test_queries import TYPES, normal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, result = QUERIES[name](spark, SF), duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    kinds = TYPES | {"boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in result.description}
    assert normal(df.columns, df.collect()) == normal(names, result.fetchall())
