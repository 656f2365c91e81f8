import pytest
from conftest import DATA

from chunkflow.oracles import ORACLES
from chunkflow.queries import QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    r = duck.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in r.fetchall())
    assert got == want
    assert got
