"""Every registered query of the library against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from siftwell.plans import catalogue

SF = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def norm(v):
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    if isinstance(v, bool | int | str) or v is None:
        return v
    if hasattr(v, "__float__"):
        return "nan" if math.isnan(float(v)) else round(float(v), 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = duck.sql(SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert cols == sorted(want.columns)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_reduced_numbers_just_below_zero_keep_their_sign(spark, tmp_path):
    small = [-0.000001, 0.000001, -0.0, -0.000006, 0.3, -0.00005, 0.0000045]
    rows = [(0, [1.0] * 4 + [x for v in small for x in [v] * 4] + [0.5, -0.5] * 16, 1), (1, [0.25, -0.5] * 32, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.reduced for r in QUERIES["mrl_reduce_16"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(c.sql(SQL["mrl_reduce_16"]).fetchall())
    assert str(got[0][1]) == "-0.0"  # which equals 0.0, so the texts are compared
    assert {k: list(map(str, v)) for k, v in got.items()} == {k: list(map(str, v)) for k, v in want.items()}
