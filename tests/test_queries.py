"""Every query with SQL gives the same rows as DuckDB, in any order."""

import math
import os

import duckdb
import pytest

from quillon.plans import registry

DATA = os.environ.get("QUILLON_TEST_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    return f"{float(v):.7g}"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert len(got) == len(want) and len(got) > 0
    assert got == want


def test_packed_samples_on_odd_rows(spark, tmp_path):
    """Copies of rows, empty texts, missing ids, sources and lengths: as the SQL has them."""
    con, at = duckdb.connect(), f"{tmp_path}/documents.parquet"
    con.execute(f"""copy (select case when i = 9 then null else i - 20 end as doc_id, case when i % 41 = 5 then null else 'src' || (i % 4) end as source, case when i % 5 < 2 then 0 when i % 37 = 3 then null else i * 7919 % 1500 end::bigint as n_chars
 from range(200) r(i), range(2) union all select i, 'empty', 0 from range(5) r(i) union all select null, 'noid', 10) to '{at}' (format parquet)""")
    con.execute(f"create view documents as select * from read_parquet('{at}')")
    want = con.execute(registry.oracle_sql()["packed_samples"])
    names = [d[0] for d in want.description]
    got = registry.queries()["packed_samples"](spark, str(tmp_path)).select(names).collect()
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in want.fetchall())


def test_packed_samples_of_one_id_in_the_order_of_the_table(spark, tmp_path):
    rows = [(7, "s", 900), (7, "s", 100), (7, "s", 1500), (7, "s", 600)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["packed_samples"](spark, str(tmp_path)).collect()
    assert sorted((r.pack, r.n, r.total) for r in got) == [(0, 1000, 7000), (1, 1500, 10500), (2, 600, 4200)]
