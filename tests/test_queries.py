"""Every registered core query with SQL, compared with DuckDB over whole small tables."""

import datetime
import math
import os

import duckdb
import pytest

from sheafwork import queries

DATA = os.environ.get("SHEAFWORK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, names, queries_, sql):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DATA}/{f}'")
    for n in names:
        df = queries_[n](spark, DATA)
        r = c.execute(sql[n])
        cols = sorted(df.columns)
        theirs = [x[0] for x in r.description]
        assert cols == sorted(theirs), n
        ours = sorted(str([plain(x[k]) for k in cols]) for x in df.collect())
        want = sorted(str([plain(x[theirs.index(k)]) for k in cols]) for x in r.fetchall())
        assert ours == want, n


@pytest.mark.parametrize("part", range(8))
def test_against_sql(spark, part):
    compare(spark, sorted(queries.SQL)[part::8], queries.QUERIES, queries.SQL)


def test_queries_without_sql(spark):
    for n in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[n](spark, DATA).count() > 0, n
