from sheafwork.llm import queries
from tests.test_queries import DATA, compare, pytestmark  # noqa: F401


def test_against_sql(spark):
    compare(spark, sorted(queries.SQL), queries.QUERIES, queries.SQL)


def test_queries_without_sql(spark):
    for n in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[n](spark, DATA).count() > 0
