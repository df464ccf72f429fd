import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def result(spark):
    """Columns and rows of a query over DATA, run once for all tests."""
    from vellum.llm.queries import QUERIES

    known = {}

    def of(name):
        if name not in known:
            df = QUERIES[name](spark, DATA)
            known[name] = df.columns, df.collect()
        return known[name]

    return of
