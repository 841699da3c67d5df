import pytest

from oracle import connect, differs

from helixframe.plans import analyses, catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert differs(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
