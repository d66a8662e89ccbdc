import pytest

from corpusmill.plans import document_queries, model_queries, page_queries, relational_queries, retrieval_queries, sequence_queries, text_queries

from .conftest import SF
from .helpers import same

MODULES = (retrieval_queries, text_queries, relational_queries, sequence_queries, document_queries, model_queries, page_queries)
CASES = [(m, k) for m in MODULES for k in m.SQL]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[k for _, k in CASES])
def test_against_sql(spark, duck, module, name):
    same(module.Q[name](spark, SF), duck.execute(module.SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
