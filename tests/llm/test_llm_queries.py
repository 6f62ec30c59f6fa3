"""The registered queries against their SQL, on the smallest tables."""

import pytest
from conftest import DATA

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(name, agree):
    assert agree(queries.QUERIES[name], queries.SQL[name]) > 0


def test_one_query_for_each_operator(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert queries.QUERIES["op1_html_extraction"](spark, DATA).columns[:4] == ["page_id", "url", "text", "n_chars"]
