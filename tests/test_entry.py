import importlib.util

import __spark_entry__


def test_every_query_is_registered(spark):
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and "front_render" in names
    assert __spark_entry__.entry(spark).count() == 330
    if importlib.util.find_spec("glossaria.llm"):
        assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
