from siltworks.llm import registry


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 11))
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries())
