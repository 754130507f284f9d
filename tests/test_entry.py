import __spark_entry__ as entry


def test_every_query_of_the_library_has_a_name_and_a_function():
    assert len(entry.queries()) > 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
