import __spark_entry__


def test_all_sql_is_text_and_has_its_query():
    sql = __spark_entry__.oracle_sql()
    assert sql and all(isinstance(s, str) for s in sql.values())
    assert sql.keys() <= __spark_entry__.queries().keys()
