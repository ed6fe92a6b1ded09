import __spark_entry__ as e


def test_contract():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"gold_consensus", "greedy_eval", "p6_found"} <= set(e.queries())
