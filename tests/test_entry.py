"""The driver contract: keys, oracle coverage, flagship smoke run."""

import __spark_entry__ as E


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40
    from acctsig.plans.catalog import ORACLES, QUERIES
    # What the learners themselves give is beyond SQL.
    assert set(QUERIES) - set(ORACLES) == {"ensemble_predict", "feature_importance", "cross_dataset_report"}
    assert set(ORACLES) <= set(QUERIES) <= set(q)


def test_the_rest_stands_without_the_training_data_operators(monkeypatch, caplog):
    import sys
    for name in ("acctsig.llm", "acctsig.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    assert not any(k.startswith("op") for k in E.queries()) and len(E.queries()) >= 40
    assert "acctsig.llm" in caplog.text


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 2 + 106 + 1
    assert df.count() > 0
