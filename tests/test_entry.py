"""Registered queries against their oracles on the smallest tables."""

import os

import pytest
from compare import differences

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


def test_every_query_has_an_oracle():
    own = {q.__name__ for q in entry._QUERIES}
    assert own <= set(ORACLE) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [q.__name__ for q in entry._QUERIES if not q.__name__.startswith("pv_")])
def test_query(spark, name):
    assert differences(entry.queries()[name](spark, SF), ORACLE[name], SF) == []


class Stop(Exception):
    pass


def _asked(monkeypatch, query):
    """The settings a query trains with and the epochs it infers with."""
    seen = []

    class Model:
        def infer(self, docs, epochs=20):
            seen.append(epochs)
            raise Stop

        def doc_vectors(self):
            raise Stop

    class Trainer:
        def __init__(self, params):
            seen.append(params)

        def fit(self, docs):
            return Model()

    monkeypatch.setattr(entry.pv, "PVTrainer", Trainer)
    monkeypatch.setattr(entry, "_corpus", lambda *_: None)
    with pytest.raises(Stop):
        query(None, "")
    return seen


def test_pv_train_is_whole(monkeypatch):
    params, = _asked(monkeypatch, entry.pv_train)
    assert params == entry.pv.PVParams() and (params.vector_size, params.epochs) == (200, 20)


def test_pv_infer_is_whole(monkeypatch):
    params, epochs = _asked(monkeypatch, entry.pv_infer)
    assert params == entry.pv.PVParams() and epochs == 20
