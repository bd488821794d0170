from itertools import count

from visitlake.llm import store


def test_written_tables_clear_the_driver(spark, monkeypatch):
    """Every so many tables the driver collects its garbage; the tables themselves stay whole."""
    cleared = []
    whole = store.clear_driver

    def clear(session):
        cleared.append(session)
        whole(session)

    monkeypatch.setattr(store, "clear_driver", clear)
    monkeypatch.setattr(store, "_written", count(1))
    tables = [store.materialise(spark.range(k).repartition(3), "some") for k in range(2 * store.CLEAR_EVERY)]
    assert len(cleared) == 2
    assert [t.count() for t in tables] == list(range(2 * store.CLEAR_EVERY))
