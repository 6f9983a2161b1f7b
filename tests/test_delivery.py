"""Deliveries that fail halfway, run again, keep to budgets and take rows back."""

import pytest
from tessella.sources import delivery
from tessella.sources.delivery import Delivery
from tessella.sources.tables import fresh

SCHEMA = "id int, title string, stars int"


class Target:
    """A store written by key, which may fail after it has taken a chunk."""

    def __init__(self, fail_at=None):
        self.rows, self.calls, self.fail_at = {}, [], fail_at

    def __call__(self, part, chunk):
        got = part.collect()
        self.calls.append((chunk, len(got), {r.change for r in got}))
        for r in got:
            if r.change == "withdrawn":
                self.rows.pop(r.id, None)
            else:
                self.rows[r.id] = (r.title, r.stars)
        if self.fail_at == len(self.calls):
            raise OSError("the target went away")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_a_run_that_fails_halfway_and_runs_again(spark):
    rows = [(k, f"t{k}", None if k % 4 == 0 else k) for k in range(23)]
    target, d = Target(fail_at=3), Delivery(spark, fresh(spark, "d"), "id", "int")
    with pytest.raises(OSError, match="went away"):
        d.deliver(table(spark, rows), target, 5, "2026-01-01")
    assert d.accepted().count() == 10 and d.spent("2026-01-01") == 10
    target.fail_at = None
    assert d.deliver(table(spark, rows), target, 5, "2026-01-01") == 0
    assert target.rows == {k: (t, s) for k, t, s in rows} and d.spent("2026-01-01") == 23
    assert [n for _, n, _ in target.calls] == [5, 5, 5, 5, 5, 3]  # only the unconfirmed chunk went twice
    assert d.deliver(table(spark, rows), target, 5, "2026-01-02") == 0 and len(target.calls) == 6


def test_changes_and_withdrawals_first_and_a_budget(spark):
    old = [(k, f"t{k}", k) for k in range(10)]
    new = [(k, f"t{k}", k + (100 if k < 3 else 0)) for k in range(6)] + [(50, None, None), (51, "", 0)]
    target, d = Target(), Delivery(spark, fresh(spark, "d"), "id", "int")
    d.deliver(table(spark, old), target, 100, "a")
    target.calls.clear()
    assert d.deliver(table(spark, new), target, 4, "b", budget=5) == 2
    assert target.calls == [(0, 4, {"withdrawn"})] and sorted(target.rows) == list(range(6))
    assert d.deliver(table(spark, new), target, 4, "b", budget=5) == 2  # the day is spent
    assert d.deliver(table(spark, new), target, 4, "c", budget=5) == 0
    assert target.rows == {k: (t, s) for k, t, s in new} and (d.spent("b"), d.spent("c")) == (4, 5)


def test_a_row_withdrawn_comes_back_and_all_is_sent_after_forget(spark):
    target, d = Target(), Delivery(spark, fresh(spark, "d"), "id", "int")
    for rows in ([(1, "a", 1), (2, "b", 2)], [(2, "b", 2)], [(1, "a", 1), (2, "b", 2)], []):
        d.deliver(table(spark, rows), target, 10, "x")
        assert target.rows == {k: (t, s) for k, t, s in rows}
    assert d.accepted().count() == 0
    d.deliver(table(spark, [(2, "b", 2)]), target, 10, "x")
    d.forget()
    target.rows.clear()
    d.deliver(table(spark, [(2, "b", 2)]), target, 10, "x")
    assert target.rows == {2: ("b", 2)}


def test_many_chunks_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(delivery, "FOLDERS", 3)
    target, d = Target(), Delivery(spark, fresh(spark, "d"), "id", "int")
    d.deliver(table(spark, [(k, "t", k) for k in range(9)]), target, 2, "x")
    assert len(d._commits.last()[1]["folders"]) < 3 and d.accepted().count() == 9
    d.deliver(table(spark, [(k, "t", k) for k in range(4)]), target, 2, "x")
    assert sorted(target.rows) == [0, 1, 2, 3]
