"""Journals are published whole: a failure at any step leaves the old one or the new one."""

import datetime as dt

import pytest

from tallyspark.operators import journal


def texts(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), i, t) for d, i, t in rows], "date date, id long, text string")


def lines(spark, path):
    return [r.value for r in journal.read_journal(spark, path).collect()]


@pytest.mark.parametrize("step", range(6))
def test_a_failure_at_any_step_leaves_a_whole_journal(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/journal"
    old, new = texts(spark, [(1, 1, "a"), (2, 2, "b")]), texts(spark, [(1, 1, "a"), (3, 3, "c")])
    assert journal.publish(old, path) == "written"
    calls = {"n": 0}

    def failing(real):
        def run(*args):
            calls["n"] += 1
            if calls["n"] == step + 1:
                raise OSError("lost")
            return real(*args)
        return run

    with monkeypatch.context() as m:
        m.setattr(journal, "write_journal", failing(journal.write_journal))
        m.setattr(journal._Folder, "rename", failing(journal._Folder.rename))
        m.setattr(journal._Folder, "delete", failing(journal._Folder.delete))
        with pytest.raises(OSError, match="lost"):
            journal.publish(new, path)
    committed = step > 2  # deletion of leftovers, text, rename
    assert lines(spark, path) == (["a", "c"] if committed else ["a", "b"])
    assert journal.publish(new, path) == ("unchanged" if committed else "written") and lines(spark, path) == ["a", "c"]
    assert sorted(p.name for p in (tmp_path / "journal").iterdir() if not p.name.startswith(".")) == ["about", "entries"]


def test_changed_days_are_found_without_their_texts(spark):
    old, new = (journal.day_hashes(texts(spark, r)) for r in ([(1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d")], [(1, 2, "b"), (1, 1, "a"), (2, 3, "C"), (4, 5, "e")]))
    assert {(r.date.day, r.change) for r in journal.changed_days(old, new).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert journal.digest(texts(spark, [(1, 1, "a"), (2, 3, "c")])).first()["digest"] == sum(r.digest for r in journal.day_hashes(texts(spark, [(1, 1, "a"), (2, 3, "c")])).collect())
