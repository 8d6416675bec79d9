"""Schema revisions up and down."""

import pytest

from kairosift.sources import migrations as m


def shapes(tables):
    return {name: df.columns for name, df in tables.items()}


def test_up_and_down(spark):
    head = m.upgrade(spark, {}, 0)
    assert len(m.REVISIONS) == 7 and len(head) == 10 and "active_version_id" in head["documents"].columns and "normalized_artifact_key" in head["runs"].columns
    assert [tuple(r) for r in head["pointer"].collect()] == [(1, "pg1", "srg1")] and head["generations"].count() == 2 and head["chunks"].count() == 0
    for n in range(len(m.REVISIONS) + 1):  # each revision is reached from below and from above
        below = m.upgrade(spark, {}, 0, n)
        assert shapes(m.downgrade(head, len(m.REVISIONS), n)) == shapes(below)
        assert shapes(m.upgrade(spark, below, n)) == shapes(head)


def test_rows_stay(spark):
    six = m.upgrade(spark, {}, 0, 6)
    six["documents"] = spark.createDataFrame([("d1", "c1", "t")], six["documents"].schema)
    seven = m.upgrade(spark, six, 6)
    assert [tuple(r) for r in seven["documents"].collect()] == [("d1", "c1", "t", None)]
    assert [tuple(r) for r in m.downgrade(seven, 7, 6)["documents"].collect()] == [("d1", "c1", "t")]


def test_tables_of_another_revision(spark):
    head = m.upgrade(spark, {}, 0)
    for wrong in (lambda: m.upgrade(spark, head, 6), lambda: m.upgrade(spark, head, 3), lambda: m.downgrade({}, 7, 3 - 3), lambda: m.upgrade(spark, {}, 2, 3)):
        with pytest.raises((m.RevisionError, KeyError)):
            wrong()
