"""Sessions appended file by file."""

from __future__ import annotations

import pytest

from pacelake.sources.ledger import MESSAGES, append_sessions, read_sessions


@pytest.fixture()
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("source", "target", "ledger")}


def _put(spark, folders, *activities):
    rows = [(1, a, i, kind, {"sport": "running"}) for a in activities for i, kind in enumerate(("RECORD", "SESSION", "EVENT"))]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(folders["source"])


def _found(spark, folders):
    return sorted(r["activity_id"] for r in read_sessions(spark, folders["target"]).collect())


def test_only_new_files_are_appended(spark, folders):
    _put(spark, folders, "a", "b")
    assert append_sessions(spark, **folders) == 1
    assert append_sessions(spark, **folders) == 0
    _put(spark, folders, "c")
    assert append_sessions(spark, **folders) == 1
    assert _found(spark, folders) == ["a", "b", "c"]


def test_batches_are_bounded(spark, folders):
    for activity in "abc":
        _put(spark, folders, activity)
    assert append_sessions(spark, **folders, files_per_batch=1) == 3
    assert _found(spark, folders) == ["a", "b", "c"]


@pytest.mark.parametrize("lost", ["ledger only", "ledger and target"])
def test_a_batch_stopped_before_its_commit_is_not_doubled(spark, folders, tmp_path, lost):
    """As a killed run leaves it: the batch is planned and its files lie there, but it was not committed."""
    _put(spark, folders, "a", "b")
    append_sessions(spark, **folders)
    _put(spark, folders, "c")
    append_sessions(spark, **folders)
    unfinished = [tmp_path / "ledger" / "commits" / "1"]
    if lost == "ledger and target":
        unfinished.append(tmp_path / "target" / "_spark_metadata" / "1")
    for path in unfinished:
        path.unlink()
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    if lost == "ledger and target":
        assert _found(spark, folders) == ["a", "b"]
    append_sessions(spark, **folders)
    _put(spark, folders, "d")
    append_sessions(spark, **folders)
    assert _found(spark, folders) == ["a", "b", "c", "d"]
