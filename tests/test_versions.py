"""Versioned tables: exclusive commits, bounded files, readers of old versions, lost writers."""

import os

import pytest

from pollwarden.sources import sinks


def files(base):
    return sum(len(names) for _, _, names in os.walk(base))


def test_many_writes_leave_a_bounded_number_of_files(spark, tmp_path):
    base = str(tmp_path / "t")
    assert sinks.current_version(spark, base) == (0, None) and sinks.read_current(spark, base) is None
    counts = []
    for i in range(30):
        sinks.write_version(spark.range(i, i + 1, 1, 1), base, retain=3, min_age_sec=0)
        counts.append(files(base))
        assert sinks.read_current(spark, base).first()[0] == i
    assert sinks.current_version(spark, base)[0] == 30
    assert max(counts[5:]) == counts[5] and len(os.listdir(f"{base}/data")) == 3


def test_a_reader_of_an_old_version_finishes(spark, tmp_path):
    base = str(tmp_path / "t")
    sinks.write_version(spark.range(5), base)
    old = sinks.read_current(spark, base)
    for _ in range(4):
        sinks.write_version(spark.range(1), base, retain=1)  # young versions stay
    assert old.count() == 5
    sinks.write_version(spark.range(2), base, retain=2, min_age_sec=0)
    assert len(os.listdir(f"{base}/data")) == 2 and sinks.read_current(spark, base).count() == 2


def test_a_second_writer_is_refused_and_a_log_merges_anew(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    sinks.write_version(spark.range(1), base)
    with pytest.raises(sinks.VersionConflict):
        sinks.write_version(spark.range(1), base, expected=0)
    rows = spark.createDataFrame([(1, "a")], "timestamp int, v string")
    log, real, raced = str(tmp_path / "log"), sinks.write_version, []

    def late(df, where, **options):
        if not raced:
            raced.append(real(spark.createDataFrame([(2, "other")], "timestamp int, v string"), where))
        return real(df, where, **options)

    monkeypatch.setattr(sinks, "write_version", late)
    sinks.append_bounded(spark, rows, log)
    assert sorted(r["v"] for r in sinks.read_current(spark, log).collect()) == ["a", "other"]


def test_a_lost_writer_leaves_no_version_and_its_data_goes(spark, tmp_path):
    base = str(tmp_path / "t")
    sinks.write_version(spark.range(3), base)
    open(f"{base}/versions/{2:020d}", "w").close()  # claimed, never filled
    spark.range(9).write.parquet(f"{base}/data/orphan")
    assert sinks.current_version(spark, base)[0] == 1
    sinks.write_version(spark.range(4), base, orphan_sec=0)
    assert sinks.current_version(spark, base)[0] == 3 and sinks.read_current(spark, base).count() == 4
    assert len(os.listdir(f"{base}/data")) == 2
