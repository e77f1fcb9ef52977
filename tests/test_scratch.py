"""Scratch tables: scopes and settings of several threads, and what is left."""

import threading
from pathlib import Path

from sweepframe.functions import scratch


def test_scopes_of_threads_are_apart(spark):
    found, opened, written = {}, threading.Event(), threading.Event()

    def other():
        opened.wait(60)
        found["table"] = scratch.materialise(spark.range(5))
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch.scope(spark) as folder:
        mine = scratch.materialise(spark.range(3))
        assert mine.count() == 3 and Path(folder.removeprefix("file:")).exists()
        opened.set()
        assert written.wait(120)
    thread.join()
    assert found["table"].count() == 5
    assert not Path(folder.removeprefix("file:")).exists()


def test_scopes_nest(spark):
    with scratch.scope(spark) as outer:
        kept = scratch.new_path(spark)
        with scratch.scope(spark) as inner:
            assert inner.startswith(outer) and scratch.new_path(spark).startswith(inner)
        assert kept.startswith(outer) and scratch.new_path(spark).startswith(outer)


def test_settings_of_threads_that_overlap(spark):
    key = "spark.sql.test.of.settings"
    first, second = scratch.settings(spark, {key: "1"}), scratch.settings(spark, {key: "1"})
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == "1"
    second.__exit__(None, None, None)
    assert spark.conf.get(key, None) is None


def test_tables_are_in_the_folder_of_the_application(spark):
    path = scratch.new_path(spark)
    assert path.startswith(f"{scratch.shared_dir(spark)}/{spark.sparkContext.applicationId}/")
