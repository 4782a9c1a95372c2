"""Staged tables and when they go."""

import os

from lexidom.session import released, shared_root, stage


def _tables(spark):
    return set(os.listdir(shared_root(spark).removeprefix("file:")))


def test_released_deletes_what_is_not_lasting(spark):
    before = _tables(spark)
    with released(spark):
        gone = stage(spark.range(10), "inner")
        kept = stage(gone.where("id > 6"), "outer", lasting=True)
    assert sorted(r.id for r in kept.collect()) == [7, 8, 9]
    assert {x.rsplit("-", 1)[0] for x in _tables(spark) - before} == {"outer"}


def test_lasting_belongs_to_the_block_around(spark):
    before = _tables(spark)
    with released(spark):
        with released(spark):
            kept = stage(spark.range(3), "middle", lasting=True)
        assert kept.count() == 3
    assert _tables(spark) == before


def test_released_after_a_failure(spark):
    before = _tables(spark)
    try:
        with released(spark):
            stage(spark.range(3), "failed")
            raise ValueError
    except ValueError:
        pass
    assert _tables(spark) == before
    stage(spark.range(1), "alone")
    assert len(_tables(spark) - before) == 1
