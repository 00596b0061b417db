import os

from veilscan.session import discard, materialise, remove_work


def folder(table):
    return table.written_to.removeprefix("file:")


def test_a_session_deletes_its_own_tables_only(spark):
    other = spark.newSession()
    mine, theirs = materialise(spark.range(3), "mine"), materialise(other.range(4), "theirs")
    again = materialise(other.range(5), "theirs")
    discard(theirs)
    assert not os.path.exists(folder(theirs)) and again.count() == 5
    remove_work(other)
    assert not os.path.exists(folder(again)) and mine.count() == 3
