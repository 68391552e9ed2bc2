"""Which tables go at the end of a block."""

import os
import threading

import pytest

from snapweave.storage import Scratch, released


def local(scratch):
    return scratch.root.removeprefix("file:").replace("///", "/")


def test_a_block_releases_its_own_tables_also_after_errors(spark):
    kept, before = Scratch(spark, "kept"), Scratch(spark, "before")
    before.save(spark.range(1), "x")
    made, other = [], []

    def elsewhere():
        other.append(Scratch(spark, "other"))
        other[0].save(spark.range(1), "x")

    with pytest.raises(ZeroDivisionError), released(spark, kept):
        made.append(Scratch(spark, "made"))
        made[0].save(spark.range(1), "x")
        with released(spark, kept):
            made.append(Scratch(spark, "inner"))
            made[1].save(spark.range(1), "x")
        assert not os.path.exists(local(made[1])) and os.path.exists(local(made[0]))
        thread = threading.Thread(target=elsewhere)
        thread.start()
        thread.join()
        kept.save(spark.range(1), "x")
        raise ZeroDivisionError
    assert [os.path.exists(local(x)) for x in (kept, before, *made, *other)] == [True, True, False, False, True]
