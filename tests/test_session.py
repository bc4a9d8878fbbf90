from __future__ import annotations

from ledgermill.session import settings_for

SHUFFLE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SCAN = "spark.sql.files.maxPartitionBytes"


def test_tasks_are_sized_for_the_input():
    assert SHUFFLE not in settings_for(None) and SCAN not in settings_for(None)
    small, large, huge = (settings_for(size) for size in (10**9, 10**12, 10**14))
    assert (small[SHUFFLE], small[SCAN]) == ("200", str(128 * 2**20))
    assert (large[SHUFFLE], large[SCAN]) == ("7451", str(128 * 2**20))
    assert (huge[SHUFFLE], huge[SCAN]) == ("20000", "1000000000")


def test_callers_can_set_the_bounds():
    huge = settings_for(10**14, max_scan_tasks=400_000, max_shuffle_partitions=100_000)
    assert (huge[SHUFFLE], huge[SCAN]) == ("100000", "250000000")
