from fractions import Fraction

from speechgrid.operators import ops


def test_long_queue_is_added_exactly(spark):
    """The seconds ahead are the exact sums, whatever the order of adding and the length of the queue."""
    jobs = [(i, "running" if i % 3 == 0 else "queued", i * 4_000_000 // 7) for i in range(6_000)]
    left = {i: (i * 7919 % 100_003 * 10_007 + i) / 10_000 for i, _, _ in jobs}
    j = spark.createDataFrame(jobs, "job_id bigint, status string, queued_ms bigint")
    got = {r.job_id: (r.position, r.ahead_s) for r in ops.queue_report(j, spark.createDataFrame(list(left.items()), "job_id bigint, left_s double")).collect()}
    ahead = sum(Fraction(repr(left[i])) for i, s, _ in jobs if s == "running")
    want, position = {}, 0
    for i, s, _ in jobs:
        if s == "queued":
            position += 1
            want[i] = (position, float(ahead))
            ahead += Fraction(repr(left[i]))
    assert got == want
