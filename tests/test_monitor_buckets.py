"""The ordered monitor with many records to a group: results do not depend on how records are dealt."""

import random

from test_arrivals import CHART, ROWS, figures, finish, stream

from orrery.streaming import monitor


def test_records_of_a_group_share_its_cost_and_nothing_else(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, t * 10, t, rng.gauss(800, 50), False) for k in [None, *range(12)] for t in range(20 + (k or 0))]
    came = sorted(rows, key=lambda r: r[1] + rng.random() * 40)
    # a record that ends early has late rows, its neighbours in the group go on
    cut = [came[: len(came) // 2], [*came[len(came) // 2 :], (3, 10_000, None, None, True)], [(3, 20_000, 99, 1.0, False)], [(k, 10_000, None, None, True) for k in [None, *range(12)] if k != 3]]
    made = {b: finish(monitor.ordered_monitor(stream(spark, tmp_path / f"{b}", cut, ROWS), 50, 5, CHART, buckets=b), tmp_path / f"{b}") for b in (1, 1024)}
    named = {b: figures([r for r in rows if r.record_id is not None]) for b, rows in made.items()}
    assert named[1] == named[1024] and len(named[1]) == sum(15 + k for k in range(12))
    for rows in made.values():
        assert [(r.record_id, r.rr_ms) for r in rows if r.late] == [(3, 1.0)]
        assert sorted(r.idx for r in rows if r.record_id is None and not r.late) == list(range(5, 20))
