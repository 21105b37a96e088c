import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.operators.matching import Controls
from labelweave.plans import folds


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def nearest(case, controls):
    """Brute force over all that are left: (distance, control)."""
    name, traits, size = case
    return min(((*(int(a != b) for a, b in zip(t, traits)), abs(n - size), sha(f"{name}\0{i}")), i) for i, t, n in controls)


rows = st.lists(st.tuples(st.tuples(st.sampled_from("ab"), st.integers(0, 2), st.sampled_from("xy")), st.integers(0, 6)), max_size=25)


@settings(max_examples=200, deadline=None)
@given(rows, rows)
def test_each_case_takes_the_nearest_that_is_left(controls, cases):
    pool, left = Controls(), [(i, *c) for i, c in enumerate(controls)]
    for i, t, n in left:
        pool.add(i, t, n)
    for k, (t, n) in enumerate(cases):
        got = pool.take(k, t, n)
        if not left:
            assert got is None
            continue
        distance, name = nearest((k, t, n), left)
        assert got == (name, distance[:3], distance[3])
        left = [c for c in left if c[0] != name]


def test_matched_controls_of_every_day(spark, sf):
    days = defaultdict(lambda: ([], []))
    for r in folds.matching_rows(spark, sf).collect():
        days[r["day"]][r["case"]].append((r["event_id"], (r["action"], r["kind"]), r["size"]))
    want = {}
    for left, cases in days.values():
        for case in sorted(cases, key=lambda c: sha(str(c[0]))):
            if left:
                distance, name = nearest(case, left)
                left.remove(next(c for c in left if c[0] == name))
                want[case[0]] = (name, *distance[:3])
            else:
                want[case[0]] = (None,) * 4
    got = {r["event_id"]: (r["control"], r["other_action"], r["other_kind"], r["gap"]) for r in folds.j14_matched_controls(spark, sf).collect()}
    assert got == want and len({c for c, *_ in got.values() if c is not None}) == sum(c is not None for c, *_ in got.values()) > 0
