import random

import pytest

from stratadup.operators import reports


def literal(lookups, window):
    """The reference's array of last containers: a hit moves to the end, else the first one goes."""
    last, near = [None] * window, 0
    for c in lookups:
        j = last.index(c) if c in last else 0
        near += c in last
        last = last[:j] + last[j + 1 :] + [c]
    return near


@pytest.mark.parametrize("window", [1, 3, 8])
def test_near_lookups_equal_a_literal_model(spark, window):
    rng = random.Random(window)
    streams = {0: [0] + [1] * 8 + [0], 1: [], 2: []}
    for n in (1, 2):
        while len(streams[n]) < 300:
            streams[n] += [rng.randrange(12)] * rng.randrange(1, 6)
    features, index, decisions = [], [], []
    for node, containers in streams.items():
        index += [(node, f"{node}-{c}", c) for c in set(containers)]
        for k, c in enumerate(containers):
            seg = 3 * (k // 4) + node
            features.append((seg, k % 4, f"{node}-{c}"))
        decisions += [(3 * k + node, node) for k in range(-(-len(containers) // 4))]
    got = reports.locality(
        spark.createDataFrame(features, "seg_id long, fea_pos long, fea string"),
        spark.createDataFrame(index, "node int, fea string, container_id long"),
        spark.createDataFrame(decisions, "seg_id long, node int"),
        window,
    ).collect()
    assert {r.node: (r.lookups, r.near) for r in got} == {n: (len(s), literal(s, window)) for n, s in streams.items()}
    assert window < 2 or {r.node: r.near for r in got}[0] == 8
