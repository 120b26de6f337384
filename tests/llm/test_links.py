import random

import pytest

from ordermill.llm.links import components


@pytest.mark.parametrize("task_links", [7, 10_000])
def test_components(spark, task_links):
    dice = random.Random(task_links)
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    loose = [(dice.randrange(1000, 1100), dice.randrange(1000, 1100)) for _ in range(50)]
    links = chain + star + loose + [(5, 5), (-9, -3), (-3, -9)]
    dice.shuffle(links)
    root = {k: k for pair in links for k in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    wanted = {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in links)}
    frame = spark.createDataFrame(links, "a long, b long").repartition(6)
    found = components(frame, task_links).collect()
    assert len(found) == len(wanted) and {r["node"]: r["label"] for r in found} == wanted


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
