"""Samples by quotas against the same choices row by row."""

import hashlib
import random

import pytest

from tessera.plans.sampling import Quotas, sample

SCHEMA = "boundary_id string, source string, variant string, type string, timing_band string, tags array<string>, h string"


def rows_of(n, seed, sources):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        tags = [t for t in ("a", "b", "c") if draw.random() < 0.2] if i % 7 else None
        source = draw.choice(sources)
        rows.append((f"k{i}", source, draw.choice(["v1", "v2", None]), draw.choice(["t1", "t2"]), draw.choice(["x", "y", None]), tags, hashlib.sha256(f"{seed}/{i // 2}".encode()).hexdigest()))
    return rows


def by_hand(rows, q):
    rows = sorted(rows, key=lambda r: (r[6], r[0]))
    chosen = []

    def fill(holds, quota):
        for r in rows:
            if sum(map(holds, chosen)) >= quota:
                break
            if holds(r) and r not in chosen:
                chosen.append(r)

    for tag in sorted(q.tags):
        fill(lambda r, tag=tag: tag in (r[5] or ()), q.tags[tag])
    for band in sorted(q.bands):
        fill(lambda r, band=band: r[4] == band, q.bands[band])
    for column, quota in ((1, q.source), (2, q.variant), (3, q.type)):
        for value in {r[column] for r in rows}:
            fill(lambda r, column=column, value=value: r[column] == value, quota)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, s or ""))
    left = q.target - len(chosen)
    if left > 0 and all(sum(r[1] == s for r in chosen) >= q.source for s in sources):
        share = max(1, left // len(sources))
        for s in sources:
            for r in rows:
                if sum(c[1] == s for c in chosen) >= share or left <= 0:
                    break
                if r[1] == s and r not in chosen:
                    chosen.append(r)
                    left -= 1
    for s in sources:
        for r in rows:
            if r[1] == s and r not in chosen and len(chosen) < q.target:
                chosen.append(r)
    return {r[0] for r in chosen}


@pytest.mark.parametrize(
    "n, sources, q",
    [
        (300, ["s1", "s2", "s3"], Quotas(60, 6, 5, 4, {"a": 9, "c": 3}, {"y": 8})),
        (300, ["s1"] * 9 + ["s2", None], Quotas(120, 40, 5, 4, {"a": 9, "nowhere": 3}, {"y": 8})),
        (200, ["s1", "s2"], Quotas(10, 3, 30, 20, {"b": 30}, {"x": 40})),
        (40, ["s1", "s2"], Quotas(250, 3, 3, 3, {}, {})),
    ],
)
def test_sample(spark, n, sources, q):
    rows = rows_of(n, n + len(sources), sources)
    got = [r["boundary_id"] for r in sample(spark.createDataFrame(rows, SCHEMA).repartition(3), q).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, q)


def test_no_rows(spark):
    assert sample(spark.createDataFrame([], SCHEMA)).count() == 0
