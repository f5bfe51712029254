from collections import defaultdict
from random import Random

import pytest

from lociforge.operators.intervals import clean_regions, periods_and_gaps

SCHEMA = "list_id bigint, ref_id int, reg_start int, reg_stop int, kind string"


def brute(rows):
    by = defaultdict(list)
    for k, r, a, b in rows:
        if a is not None and b is not None and b > a:
            by[k, r].append((a, b))
    out = set()
    for (k, r), v in by.items():
        merged = []
        for a, b in sorted(v):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, r, "period", a, b) for a, b in merged}
        out |= {(k, r, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("tile", [1 << 22, 16, 3])
def test_periods_against_brute_force(spark, tile):
    rng = Random(tile)
    rows = [(rng.choice([1, 2, None]), rng.choice([0, 5]), a := rng.randrange(200), a + rng.choice([0, 1, 2, 5, 40])) for _ in range(300)]
    rows += [(9, 1, 0, 5), (9, 1, 5, 8), (9, 1, 5, 8), (9, 1, 10, 11), (9, 1, None, 4), (9, 1, 3, None), (8, 1, 0, 1000), (8, 1, 4, 6), (8, 1, 998, 999)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = periods_and_gaps(df, ["list_id", "ref_id"], "reg_start", "reg_stop", tile).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows)


def test_cleaning(spark):
    contigs = spark.createDataFrame([(0, 100), (0, 100), (1, None), (None, 7)], "ref_id int, length bigint")
    rows = [(1, 0, None, 10), (1, 0, -5, 200), (1, 0, 50, None), (1, 0, 60, 50), (1, 3, 1, 2), (1, None, 1, 2), (2, 1, 3, 9), (2, 1, 3, None), (None, 0, 1, 2)]
    got = clean_regions(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), contigs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, 0, 10), (1, 0, 0, 100), (1, 0, 50, 100), (2, 1, 3, 9), (None, 0, 1, 2)]))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(df, ["list_id", "ref_id"], "reg_start", "reg_stop").count() == 0
