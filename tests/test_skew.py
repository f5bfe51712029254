from collections import Counter, defaultdict
from random import Random

from lociforge.operators.skew import dominant_contigs, reads_per_contig

SCHEMA = "read_id bigint, pool_id bigint, ref_id int, pos int, flag int, n_reads int"


def brute(rows):
    seen, by = set(), defaultdict(Counter)
    for read, pool, ref, pos, flag, _ in rows:
        if pool is None or ref is None or ref < 0 or pos is None or (flag or 0) & 4:
            continue
        if read is not None:
            if (pool, ref, pos, read) in seen:
                continue
            seen.add((pool, ref, pos, read))
        by[pool, ref][pos] += 1
    total = Counter()
    for (pool, _), c in by.items():
        total[pool] += sum(c.values())
    return {(p, r, sum(c.values()), len(c), min(c), max(c), min(k for k in c if c[k] == max(c.values())), max(c.values()), total[p]) for (p, r), c in by.items()}


def test_against_brute_force_with_a_hot_key(spark):
    rng = Random(3)
    rows = []
    for i in range(6000):
        hot = rng.random() < 0.5
        pool, ref = (1, 7) if hot else (rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None, -1]))
        pos = 55 if hot and rng.random() < 0.7 else rng.randrange(40)
        rows.append((i if rng.random() < 0.95 else None, pool, ref, None if rng.random() < 0.02 else pos, rng.choice([0, 16, 4, None]), 1))
    rows += [rng.choice(rows) for _ in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = reads_per_contig(df).collect()
        assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {tuple(r) for r in dominant_contigs(df).collect()} == {x[:2] for x in brute(rows) if 4 * x[2] >= x[8]}


def test_empty(spark):
    assert reads_per_contig(spark.createDataFrame([], SCHEMA)).count() == 0
