from random import Random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lociforge.operators import badrows
from lociforge.operators.badrows import diagnose, parse_block, parse_records

CASES = {
    '10,A,0.5,+,C,note': None, '"10","a",".5","-","g","x, y"': None, '10, A ,1,+,t,\r': None, '10,A,0.5,+,C,"said ""so"""': None, '10,A,5e-1,+,A,': None,
    '10,A,0.5,+,C,"open': "quoting", '10,A,0.5,+,C,in"side': "quoting", '10,"A"x,0.5,+,C,n': "quoting", '10, "A",0.5,+,C,n': "quoting", '"10,A,0.5,+,C,n': "quoting",
    '': "column_count", '   ': "column_count", '\r': "column_count", '10,A,0.5,+,C': "column_count", '10,A,0,5,+,C,n': "column_count", '10\tA\t0.5\t+\tC\tn': "column_count",
    '0,A,0.5,+,C,n': "posi", '-5,A,0.5,+,C,n': "posi", '1.5,A,0.5,+,C,n': "posi", ',A,0.5,+,C,n': "posi", '" 10",A,0.5,+,C,n': "posi", '000,A,0.5,+,C,n': "posi", '٣,A,0.5,+,C,n': "posi",
    '10,N,0.5,+,C,n': "allele1", '10,AT,0.5,+,C,n': "allele1", '10,A,1.01,+,C,n': "freq", '10,A,nan,+,C,n': "freq", '10,A,-0.1,+,C,n': "freq", '10,A,.,+,C,n': "freq", '10,A,1e,+,C,n': "freq",
    '10,A,0.5,plus,C,n': "strand", '10,A,0.5,,C,n': "strand", '10,A,0.5,+,,n': "allele2", '10,A,0.5,+,5,n': "allele2",
}


def test_reasons_alone_and_in_blocks():
    for line, reason in CASES.items():
        assert diagnose(line)[0] == reason, line
        cols, reasons = parse_block(pa.array(["7,C,0.25,-,T,fine"] * 20 + [line] + ["7,C,0.25,-,T,fine"] * 20))
        assert reasons.to_pylist() == [None] * 20 + [reason] + [None] * 20
        assert cols[0].to_pylist()[:3] == [7, 7, 7]
        values = [c.to_pylist()[20] for c in cols]
        assert values == (diagnose(line)[1] or [None] * 6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='19.A"c, +-\r\n\tex', max_size=24) | st.sampled_from(list(CASES)) | st.none(), min_size=9, max_size=60))
def test_bulk_path_agrees_with_strict_diagnosis(lines):
    leaf, badrows.LEAF = badrows.LEAF, 1
    try:
        cols, reasons = parse_block(pa.array(lines, pa.string()))
    finally:
        badrows.LEAF = leaf
    assert reasons.to_pylist() == [diagnose(x)[0] for x in lines]
    for i, x in enumerate(lines):
        assert [c[i].as_py() for c in cols] == (diagnose(x)[1] or [None] * 6)


def test_all_rows_come_out(spark):
    rng = Random(1)
    lines = [rng.choice(list(CASES)) if rng.random() < 0.2 else f"{i + 1},A,0.5,+,C,{'long ' * 2000 if i == 7 else 'n'}" for i in range(3000)] + [None, "9" * 30 + ",A,0.5,+,C,n"]
    df = spark.createDataFrame([(i % 2900, x, "clash", i) for i, x in enumerate(lines)], "line_id bigint, raw_line string, reason string, n int")
    got = parse_records(df).collect()
    assert len(got) == len(lines)
    want = sorted((i % 2900, diagnose(x)[0] or "") for i, x in enumerate(lines))
    assert sorted((r["line_id"], r["reason"] or "") for r in got) == want
    assert parse_records(df.limit(0)).count() == 0


def test_valid_rows_come_from_columns(monkeypatch):
    rng = Random(3)
    good = [x for x, r in CASES.items() if r is None and x.count(" ") < 3]
    bad = [x for x, r in CASES.items() if r is not None]
    lines = [rng.choice(bad) if rng.random() < 0.05 else rng.choice([f"{i + 1},a,0.25,-,T,n{i}", rng.choice(good)]) for i in range(9000)]
    seen = []
    monkeypatch.setattr(badrows, "diagnose", lambda x: seen.append(x) or diagnose(x))
    for leaf in (1024, 16):
        monkeypatch.setattr(badrows, "LEAF", leaf)
        seen.clear()
        _, reasons = parse_block(pa.array(lines))
        valid = reasons.null_count
        assert valid > 8000 and sum(diagnose(x)[0] is None for x in seen) < 0.1 * valid
        assert reasons.to_pylist() == [diagnose(x)[0] for x in lines]
