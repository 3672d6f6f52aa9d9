"""Small cases behind the findings of round 4."""

import datetime

import pytest

from strandweave.operators import intervals as iv

LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
         "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


def e7(spark, path, rows):
    """The query over lines of (supplier, start in days since 1990, quantity)."""
    import __spark_entry__ as entry

    day = lambda n: datetime.datetime(1990, 1, 1) + datetime.timedelta(days=n)
    lines = [(i, 1, k, 1, float(n), 1.0, 0.0, 0.0, "N", "O", day(at)) for i, (k, at, n) in enumerate(rows)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    return sorted((tuple(r) for r in entry.queries()["e7_interval_merge"](spark, str(path)).collect()), key=repr)


def test_e7_merges_lines_of_a_missing_supplier_across_buckets(spark, tmp_path):
    spans = [(4080, 30), (4090, 30), (4100, 30), (4200, 30), (9000, 30)]  # 4096 opens a bucket
    got = e7(spark, tmp_path, [(k, s, n) for k in (None, 1) for s, n in spans])
    want = [(4080, 4130, 3), (4200, 4230, 1), (9000, 9030, 1)]
    assert got == sorted([(k, *w) for k in (None, 1) for w in want], key=repr)


def test_e7_equal_lines_are_one_segment(spark, tmp_path):
    # Every line 60 times: the order of equal rows is open, the segments are not.
    got = e7(spark, tmp_path, [(1, s, n) for s, n in [(10, 5), (20, 1), (40, 9), (45, 1)] for _ in range(60)])
    assert got == [(1, 10, 15, 60), (1, 20, 21, 60), (1, 40, 49, 120)]


@pytest.mark.parametrize("keys", [["a", "b"], ["a"], []])
def test_merge_with_missing_keys_and_starts(spark, keys):
    spans = [(1, 5), (6, 30), (12, 13), (32, 40), (33, 33), (None, 500)]
    rows = [(a, b, s, e) for a in (None, "x") for b in (None, 2) for s, e in spans]
    df = spark.createDataFrame(rows, "a string, b long, start int, end int")
    n = len(rows) // len(spans) // len({tuple(r[: len(keys)]) for r in rows})
    out = iv.merge_intervals(df, keys, bucket_width=8)
    assert out.columns == [*keys, "seg_start", "seg_end", "n_intervals"]
    want = [(*k, *w) for k in {tuple(r[: len(keys)]) for r in rows} for w in [(1, 30, 3 * n), (32, 40, 2 * n), (None, 500, n)]]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
