"""Reads laid out by pair, characters counted inside tasks, points counted without pairs, offsets of qualities."""

import math
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandweave.operators import intervals as iv
from strandweave.operators import qc, scan
from strandweave.operators.references import entropy
from strandweave.operators.tally import character_counts, cycle_totals
from strandweave.sources import fastq, layout

READS = "read_id string, pair_id string, mate string, read_index long, seq string, qual string"


@pytest.fixture(scope="module")
def reads(spark):
    rows = [(f"p{i}/{m[1]}", f"p{i}", m, i, "ACGT" * (1 + i % 5), "I" * 4 * (1 + i % 5)) for i in range(300) for m in ("R1", "R2") if (i, m) != (7, "R2")]
    rows += [("p3/2b", "p3", "R2", 9000, "AC", "II"), (None, None, "R1", 9001, "AC", "II")]
    return spark.createDataFrame(rows, READS)


@pytest.fixture(scope="module")
def laid_out(spark, reads, tmp_path_factory):
    return layout.save_by_pair(reads, f"reads_{uuid.uuid4().hex}", 8, str(tmp_path_factory.mktemp("by-pair") / "reads"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partners_from_reads_by_pair_move_no_read(spark, reads, laid_out):
    picked = reads.filter(F.col("pair_id").isin("p1", "p3", "p7", "p250") & (F.col("mate") == "R1") | (F.col("read_id") == "p9/2"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = layout.partners_by_pair(laid_out, picked)
        plan = plan_of(got)
        assert plan.count("Exchange") == 1, plan  # that of the candidates' keys
        assert "Bucketed: true" in plan or "Bucketed: true" in got._jdf.queryExecution().toString()
        usual = scan.partners(reads, picked)
        assert plan_of(usual).count("Exchange") >= 2
        key = lambda df: sorted(map(tuple, df.select("read_id", "pair_id", "mate", "read_index").collect()))
        assert key(got) == key(usual) == [("p1/2", "p1", "R2", 1), ("p250/2", "p250", "R2", 250), ("p3/2", "p3", "R2", 3), ("p9/1", "p9", "R1", 9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_layout_keeps_every_read(reads, laid_out):
    assert sorted(map(str, laid_out.select(reads.columns).collect())) == sorted(map(str, reads.collect()))


def test_partners_of_no_candidate(reads, laid_out):
    assert layout.partners_by_pair(laid_out, reads.limit(0)).count() == 0


def test_cycle_totals_against_plain_counting(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["R1", "R2", None]), rng.choice([None, "", "é~", "".join(chr(rng.randint(33, 74)) for _ in range(rng.randint(1, 60)))])) for _ in range(400)]
    rows.append(("R1", "#" * 50_000))
    want = {}
    for mate, text in rows:
        for i, c in enumerate(text or "", 1):
            n, s = want.get((mate, i), (0, 0))
            want[mate, i] = n + 1, s + ord(c)
    df = spark.createDataFrame(rows, "mate string, qual string").repartition(3)
    got = {(r["mate"], r["cycle"]): (r["reads"], r["code_sum"]) for r in cycle_totals(df, "mate", "qual").collect()}
    assert got == want
    mean = {(r["mate"], r["cycle"]): r["mean_q"] for r in qc.cycle_quality(df).collect()}
    assert all(math.isclose(mean[k], s / n - 33) for k, (n, s) in want.items())


def test_no_row_per_base_leaves_a_task(spark):
    df = spark.createDataFrame([("R1", "I" * 100)] * 50, "mate string, qual string").coalesce(1)
    assert "Generate" not in plan_of(qc.cycle_quality(df))
    assert "Generate" not in plan_of(entropy(df, ["mate"], "qual"))


def test_character_counts_and_entropy(spark):
    rows = [("a", 1, "ACGTN"), ("a", 1, "AAé\U0001f9ec"), ("b", None, None), ("c", 2, ""), ("d", 2, "GGGG")]
    want = Counter((k, j, c) for k, j, text in rows for c in text or "")
    df = spark.createDataFrame(rows, "k string, j int, text string")
    got = {(r["k"], r["j"], r["character"]): r["n"] for r in character_counts(df, ["k", "j"], "text").collect()}
    assert got == dict(want)
    bits = {r["k"]: r["entropy_bits"] for r in entropy(df, ["k"], "text").collect()}
    counts = Counter(c for k, _, text in rows if k == "a" for c in text)
    total = sum(counts.values())
    assert math.isclose(bits["a"], -sum(n / total * math.log2(n / total) for n in counts.values())) and bits["d"] == 0 and set(bits) == {"a", "d"}


def test_histograms_of_several_columns_scan_once(spark):
    df = spark.createDataFrame([("R1", 1.0, 0.26), ("R1", 1.9, 0.24), ("R2", -0.1, None)], "mate string, a double, b double")
    out = qc.histograms(df, ["mate"], {"a": 1.0, "b": 0.25})
    assert plan_of(out).count("Scan ") == 1
    got = {(r["mate"], r["metric"], r["bin_start"]): r["n"] for r in out.collect()}
    assert got == {("R1", "a", 1.0): 2, ("R2", "a", -1.0): 1, ("R1", "b", 0.25): 1, ("R1", "b", 0.0): 1, ("R2", "b", None): 1}


def test_covering_counts_against_pairs(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), s := rng.randint(-20, 9000), s + rng.randint(-2, 5000)) for _ in range(300)] + [("a", None, 4), (None, 1, 5), ("hot", 1, 10)] + [("hot", 3, 9)] * 500
    points = [(rng.choice("abc"), rng.randint(-30, 15_000)) for _ in range(200)] + [("hot", 3), ("hot", 3), ("hot", 10), ("a", None), (None, 2)]
    want = {(k, p): sum(k == i and s is not None and s <= p <= e for i, s, e in spans) for k, p in points if k is not None and p is not None}
    out = iv.covering_counts(spark.createDataFrame(points, "key string, p long"), spark.createDataFrame(spans, "key string, start long, end long"), "p", keys=["key"])
    got = [(r["key"], r["p"], r["n"]) for r in out.collect()]
    assert len(got) == len(want) and {(k, p): n for k, p, n in got} == want
    bare = iv.covering_counts(spark.createDataFrame([(5,)], "p long"), spark.createDataFrame([(1, 5), (6, 9)], "start long, end long"), "p")
    assert [tuple(r) for r in bare.collect()] == [(5, 1)]


def test_quality_below_the_offset_stops_the_scan(spark, tmp_path):
    target = scan.Target(40, "MKTAYIAKQR", 5, 36)
    seq = "ATGAAAACCGCGTATATTGCGAAACAGCGT"
    rows = [("a/1", "a", "R1", 1, seq, "I" * 30), ("b/1", "b", "R1", 2, seq, "I" * 29 + "\x1f")]
    df = spark.createDataFrame(rows, READS)

    def keep(frame, label):
        frame.write.mode("overwrite").parquet(str(tmp_path / label))
        return spark.read.parquet(str(tmp_path / label))

    assert scan.positional_scan(df.filter("pair_id = 'a'"), [target], materialise=keep)["evidence"].count() >= 1
    with pytest.raises(ValueError, match="31"):
        scan.positional_scan(df, [target], materialise=keep)
    with pytest.raises(Exception, match="below Phred\\+64 in read a/1"):
        scan.validate_anchors(spark.createDataFrame([("a/1", "a", "R1", 1, seq, "+" * 30)], READS), [target], qual_offset=64).collect()


def test_laid_out_scan_equals_the_usual_one(spark, tmp_path):
    target = scan.Target(40, "MKTAYIAKQR", 5, 36)
    seq = "ATGAAAACCGCGTATATTGCGAAACAGCGT"
    rows = [(f"{p}/{m}", p, f"R{m}", i, seq if (m == 1) == (i % 2 == 0) else seq[:12] + "GGG" + seq[15:], "I" * 30) for i, p in enumerate("abcd") for m in (1, 2)]
    df = spark.createDataFrame(rows, READS)
    table = layout.save_by_pair(df, f"reads_{uuid.uuid4().hex}", 3, str(tmp_path / "t"))
    got, want = (sorted(map(str, scan.positional_scan(x, [target], laid_out=y)["evidence"].collect())) for x, y in ((table, True), (df, False)))
    assert got == want and got


def test_case_of_fastq(spark, tmp_path):
    (tmp_path / "a_R1.fastq").write_text("@x 1\nacgTn\n+\nIIIII\n")
    path = str(tmp_path / "a_R1.fastq")
    assert [r["seq"] for r in fastq.read_fastq(spark, path, "R1").collect()] == ["ACGTN"]
    assert [r["seq"] for r in fastq.read_fastq(spark, path, "R1", fold_case=False).collect()] == ["acgTn"]
