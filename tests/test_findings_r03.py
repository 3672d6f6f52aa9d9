"""Small cases behind the findings of round 3."""

from strandweave.operators import audits


def documents(spark, path, rows, schema="doc_id long, text string, lang string, source string, n_chars int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_s3_counts_zero_records_where_no_read_is_a_candidate(spark, tmp_path):
    import __spark_entry__ as entry

    d = documents(spark, tmp_path, [(1, "a few words without any anchor " * 30, "en", "s", 900)])
    assert [tuple(r) for r in entry.queries()["s3_exactly_once_resume"](spark, d).collect()] == [(0, 0)]


def test_control_excess_of_exactly_twenty_points_is_flagged(spark):
    # 15 residues: 2 as in the reference, 5 as in the reversed one; 33.33 - 13.33 is a little under 20 in doubles.
    window, reference = "GCC" * 2 + "AAA" * 3 + "TTT" * 8 + "GCC" * 2, "AAMMMMMMMMKKKKK"
    rows = [("r", "R1", window, reference, 1, 45, 1, 15, 1, 15)]
    df = spark.createDataFrame(rows, "read_id string, mate string, seq string, reference string, sstart int, send int, qstart int, qend int, gap_position_start int, gap_position_end int")
    r = audits.orientation_diagnostic(df, "reference").first()
    assert r["as_is"] == "AAKKKFFFFFFFFAA" and (r["id_as_is"], r["id_as_is_control"]) == (2 / 15 * 100, 5 / 15 * 100)
    assert r["id_as_is_control"] - r["id_as_is"] < 20 and r["control_excess_flag"]


def test_states_of_the_pairing_gate_do_not_grow_with_far_apart_read_indexes(spark, tmp_path, monkeypatch):
    from strandweave.streaming import ingest

    monkeypatch.setattr(ingest, "BUCKETS", 8, raising=False)
    rows = [(i * 10_000_000 + 1, f"r{i}", f"p{i}", m, "A", "I") for i in range(100) for m in ("R1", "R2") if m == "R1" or i % 2]
    spark.createDataFrame(rows, ingest.READS).write.parquet(f"{tmp_path}/landing")
    ingest.check_pairs(spark, f"{tmp_path}/landing", f"{tmp_path}/out", complete=False)
    states = spark.read.format("statestore").load(f"{tmp_path}/out/pairing").selectExpr("size(value.groupState.mate) AS n").collect()
    assert sum(r["n"] for r in states) == 50 and len(states) <= 8


def test_reads_land_in_more_files_as_they_grow(spark, tmp_path, monkeypatch):
    from strandweave.plans import adapters, scan_queries

    d = documents(spark, tmp_path, [(i, "abc" * 3000, "en", "s", 9000) for i in range(8)])
    assert adapters.portions(spark, d, 4) == 4 and adapters.portions(spark, d, 4, 6000) == 12
    monkeypatch.setattr(scan_queries, "portions", lambda s, d, least: 40, raising=False)
    scan_queries._land(spark, d, f"{tmp_path}/base")
    assert len({r[0] for r in spark.read.parquet(f"{tmp_path}/base/landing").selectExpr("input_file_name()").collect()}) > 8


def test_peptides_of_a_batch_equal_codons_one_by_one():
    import random

    import pyarrow as pa

    from strandweave.functions import sequence as sq

    r = random.Random(3)
    seqs = [None, "", "A", "AC", "acg", "ATGNNNtaa", "AÉCGTTT", "𝔸ACGT", *("".join(r.choice("ACGTacgtNé") for _ in range(r.randint(0, 40))) for _ in range(300))]
    pair = dict(zip("ACGTacgt", "TGCAtgca"))

    def plain(s, f):
        return None if s is None else "".join(sq.CODE.get(s[i:i + 3].upper(), "X") for i in range(f - 1, len(s) - 2, 3))

    for chunk in (pa.array(seqs, pa.string()), pa.array(["x", *seqs], pa.large_string()).slice(1)):
        for f in (1, 2, 3):
            assert sq.peptides(chunk, f).to_pylist() == [plain(s, f) for s in seqs]
            assert sq.peptides(chunk, f, True).to_pylist() == [plain(s and "".join(pair.get(c, "N") for c in reversed(s)), f) for s in seqs]
    assert sq.peptides(pa.array([], pa.string()), 1).to_pylist() == []


def test_alignments_by_rows_of_pairs_equal_the_way_back_by_halves(monkeypatch):
    import random

    import numpy as np

    from strandweave.operators import orfs

    r = random.Random(7)
    for letters in ("AC", "ACDE", "ACDEFGHIKLMNPQRSTVWY"):
        a, b = (["".join(r.choice(letters) for _ in range(r.randint(1, 50))) for _ in range(40)] for _ in range(2))
        for kw in ({}, {"traceback": "legacy"}, {"match": 2, "gap": -2}, {"gap": 0, "mismatch": 0}):
            monkeypatch.setattr(orfs, "BATCH_CELLS", 32_000_000)
            whole = orfs.align_batch(a, b, **kw)
            monkeypatch.setattr(orfs, "BATCH_CELLS", 500)
            assert whole == orfs.align_batch(a, b, **kw)
    best, _, _ = orfs._align_whole(np.full((2, 3), 65, np.uint8), np.full((2, 5), 65, np.uint8), 1, -1, -1, "standard")
    assert best.tolist() == [3, 3]


def test_runs_of_depth_stand_for_all_positions(spark):
    import random

    from strandweave.operators import intervals as iv

    r = random.Random(5)
    rows = [(k, a, a + r.randint(-3, 9)) for k in range(4) for a in (r.randint(-5, 45) for _ in range(12))]
    df = spark.createDataFrame(rows, "key int, start long, end long")
    lens = spark.createDataFrame([(0, 40), (1, 33), (2, 7), (3, 32), (4, 5)], "key int, len int")
    for width in (4096, 8):
        runs = iv.depth_runs(df, ["key"], lens, "len", bucket_width=width).collect()
        listed = sorted((x["key"], x["position"] + i, x["depth"]) for x in runs for i in range(x["n"]))
        assert listed == sorted(tuple(x) for x in iv.depth(df, ["key"], lens, "len", bucket_width=width).collect())
        assert len(runs) < len(listed)


def test_family_metrics_read_the_phased_rows_once(spark):
    from strandweave.operators import haplotypes as hp

    rows = [("F1", "G1", "M", "L", 20), ("F1", "G1", "K", "L", 20), ("F1", "G2", "K", "P", 10), ("F2", None, "M", "L", 30), ("F9", "G9", "M", "L", 9)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "family_40 string, family_85 string, aa_40 string, aa_85 string, min_phred_both int")
    got = hp.family_metrics(df.mapInArrow(count, df.schema), (40, 85), {40: ("M",), 85: ("L", "P")}).collect()
    assert {r["metric"]: r["value"] for r in got} == {
        "phased_records": 4, "families_40": 2, "families_40_M": 2, "families_85": 3, "families_85_L": 2, "families_85_P": 1, "family_combinations": 3}
    assert seen.value == len(rows)


def test_hits_are_landed_in_one_pass(spark, tmp_path):
    from strandweave.plans import scan_queries

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a", "R1"), ("b", "R2"), ("c", "R2")], "x string, mate string")
    scan_queries._land_hits(df.mapInArrow(count, df.schema), f"{tmp_path}/hits")
    assert seen.value == 3


def test_characters_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    from strandweave.operators import tally

    monkeypatch.setattr(tally, "HELD_CHARACTERS", 5, raising=False)
    texts = ["ab", None, "", "abc", "aaaaaaaaé", "b", "ccccc", "", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], names=["k", "t"])
    parts = [p.column(1).to_pylist() for p in tally._parts(iter([batch, batch.slice(0, 0)]), 1)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 5 for p in parts)
    got = tally.character_counts(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], "t").collect()
    assert {(r["k"], r["character"], r["n"]) for r in got} == {(k, c, t.count(c)) for k, t in enumerate(texts) for c in t or ""}


def test_counting_pairs_of_phrases_holds_little_memory():
    import tracemalloc

    import numpy as np

    from strandweave.llm import phrases

    r = np.random.default_rng(2)
    tiles, total = phrases.Tiles(), 0
    tracemalloc.start()
    for _ in range(2):
        codes = r.integers(0, 1 << 20, phrases.PAIRS) << 32 | r.integers(0, 1 << 20, phrases.PAIRS)
        tiles.add(codes)
        total += len(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles.counts.sum() == total and peak < 250 << 20
