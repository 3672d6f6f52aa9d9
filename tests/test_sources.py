import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.operators import qc
from strandweave.operators.scan import Target
from strandweave.session import scratch_dir
from strandweave.sources import fastq, tables
from strandweave.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    recs = []
    for i in range(60):
        n = rng.randint(1, 40)
        # Quality lines that begin with @ and + are what makes splitting hard.
        q = rng.choice("@+I") + "".join(rng.choice("@+I#5") for _ in range(n - 1))
        recs.append((f"run.{i + 1}", "".join(rng.choice("ACGTN") for _ in range(n)), q))
    text = "".join(f"@{r} {k} length={len(s)}\n{s}\n+{r}\n{q}\n" for k, (r, s, q) in enumerate(recs, 1))
    (tmp_path / "plain").mkdir()
    (tmp_path / "gz").mkdir()
    (tmp_path / "plain" / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "gz" / "a.fastq.gz", "wt") as f:
        f.write(text)
    return tmp_path, recs


@pytest.mark.parametrize("split", [41, 300, 10**9])
def test_every_record_is_read_once_whatever_the_split(spark, folder, split):
    base, recs = folder
    df = fastq.with_read_index(fastq.read_fastq(spark, str(base / "plain"), "R1", split), bucket_bytes=500)
    got = sorted((r.read_index, r.read_id, r.seq, r.qual) for r in df.collect())
    assert got == [(i, *r) for i, r in enumerate(recs, 1)]


def test_gzip_and_offset_detection(spark, folder):
    base, recs = folder
    df = fastq.read_fastq(spark, str(base / "gz" / "*.gz"), "R2")
    assert df.rdd.getNumPartitions() == 1 and sorted(r.read_id for r in df.collect()) == sorted(r[0] for r in recs)
    assert qc.detect_phred_offset(df) == 33
    assert qc.detect_phred_offset(spark.createDataFrame([("hhTT",)], "qual string")) == 33  # 33 gives no negative score


def test_malformed_record_fails(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="malformed"):
        fastq.read_fastq(spark, str(tmp_path / "x.fastq"), "R1").collect()


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("g1 | one", "MKLEDWHRTY"), ("g2", "MK")], "header string, seq string")
    tables.write_fasta(df, str(tmp_path / "fa"), width=4)
    got = tables.read_fasta(spark, str(tmp_path / "fa"))
    assert sorted((r.name, r.header, r.seq) for r in got.collect()) == [("g1", "g1 | one", "MKLEDWHRTY"), ("g2", "g2", "MK")]
    (tmp_path / "empty.fa").write_text("")
    with pytest.raises(ValueError):
        tables.require_records(tables.read_fasta(spark, str(tmp_path / "empty.fa")))


def test_residue_t_stays_text_and_empty_hits_give_no_rows(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "chunk_000001.csv").write_text('aa,n\n"T",1\nNA,2\n')
    (tmp_path / "c" / "chunk_000012.csv").write_text("aa,n\nF,3\n")
    schema = T.StructType([T.StructField("aa", T.StringType()), T.StructField("n", T.IntegerType())])
    got = sorted(((r.chunk_id, r.aa, r.n) for r in tables.read_chunks(spark, str(tmp_path / "c"), schema).collect()), key=str)
    assert got == [(1, "T", 1), (1, None, 2), (12, "F", 3)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "G1_R1.tsv").write_text("G1\tr1\t90.5\t10\t1\t0\t1\t10\t30\t1\t1e-20\t55.5\n")
    (tmp_path / "h" / "G1_R2.tsv").write_text("")
    rows = tables.read_hits(spark, str(tmp_path / "h")).collect()
    assert [(r.gene, r.mate, r.sstart, r.evalue) for r in rows] == [("G1", "R1", 30, 1e-20)]


def test_streaming_resumes_and_refuses_another_configuration(spark, tmp_path):
    t = Target(3, "KEKLE", 3, 1)
    seq = "AAGGAAAAACTAGAA"
    def land(i, mate):
        spark.createDataFrame([(i, f"p{i}/{mate}", f"p{i}", f"R{mate}", seq, "I" * 15)], ingest.READS).write.mode("append").parquet(f"{base}/in")
    base = str(tmp_path)
    cfg = ingest.ScanConfig((t,), 1)
    land(1, 1)
    ingest.ingest(spark, f"{base}/in", f"{base}/out", cfg, complete=False)
    land(2, 1)
    ingest.ingest(spark, f"{base}/in", f"{base}/out", cfg, complete=False)
    ingest.ingest(spark, f"{base}/in", f"{base}/out", cfg, complete=False)
    assert sorted(r.pair_id for r in ingest.collected_evidence(spark, f"{base}/out").collect()) == ["p1", "p2"]
    assert spark.read.parquet(f"{base}/out/primary").groupBy("read_id").count().filter("count > 1").isEmpty()
    with pytest.raises(ingest.ConfigurationChanged):
        ingest.ingest(spark, f"{base}/in", f"{base}/out", ingest.ScanConfig((t,), 0))


def test_replayed_batch_leaves_no_duplicates(spark, tmp_path):
    t = Target(3, "KEKLE", 3, 1)
    batch = spark.createDataFrame([(1, "p/1", "p", "R1", "AAGGAAAAACTAGAA", "I" * 15)], ingest.READS)
    for _ in range(2):
        ingest.scan_batch(batch, 0, str(tmp_path), ingest.ScanConfig((t,), 1))
    assert spark.read.parquet(f"{tmp_path}/primary").count() == 1


def test_scratch_folder_follows_the_session(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    from strandweave.sources import tables

    (tmp_path / "a.fasta").write_text(">g1 A->B change\nacgt\nAC\n>g2\nTT\n")
    got = {r["header"]: r["seq"] for r in tables.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"g1 A->B change": "ACGTAC", "g2": "TT"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    import pytest

    from strandweave.session import scratch_dir

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        scratch_dir(Session, "x")


def test_ingest_does_not_depend_on_batches(spark, tmp_path):
    import pytest

    from strandweave.plans.adapters import reads
    from strandweave.plans.scan_queries import TARGETS
    from strandweave.streaming import ingest

    sf = "/root/testdata/sf0.001"
    own = reads(spark, sf).where("doc_id < 60").select("read_index", "read_id", "pair_id", "mate", "seq", "qual")
    for mate in ("R1", "R2"):
        own.where(f"mate = '{mate}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    for n in (1, 64):
        out = str(tmp_path / f"out{n}")
        ingest.ingest(spark, str(tmp_path / "in"), out, ingest.ScanConfig(tuple(TARGETS)), n, complete=False)
        got.append(sorted(map(repr, ingest.collected_evidence(spark, out).collect())))
    assert got[0] == got[1]
    with pytest.raises(ingest.ConfigurationChanged):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out1"), ingest.ScanConfig(tuple(TARGETS), overhang=False))
    with pytest.raises(ingest.UnpairedReads):
        one = str(tmp_path / "one")
        own.where("mate = 'R1'").write.parquet(one)
        ingest.ingest(spark, one, str(tmp_path / "out2"), ingest.ScanConfig(tuple(TARGETS)))


PAIRED = [(i, f"p{i}/{m}", f"p{i}", f"R{m}", "AAGGAAAAACTAGAA", "I" * 15) for i in (1, 2, 5000, 9000) for m in (1, 2)]


def _landed(spark, base, rows):
    spark.createDataFrame(rows, ingest.READS).repartition(2).write.mode("append").parquet(f"{base}/in x")


def test_pairing_waits_for_mates_in_later_files(spark, tmp_path):
    """Half the mates come in another call; the state holds the others, and the run goes on where it stopped."""
    base, cfg = str(tmp_path), ingest.ScanConfig((Target(3, "KEKLE", 3, 1),), 1)
    _landed(spark, base, PAIRED[0::2])
    ingest.ingest(spark, f"{base}/in x", f"{base}/out", cfg, 1, complete=False)
    with pytest.raises(ingest.UnpairedReads, match="one side ended .*R1 of read index 1, "):
        ingest.ingest(spark, f"{base}/in x", f"{base}/out", cfg)
    _landed(spark, base, PAIRED[1::2])
    ingest.ingest(spark, f"{base}/in x", f"{base}/out", cfg, 1)
    assert ingest.collected_evidence(spark, f"{base}/out").where("evidence_role = 'PRIMARY'").count() == len(PAIRED)


@pytest.mark.parametrize("change,index", [
    (lambda r: (r[0], r[1], "other", *r[3:]), 5000), (lambda r: (*r[:3], "R1", *r[4:]), 5000), (lambda r: (*r[:3], "R9", *r[4:]), 5000), (lambda r: (*r[:3], None, *r[4:]), 5000), (lambda r: (None, *r[1:]), "<NA>"),
])
def test_pairing_stops_on_a_divergent_id(spark, tmp_path, change, index):
    base, cfg = str(tmp_path), ingest.ScanConfig((Target(3, "KEKLE", 3, 1),), 1)
    _landed(spark, base, [*PAIRED[:5], change(PAIRED[5]), *PAIRED[6:]])
    for _ in range(2):  # again after a restart
        with pytest.raises(ingest.UnpairedReads, match=f"read index {index}"):
            ingest.ingest(spark, f"{base}/in x", f"{base}/out", cfg)
    assert not (tmp_path / "out" / "primary").exists()


def test_a_third_read_of_a_pair_stops_the_run(spark, tmp_path):
    base, cfg = str(tmp_path), ingest.ScanConfig((Target(3, "KEKLE", 3, 1),), 1)
    _landed(spark, base, [*PAIRED, PAIRED[0]])
    with pytest.raises(ingest.UnpairedReads, match="read index 1"):
        ingest.ingest(spark, f"{base}/in x", f"{base}/out", cfg)


def test_another_reference_stops_the_run():
    from strandweave.operators.checks import ReferenceMismatch

    t = Target(3, "KEKLE", 3, 1)
    ingest.ScanConfig((t,), reference="KEKLEMM", expected=((6, "M"),))
    with pytest.raises(ReferenceMismatch):
        ingest.ScanConfig((t,), reference="KEKLEMM", expected=((6, "A"),))
    with pytest.raises(ReferenceMismatch):
        ingest.ScanConfig((t,), reference="KEKVEMM")
