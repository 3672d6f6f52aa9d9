"""Registered training-data queries against their SQL, and the stages of the pipeline."""

import os

import pytest

pytest.importorskip("strandweave.llm")
duckdb = pytest.importorskip("duckdb")
from strandweave.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(([dict(zip(names, r, strict=True))[c] for c in cols] for r in cur.fetchall()), key=repr)
    assert sorted(([r[c] for c in cols] for r in df.collect()), key=repr) == want


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from strandweave.llm import language
    from strandweave.llm.common import land

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, None, None, None, None), (9000, "", None, "src0", 0)], docs.schema))
    names = docs.columns
    got = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, land(stage(spark, docs, SF), name)
        got[name] = before, docs
    before, after = got["language_id"]
    rejected = language.identify(before, language.fit(before, language.training_rows())).where("rejected").count()
    assert after.count() == before.count() - rejected and after.columns == names
    before, after = got["near_dedup"]
    sets = {}
    for r in before.collect():
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    kept = [r["doc_id"] for r in after.collect()]
    assert len(kept) == len(set(kept))
    for d in set(sets) - set(kept):
        assert any(len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e in sets if e != d)
    for i, d in enumerate(kept):
        assert not any(100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e]) for e in kept[:i])
    before, after = got["passage_dedup"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    seen = set()
    for r in sorted(after.collect(), key=lambda r: r["doc_id"]):
        b, mine = old[r["doc_id"]].encode(), set()
        n, gone = pipeline.PASSAGE_BYTES, bytearray(len(b))
        for i in range(len(b) - n + 1):
            s = b[i:i + n]
            if s in seen or s in mine:
                gone[i:i + n] = b"\x01" * n
            mine.add(s)
        seen |= mine
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert rest.decode("utf-8", "ignore") == r["text"] or not any(g for g in gone)
    before, after = got["mixing"]
    assert after.columns == names and {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    before, after = got["packing"]
    assert after.where("start = 0").count() == before.count()


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    """A near copy whose five-word shingles agree to between 0.80 and 0.85, and one just below 0.8."""
    pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(104)]
    rows = [(1, base), (2, [*base[:52], "other", *base[53:70], "more", *base[71:]]), (3, [*base[:30], "x", *base[31:60], "y", *base[61:80], "z", *base[81:]])]
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert 0.8 <= share[1, 2] < 0.85 and max(share[1, 3], share[2, 3]) < 0.8
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [1, 3]


CLASHING = ["lang_pred", "score", "rejected", "copy", "rate", "u", "shuffle_key", "kept", "dk", "th", "spans", "__gone", "__number"]


def test_stages_keep_columns_of_any_name(spark):
    """And empty tables, null ids and texts, and rows that share a doc_id but not, or nearly, the text."""
    from pyspark.sql import functions as F

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHING})
    for table in (wide, wide.limit(0)):
        now = table
        for name, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == wide.columns, name
        rows = now.collect()
        assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHING) and bool(rows) == (table is wide)
        assert pipeline.STAGES[-1][1](spark, now, SF).count() >= len(rows)


def test_near_duplicates_that_share_a_doc_id(spark):
    """A group never loses all its rows, and of two nearly equal texts of one doc_id one stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda seed: " ".join(f"w{seed}x{i}" for i in range(120))
    near = lambda seed: text(seed) + " end"
    rows = [(3, text(1)), (7, text(2)), (7, near(1)), (9, near(2)), (11, text(3)), (11, near(3)), (12, text(4)), (12, text(4)), (None, text(4)), (None, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    kept = lambda *options: sum(got.count(o) for o in options)
    assert kept((3, text(1)), (7, near(1))) == 1 and (3, text(1)) in got
    assert kept((7, text(2)), (9, near(2))) == 1 and (7, text(2)) in got
    assert kept((11, text(3)), (11, near(3))) == 1 and kept((12, text(4))) == 1 and kept((None, text(4))) == 2 and len(got) == 6


def test_stages_leave_no_tables_that_nothing_reads(spark, tmp_path, monkeypatch):
    """Scratch tables of the model and of the judgement of near-duplicates are gone when the stage is, also if it fails; what is read is there."""
    from pyspark.sql import functions as F

    from strandweave import session

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = []
    monkeypatch.setattr(session, "scratch_dir", lambda _, label: labels.append(label) or f"{tmp_path}/{len(labels)}-{label}")
    left = lambda: [p.name.split("-", 1)[1] for p in tmp_path.iterdir()]
    known = pipeline.keep_known_languages(spark, docs, SF)
    assert "language-texts" in labels and left() == []
    kept = pipeline.drop_near_duplicates(spark, known, SF)
    assert {"signatures", "classes", "edges"} <= set(labels) and left() == ["near-duplicates"]
    assert 0 < kept.count() < docs.count()
    with pytest.raises(Exception, match="no such text"):
        pipeline.drop_near_duplicates(spark, docs.withColumn("text", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("no such text")))), SF)
    assert left() == ["near-duplicates"]


def test_passages_shuffle_texts_once(spark):
    """With columns that travel along, too: the second join reads the shuffle of the first."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.drop_repeated_passages(spark, docs, SF)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("ReusedExchange" in line and "text#" in line for line in plan.splitlines()), plan
