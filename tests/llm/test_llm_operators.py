"""Operators of the training-data subpackage against plain code, on small tables with all kinds of odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandweave.llm")
from strandweave.llm import covertree, factors, kernels, language, licenses, minhash, mixing, packing, quality, repeats, substrings, suffixes, trees, url_filter  # noqa: E402
from strandweave.llm.components import connected_components  # noqa: E402
from strandweave.llm.queries_models import tokenizer_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, gram string, lang_pred string, copy string, host string"


def corpus(seed=3, n=60):
    """Texts that share passages, near copies, repeated rows, nulls, empties, one long text, texts of one byte or word repeated."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñü") for _ in range(r.randint(1, 7))) for _ in range(80)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = say(40), say(120)
    rows = []
    for i in range(n):
        kind = i % 6
        text = say(r.randint(1, 90)) if kind < 2 else say(20) + " \n" + passage + "\t" + say(20) if kind == 2 else base if kind == 3 else say(30)
        if kind == 4:
            w = base.split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a" * 3000), (104, "the " * 500), (105, say(6000)), (106, passage), (None, passage), (107, rows[3][1]), (107, rows[3][1])]
    return [(d, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], 1, "x", "y", "z", "c", "h") for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected_words(rows, w=13):
    texts = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    first = {}
    least = lambda d: -math.inf if d is None else d
    for d, x in texts:
        for i in range(len(x) - w + 1):
            k = tuple(x[i:i + w])
            first[k] = min(first.get(k, math.inf), least(d))
    out = []
    for d, x in texts:
        gone = set()
        for i in range(len(x) - w + 1):
            if first[tuple(x[i:i + w])] < least(d):
                gone |= set(range(i, i + w))
        kept = " ".join(v for i, v in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def text_hash(b):
    """The hash of a text that orders texts of one doc_id."""
    h = xxhash.xxh64(b, seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def expected_bytes(rows, w, keep_first, least=None):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    key = lambda d, b, i: (-math.inf if d is None else d, text_hash(b), i)

    def covered(w):
        places = {}
        for d, b in texts:
            for i in range(len(b) - w + 1):
                places.setdefault(b[i:i + w], []).append(key(d, b, i))
        for d, b in texts:
            gone = np.zeros(len(b) + 1, bool)
            for i in range(len(b) - w + 1):
                at = places[b[i:i + w]]
                if min(at) < key(d, b, i) if keep_first else len(at) > 1:
                    gone[i:i + w] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])))
            yield d, b, gone, [int(z - a) for a, z in zip(edge[::2], edge[1::2], strict=True)]

    out = []
    for (d, b, gone, runs), (*_, short) in zip(covered(w), covered(least or w), strict=True):
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), max(short, default=0)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_rows", [20_000, 1])
def test_substring_dedup(docs, empty, group_rows):
    assert rows_of(substrings.remove_repeated_words(docs, group_rows=group_rows)) == expected_words(corpus())
    assert rows_of(substrings.remove_repeated_words(empty, group_rows=group_rows)) == []


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("group_rows,least", [(20_000, None), (20_000, 40), (1, None), (1, 40)])
def test_suffix_array_dedup(docs, empty, keep_first, group_rows, least):
    got = suffixes.remove_repeated_bytes(docs, 100, 16, keep_first, group_rows, least=least)
    assert rows_of(got) == expected_bytes(corpus(), 100, keep_first, least)
    assert rows_of(suffixes.remove_repeated_bytes(empty, 100, 16, keep_first, group_rows, least=least)) == []


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("group_rows", [20_000, 40])
def test_one_text_with_a_frequent_gram_and_a_window_in_all_texts(spark, keep_first, group_rows):
    """Places are counted, not rows: one text fills a group. Also periodic texts, and null ids with one passage at one place."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot, passage = word(60), word(90)
    rows = [(1, "".join(hot + word(rng.randint(5, 60)) for _ in range(150))), (None, passage + word(70)), (None, passage + word(50)), (2, "ab" * 150), (2, "ab" * 90), (3, "x" * 200)]
    rows += [(10 + i, word(rng.randint(0, 30)) + hot + word(rng.randint(0, 30))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.remove_repeated_bytes(df, 70, 16, keep_first, group_rows, least=40)
    assert rows_of(got) == expected_bytes(rows, 70, keep_first, 40)


def test_longest_previous_factors():
    """Against all pairs: suffixes of random and of periodic strings."""
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) if rng.random() < 0.7 else "ab" * rng.randint(1, 25)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(len(text)) if text[i + k:i + k + 1] != text[j + k:j + k + 1] or not text[i + k:i + k + 1]), len(text))
        link = np.array([0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)], np.int64)
        for least in (1, 3):
            got = factors.factors(np.array(order), link, least)
            for i, f in zip(order, got.tolist(), strict=True):
                best = max((common(j, i) for j in range(i)), default=0)
                assert f == (best if best >= least else 0)
    values = np.array([rng.randint(0, 50) for _ in range(300)])
    lo = np.array([rng.randint(0, 298) for _ in range(500)])
    hi = np.array([rng.randint(a + 1, 300) for a in lo])
    assert factors.RangeMin(values).of(lo, hi).tolist() == [values[a:z].min() for a, z in zip(lo, hi, strict=True)]


def test_kept_text_and_carried_columns(docs):
    got = suffixes.remove_repeated_bytes(docs, 100, 16, True, with_text=True, carry=("lang", "spans", "gram"))
    assert got.columns == ["doc_id", "lang", "spans", "gram", "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat", "kept_text"]
    for r in got.where("doc_id < 60").collect():
        if r["n_removed"] == 0:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_suffix_runs_are_common_prefixes():
    rng = np.random.default_rng(1)
    m = rng.integers(1, 3, (50, 6)).astype(np.uint16)
    order, lcp = repeats.suffix_order(m)
    for depth in range(1, 7):
        node = repeats.runs_at(order, lcp, depth)
        for i in range(50):
            assert [node[i] == node[j] for j in range(50)] == [(m[i, :depth] == m[j, :depth]).all() for j in range(50)]


def test_suffix_trees():
    """Order, common prefixes and internal nodes against plain comparisons; reach against all pairs."""
    rng = random.Random(12)
    for _ in range(80):
        size = [rng.randint(1, 21) for _ in range(rng.randint(1, 12))]
        words = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(sum(size))], np.uint64)
        rest = np.concatenate([np.arange(n, 0, -1) for n in size])
        row = np.repeat(np.arange(len(size)), size)
        leaves = np.array([i for i in range(len(words)) if rng.random() < 0.7], np.int64)
        order, lcp = trees.suffix_array(words, rest, leaves)
        text = [tuple(words[i:i + rest[i]].tolist()) for i in range(len(words))]
        shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert sorted(order.tolist()) == leaves.tolist()
        assert [text[i] for i in order] == sorted(text[i] for i in leaves)
        assert lcp.tolist() == [0] * bool(len(order)) + [shared(text[a], text[b]) for a, b in zip(order, order[1:], strict=False)]
        for least in (1, 3):
            groups = {}
            for a, b in ((a, b) for a in range(len(order)) for b in range(a + 1, len(order))):
                d = shared(text[order[a]], text[order[b]])
                if d >= least:
                    groups.setdefault((d, text[order[a]][:d]), set()).update((a, b))
            want = sorted((d, min(g), max(g) + 1) for (d, _), g in groups.items())
            assert sorted(zip(*(v.tolist() for v in trees.internal_nodes(lcp, least)), strict=True)) == want
            owner = row[order] % 4
            best = [max((shared(text[j], text[i]) for j, o in zip(order, owner, strict=True) if o < own), default=0) for i, own in zip(order, owner, strict=True)]
            assert trees.repeated_depth(lcp, owner, least).tolist() == [b if b >= least else 0 for b in best]


@pytest.mark.parametrize("group_rows", [2, 6, 25, 20_000])
@pytest.mark.parametrize("prefixes", [(5, 7, 9, 11), (3,), (4, 13)])
def test_frequent_grams_take_longer_prefixes(spark, monkeypatch, group_rows, prefixes):
    """Passages that share 5, 8 or 12 words, a passage in all texts, one text full of a gram, periodic texts, white space."""
    monkeypatch.setattr(trees, "LISTED_GRAMS", 0 if group_rows == 6 else 100_000)
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    common = words(40)
    rows = []
    for i in range(60):
        n = rng.choice([5, 8, 12, 13, 14, 40])
        at = rng.randint(0, 40 - n)
        rows.append((i // 2 if i < 10 else i, rng.choice([" ", "  ", "\n"]).join(words(rng.randint(0, 9)) + common[at:at + n] + words(rng.randint(0, 9)))))
    rows += [(90, " ".join(sum((common[:5] + words(rng.randint(1, 12)) for _ in range(40)), []))), (91, "a b " * 20), (92, "a b " * 30), (93, "a " * 50), (None, "a b " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(substrings.remove_repeated_words(df, prefixes=prefixes, group_rows=group_rows)) == expected_words(rows)


def test_copies_make_no_rows_of_frequent_grams(spark):
    """A context of many documents is one row of a chunk, joined once; each of its documents gets its own intervals."""
    rng = random.Random(8)
    passage = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    rows = [(i, " ".join([f"a{i}", *passage[i % 3:], f"z{i}"])) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(range(300))), pa.array([0] * 300), pa.array([t for _, t in rows])], names=["dk", "th", "text"])
    grams = np.unique(np.concatenate([found for *_, found, _, _ in trees.anchored(batch.column(2), 13, 5)])).view(np.int64)
    got = list(trees.members_of_documents(13, 5, trees.Few(grams))(iter([batch])))
    contexts = {k for b in got for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert sum(b.num_rows for b in got) == len(contexts)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substrings.remove_repeated_words(df, group_rows=2)) == expected_words(rows)


def sets_of(rows):
    out = {}
    for d, t, *_ in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = WORD.findall(low)
        out[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


@pytest.mark.parametrize("small_bucket,block", [(64, 1000), (0, 3)])
def test_near_duplicates(docs, empty, small_bucket, block):
    sets = sets_of(r for r in corpus() if r[0] is not None)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    want = sorted(((d, len(sets[d]), find(d), find(d) == d) if d is not None else (None, len(sets_of([(0, t)])[0]), None, True) for d, t, *_ in corpus()), key=repr)
    assert rows_of(minhash.near_duplicates(docs, small_bucket=small_bucket, block=block)) == want
    assert rows_of(minhash.near_duplicates(empty)) == []


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, (2000, minhash.HASHES // 16), dtype=np.uint64)
    assert abs(minhash.estimate(a, rng.permutation(a)).mean()) < 0.01
    assert (minhash.estimate(a, a) == 1.0).all()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (7, 7), (5, 4), (20, 9)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8), (20, 8)}


def vectors():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(v)) for v in centre[i % 6] + 0.25 * rng.normal(size=8)], int(i % 3)) for i in range(150)]
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(5)] + [rows[1], rows[1]]
    return rows + [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [math.nan] + [1.0] * 7, 1), (304, [math.inf] * 8, 1), (305, rows[0][1], None),
                   (306, [], 0), (307, rows[0][1][:4], 0), (None, rows[0][1], 0)]


@pytest.mark.parametrize("cell_rows", [8192, 10])
def test_link_vectors(spark, cell_rows):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    ok = {}
    for v, e, lab in rows:
        if v is not None and e and lab is not None and all(c is not None and math.isfinite(c) for c in e) and any(e):
            ok[v] = (np.array(e, np.float32).astype(float), lab)
    near = {v: {u for u in ok if u != v and ok[u][1] == ok[v][1] and len(ok[u][0]) == len(ok[v][0])
                and ok[u][0] @ ok[v][0] / math.sqrt((ok[u][0] @ ok[u][0]) * (ok[v][0] @ ok[v][0])) >= 0.93} for v in ok}

    def least(v):
        seen, todo = {v}, [v]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    want = sorted(((v, len(near[v]), least(v), least(v) == v) if v in ok else (v, 0, v, True) for v, *_ in rows), key=repr)
    assert any(r[1] > 3 for r in want)
    assert rows_of(covertree.link_vectors(df, 0.93, cell_rows)) == want
    assert rows_of(covertree.link_vectors(df.limit(0))) == []


def test_link_vectors_of_doubles(spark):
    """Cosines nearer to the threshold than single precision can tell."""
    rows = []
    for k in range(-10, 11):
        c = 0.93 + (2 * k + 1) * 1e-9
        rows += [(100 + 2 * k, [1.0, 0.0], 50 + k), (101 + 2 * k, [c, float(np.sqrt(1 - c * c))], 50 + k)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in covertree.link_vectors(df, 0.93).collect()}
    assert got == {v: int(label >= 50) for v, _, label in rows}


def test_language_sample_counts_copies_once(spark):
    rows = [("en", f"text number {i}") for i in range(40)] + [("en", "one and the same text")] * 4000
    got = language.labelled_sample(spark.createDataFrame(rows, "lang string, text string"), 20).collect()
    assert len({r["text"] for r in got}) == len(got) <= 20


def test_language_sample_of_copies_and_of_many_languages(spark):
    """Groups of copies leave the sample whole; every language has a text in it; many languages do not burst the bound."""
    rows = spark.range(300_000).select(F.concat(F.lit("l"), (F.col("id") % 4).cast("string")).alias("lang"), F.concat(F.lit("text "), (F.col("id") % 20).cast("string")).alias("text"))
    rows = rows.unionByName(spark.range(300).select(F.lit("l9").alias("lang"), F.concat(F.lit("own "), F.col("id").cast("string")).alias("text")))
    got = Counter(r["lang"] for r in language.labelled_sample(rows, 100).collect())
    assert got == {"l0": 5, "l1": 5, "l2": 5, "l3": 5, "l9": 20}
    many = spark.range(3000).select(F.concat(F.lit("l"), (F.col("id") % 60).cast("string")).alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert set(Counter(r["lang"] for r in language.labelled_sample(many, 120).collect()).values()) == {2}
    assert Counter(r["lang"] for r in language.labelled_sample(many, 20).collect()) == {f"l{i}": 1 for i in range(60)}


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(0).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x)
    for i, kids in enumerate(tree.children):
        assert covertree.distance(x[tree.members[i]], x[tree.centre[i]:tree.centre[i] + 1]).max() <= tree.radius[i] + 1e-12
        if len(kids):
            assert sorted(np.concatenate([tree.members[k] for k in kids])) == sorted(tree.members[i])
            assert max(tree.radius[k] for k in kids) <= tree.radius[i] / 2 + 1e-9
            d = covertree.distance(x[tree.centre[kids]], x[tree.centre[kids]])
            assert (d[~np.eye(len(kids), dtype=bool)] > tree.radius[i] / 2 - 1e-9).all()


def test_url_filter(spark):
    urls = ["http://a.Example.org/es/x", "https://example.org/en/12?q=/es/", "http://org/", "http://org", "ftp://x.com/fr/", "x.com/fr/", None, "", "://", "http://badexample.org/es/",
            "http://Q.net/a/#f", "http://www.q.net:80/a", "http://q.net/b", "http://x.com/de/" + "y" * 5000, "http://é.org/", "http://a.Example.org/es/x"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    rules = spark.createDataFrame([("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")], "rule string, verdict string")
    listed = spark.createDataFrame([("= q.net/a",), (None,), ("= q.net/a",)], "key string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules, listed).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        ("org/", "allow"), (None, "block"), (None, "block"), (None, "allow"), ("com/de/", "block"), ("org/", "allow"), ("example.org/es/", "block")]
    assert got[6]["host"] == got[6]["path"] == "" and got[0]["host"] == "a.example.org"
    one_block = url_filter.filter_urls(pages, rules, listed, max_blocks=1)  # all hits are false but for the exact join
    assert rows_of(one_block) == rows_of(url_filter.filter_urls(pages, rules, listed))
    assert url_filter.filter_urls(pages, rules.limit(0), listed.limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules, listed).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    f, blocks = url_filter.bloom(keys)
    assert url_filter.possible(keys, f, blocks).count() == 3000
    others = spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("key"))
    assert url_filter.possible(others, f, blocks).count() < 300


def test_quality_features(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(docs).collect()}
    for d, t, *_ in corpus():
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
        r = got[d, len(w)]
        assert r["word_chars"] == sum(map(len, w)) and r["n_repeat_words"] == len(cover)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert rows_of(quality.judge(empty)) == []


def test_estimation_finds_bad_rules(spark):
    r = random.Random(1)
    rows = []
    for _ in range(4000):
        good = r.random() < 0.7
        rows.append(tuple(int(good == (r.random() < a)) if r.random() < 0.9 else None for a in (0.95, 0.9, 0.85, 0.55)))
    df = spark.createDataFrame(rows, "vote_a int, vote_b int, vote_c int, vote_d int")
    prior, accuracy = quality.estimate(df, "abcd", 40)
    assert abs(prior - 0.7) < 0.04
    assert all(abs(accuracy[n] - a) < 0.05 for n, a in zip("abcd", (0.95, 0.9, 0.85, 0.55), strict=True))


def test_mixing(spark, docs, empty):
    rates = spark.createDataFrame([("a", 3.0), (None, 0.5), ("b", 0.0)], "source string, rate double")
    got = mixing.mix(docs, rates, partitions=4)
    by = Counter((r["doc_id"], r["text"]) for r in got.collect())
    times = Counter((d, t) for d, t, *_ in corpus())
    for d, t, _, source, *_ in corpus():
        u = int(hashlib.md5(f"mix-1|{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        rate = {"a": 3.0, "b": 0.0, None: 0.5}[source]
        n, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            n, p = n + 1, p * rate / (n + 1)
            c += p
        if times[d, t] == 1:
            assert by[d, t] == (n if rate else 0)
    keys = [r["shuffle_key"] for r in got.collect()]
    assert keys == sorted(keys)
    assert mixing.mix(empty, rates).count() == 0
    big = mixing.thresholds(spark.createDataFrame([("a", 900.0)], "source string, rate double")).first()["cdf"]
    assert abs(big[-1] - 1) < 1e-9 and 0.4 < big[900] < 0.6


def test_language(docs, empty, spark):
    model = language.fit(docs, language.training_rows(), sample=50)
    got = {(r["doc_id"], r["copy"]): r for r in language.identify(docs, model, tuple(docs.columns)).collect()}
    assert set(docs.columns) <= set(next(iter(got.values())).asDict())
    assert all(got[d, "c"]["lang_pred"] == "und" and got[d, "c"]["rejected"] for d in (100, 101, 102))
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in got.values())
    nothing = language.fit(empty, language.training_rows())
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    odd = spark.createDataFrame([(1, "漢字かな交じり文" * 30), (2, "1234 !!"), (3, "Ж")], "doc_id long, text string")
    assert [r["rejected"] for r in language.identify(odd, model).orderBy("doc_id").collect()] == [True, True, False]


def plain_trigrams(text):
    """Counts of bins of the trigrams of a text, a byte at a time."""
    raw, out, before = (text or "").encode(), [], 0
    for b in raw:
        low = b + 32 if 65 <= b <= 90 or (before == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97) else b
        out.append(low if low >= 128 or 97 <= low <= 122 else 32)
        before = b
    grams = [out[i:i + 3] for i in range(len(out) - 2)]
    return Counter(((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 20 for a, b, c in grams if (a, b) != (32, 32) and (b, c) != (32, 32))


def plain_vector(text, idf):
    x = np.zeros(language.BINS)
    for b, n in plain_trigrams(text).items():
        x[b] = math.log(1 + n) * idf[b]
    return x / max(math.sqrt((x * x).sum()), 1e-12)


def plain_centroids(rows, k=4, rounds=200):
    """Clusters of unit vectors by cosine: begun with the row nearest the mean, then always the row farthest from all begun."""
    mean = sum(rows) / len(rows)
    first = [max(range(len(rows)), key=lambda i: (rows[i] @ mean, -i))]
    while len(first) < min(k, len(rows)):
        first.append(min(range(len(rows)), key=lambda i: (max(rows[i] @ rows[j] for j in first), i)))
    centres = [rows[i] for i in first]
    for _ in range(rounds):
        members = [[] for _ in centres]
        for x in rows:
            members[max(range(len(centres)), key=lambda c: (x @ centres[c], -c))].append(x)
        new = [sum(m) / max(np.linalg.norm(sum(m)), 1e-12) if m else c for m, c in zip(members, centres, strict=True)]
        if all(np.abs(a - b).max() < 1e-6 for a, b in zip(new, centres, strict=True)):
            break
        centres = new
    return centres


def test_language_against_plain_code(spark):
    """Trigrams, weights, centroids, nearest language and score of all documents, computed one text at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "7 !"), (-4, "\u00c9COLE \u00d7 \u00e9cole"), (-5, "Z")], "doc_id long, text string"), allowMissingColumns=True)
    model = language.fit(docs, language.training_rows(), sample=1000)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    labelled = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    seen = Counter(b for r in labelled for b in plain_trigrams(r["text"]))
    idf = np.array([math.log((1 + len(labelled)) / (1 + seen[b])) + 0.1 for b in range(language.BINS)])
    assert np.allclose(model.idf, idf)
    known = spark.createDataFrame([(r["lang"], r["text"]) for r in labelled], "lang string, text string")
    chosen = sorted(language.labelled_sample(known, 1000).select("lang", "k", "text").collect(), key=lambda r: r["k"])
    assert {(r["lang"], r["text"]) for r in chosen} <= {(r["lang"], r["text"]) for r in labelled}
    centroids = []
    for lang in sorted({r["lang"] for r in chosen}):
        own = [np.float16(plain_vector(r["text"], idf)).astype(float) for r in chosen if r["lang"] == lang]  # the sample has half precision
        centroids += [(lang, c) for c in plain_centroids([x for x in own if np.linalg.norm(x) > 0.5])]
    assert [x for x, _ in centroids] == model.langs
    assert np.abs(np.stack([c for _, c in centroids]) - model.centroids).max() < 2e-3
    for r in rows:
        score, lang = max(((plain_vector(r["text"], idf) @ c, lang) for lang, c in centroids), key=lambda x: x[0])
        letters = any(c.isalpha() for c in r["text"] or "")
        assert got[r["doc_id"]]["lang_pred"] == (lang if letters else "und"), r
        assert got[r["doc_id"]]["score"] == pytest.approx(min(max(score, 0), 1) if letters else 0, abs=2e-3)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, language.training_rows())
    out = language.identify(docs.where(~language.training_rows()), model, ("doc_id", "lang", "n_chars"))
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg(F.col("rejected").cast("double")).alias("rejected")).first()
    assert r["right"] > 0.97 and r["rejected"] < 0.02


def test_language_rejects_long_texts_of_no_learned_language(spark):
    """Random letters and an invented Latin-script language at all lengths; clean held-out documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, language.training_rows())
    r = random.Random(4)
    syllables = [a + b for a in "kzwqxvjhyt" for b in ("uo", "ae", "i", "ou", "yy", "ek", "a")]
    letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    texts = [" ".join(f() for _ in range(k)) for k in (100, 400, 2000, 3000, 20_000) for f in (letters, lambda: r.choice(words)) for _ in range(3)]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(x["rejected"] for x in language.identify(odd, model).collect())
    held = docs.where(~language.training_rows() & F.col("text").rlike("[a-z]"))
    kept = language.identify(held, model, ("lang", "n_chars")).agg(F.avg(F.col("rejected").cast("double")).alias("all"), F.avg(F.when(F.col("n_chars") > 5000, F.col("rejected").cast("double"))).alias("long")).first()
    assert kept["all"] <= 0.015 and kept["long"] <= 0.015


def test_language_limits():
    s = np.arange(1000) / 1000
    got, enough = language.limits([s, s[:500], s[:100], *[s[:0]] * (language.CLASSES - 3)], 0.01)
    assert enough and got[:5].tolist() == [0.009, 0.004, 0.004, 0.004, 0.004]
    got, enough = language.limits([np.append(0.0, s[7:20]), s[9:20], *[s[:0]] * (language.CLASSES - 2)], 0.01)
    assert not enough and got[:3].tolist() == [0.007, 0.009, 0.009]


def test_language_learns_from_all_texts(spark):
    """Centroids and limits of more texts than any bound, copies once, against all texts one at a time."""
    r = random.Random(6)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefg"), ("bb", "defghijk"))}
    rows = [(lang, " ".join(r.choices(words[lang], k=12))) for lang in words for _ in range(1500)]
    rows += [("aa", rows[0][1])] * 700
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    model = language.fit(docs, F.lit(True), clusters=1)
    own = {lang: sorted({t for x, t in rows if x == lang}) for lang in words}
    for lang, texts in own.items():
        x = np.stack([plain_vector(t, model.idf) for t in texts])
        assert np.abs(model.centroids[model.langs.index(lang)] - x.sum(axis=0) / np.linalg.norm(x.sum(axis=0))).max() < 1e-5
        fold = np.array([text_hash(t.encode()) % 4 for t in texts])
        size = np.array([sum(plain_trigrams(t).values()) for t in texts])
        others = [x[fold != f].sum(axis=0) for f in range(4)]
        c = int(size.max()).bit_length() - 1  # no beginnings of longer texts are in the highest class
        scores = sorted(x[i] @ others[fold[i]] / np.linalg.norm(others[fold[i]]) for i in np.flatnonzero(size >= 2**c))
        rank = int(0.01 * (len(scores) + 1))
        assert rank >= 3 and 0 <= scores[rank - 1] - model.radius[lang][c] <= 1 / language.STEPS + 1e-5


def test_language_rounds_read_counts_of_texts(spark, monkeypatch):
    """Texts are counted once, not in every round: the table the rounds read has no texts. Copies count in document frequencies alone;
    counts beyond a byte and beyond the table of logarithms are whole; texts without trigrams only count as documents."""
    tables, passing = [], language.passing

    @contextmanager
    def recorded(spark):
        with passing(spark) as put:
            yield lambda df, label: tables.append((label, df.columns)) or put(df, label)

    monkeypatch.setattr(language, "passing", recorded)
    texts = ["", "7 !!", "ab", "ab " * 254 + "c", "ab " * 255 + "cd", "ab " * 256, "xyz" * 30_000, "\u00c9cole \u4e2d\u6587 " * 300]
    texts += [f"gh{i} some words {'x' * (i % 7)}" for i in range(700)] + ["one text thrice"] * 3
    rows = [(i, t, "aa") for i, t in enumerate(texts)] + [(-1, "ab", None), (-2, None, "aa")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True), clusters=1)
    assert [label for label, _ in tables] == ["language-texts"] and not any("text" in columns for _, columns in tables)
    seen = Counter(b for t in texts for b in plain_trigrams(t))
    assert np.allclose(model.idf, [math.log((1 + len(texts)) / (1 + seen[b])) + 0.1 for b in range(language.BINS)])
    x = sum(plain_vector(t, model.idf) for t in set(texts))
    assert np.abs(model.centroids - x / np.linalg.norm(x)).max() < 1e-5


def test_language_counts_packed():
    r = np.random.default_rng(5)
    counts = r.integers(1, 400, (600, language.BINS)) * (r.random((600, language.BINS)) < 0.05)
    counts[3], counts[5] = 0, 0
    counts[5, [0, 7, 8, 4095]] = 255, 256, 70_000, 2**40
    counts[599, :] = 254
    columns = language.packed(counts)
    for lo, n in ((0, 600), (3, 1), (2, 255), (599, 1)):
        at, value = language.unpacked([c.slice(lo, n) for c in columns])
        assert at.tolist() == np.flatnonzero(counts[lo:lo + n]).tolist() and (value == counts[lo:lo + n].ravel()[at]).all()


def brute_license(text):
    """All base phrases at all places, and all stretches of words against all templates by plain edit distance, without an index."""
    w = licenses.words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found, score = {label for _, label in at}, 1.0 if at else 0.0
    for label, t, key in licenses.TEMPLATES:
        x, k = t.split(), key.split()
        keys = [j for j in range(len(w)) if w[j:j + len(k)] == k]
        for i in range(len(w)):
            ends = [j + len(k) for j in keys if i <= j and j + len(k) - i <= 2 * len(x)]
            if not ends:
                continue
            row = list(range(len(x) + 1))
            for z in range(i, min(len(w), i + 2 * len(x))):
                new = [row[0] + 1]
                for p in range(len(x)):
                    new.append(min(new[-1] + 1, row[p + 1] + 1, row[p] + (w[z] != x[p])))
                row = new
                if z + 1 >= ends[0] and len(x) - row[-1] >= 0.8 * len(x):
                    found.add(label)
                    score = max(score, (len(x) - row[-1]) / len(x))
    starts = [i for i, _ in at]
    return {"n_words": len(w), "n_base": len(at), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for _, x in at})), "labels": ",".join(sorted(found)), "score": score}


def brute_labels(text):
    return brute_license(text)["labels"]


def test_license_scan(spark, empty):
    texts = [t for _, t, _ in licenses.TEMPLATES] + ["Licensed under CC-BY 4.0; All Rights Reserved. all rights reserved", "general public license " * 3, None, "", "é mit license", "cc by",
                                                     "foo released under the MIT licence", "bar, LICENSED under THE apache license; version 2.0 " + "x " * 4000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, labels string")
    index = licenses.build_index(df)
    got = licenses.scan(df, index).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == brute_license(texts[r["doc_id"]])
    three = next(r for r in got if r["doc_id"] == len(licenses.TEMPLATES) + 1)
    assert (three["n_base"], three["first_word"], three["last_word"], three["base_labels"]) == (3, 0, 6, "gpl")
    assert licenses.scan(empty, licenses.build_index(empty)).count() == 0


def test_license_scan_of_altered_notices(spark):
    """All notices in which as many words differ as the share of 0.8 allows, also the rare ones."""
    texts = []
    for _, t, _ in licenses.TEMPLATES:
        w = t.split()
        most = max(n for n in range(len(w)) if (len(w) - n) / len(w) >= 0.8)
        for gone in itertools.combinations(range(len(w)), most):
            texts.append("so " + " ".join("zzz" if i in gone else x for i, x in enumerate(w)) + " then")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df, licenses.build_index(df)).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert sum("mpl-2.0" in x for x in got.values()) > 50
    with pytest.raises(ValueError):
        licenses.scan(df, licenses.build_index(df), 0.7)


def test_license_scan_of_words_added_and_left_out(spark):
    """Notices with words added, left out and changed at all places, up to one more than the share of 0.8 allows."""
    rng = random.Random(11)
    texts = ["permission is hereby granted free of charge to any one person obtaining a copy of this software", "licensed under apache license version 2 0", "released under the mit license",
             "released under under the the mit license", "mit license", "licensed under the gnu general public license general public license", "copyright all rights reserved copyright all rights reserved"]
    for _, t, _ in licenses.TEMPLATES:
        w = t.split()
        for _ in range(40):
            v = list(w)
            for _ in range(rng.randint(1, len(w) // 5 + 2)):
                i, how = rng.randrange(len(v)), rng.randrange(4)
                v[i:i + 1] = [[v[i], "zzz"], [], ["zzz"], [v[i], rng.choice(w)]][how]
                v = v or ["zzz"]
            texts.append(" ".join([*rng.choices(w, k=rng.randint(0, 3)), *v, *rng.choices(w, k=rng.randint(0, 3))]))
    texts.append(" . ".join(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in licenses.scan(df, licenses.build_index(df)).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert "mit" in got[0]["labels"] and "apache-2.0" in got[1]["labels"]


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    exact.encode_special_tokens = True
    got = packing.pack(docs, tokenizer_path(), capacity=256, with_ids=True).collect()
    want = Counter()
    for d, t, *_ in corpus():
        want[d, tuple(exact.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    pieces = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    for (d, ids), n in want.items():
        mine = [r for r in pieces[d] if r["doc_tokens"] == len(ids)]
        at = 0
        for start in sorted({r["start"] for r in mine}):
            same = [r for r in mine if r["start"] == start]
            assert start == at and len(same) == n and all(tuple(r["ids"]) == ids[at:at + r["length"]] for r in same)
            at += same[0]["length"]
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    exact.encode_special_tokens = True
    texts = ["", " ", "  a  b ", "x  y\n z", "é é  ñ\n\n  z", "don't 's 12 34,5", "<|endoftext|> x", "a   b c", "　a 　b", "日本 語 1 2", "tab\t x", "end ", "\u0085 a b", "a   b  c"]
    encoder = packing.Encoder(tokenizer_path())
    raw, offsets = kernels.text_buffer(pa.array(texts))
    ids, begin = encoder.encode(raw, offsets)
    for i, t in enumerate(texts):
        assert ids[begin[i]:begin[i + 1]].tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_are_those_of_the_tokenizer(spark):
    """The tokenizer's default settings, without tokens around the text; documents side by side do not make a token."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    exact, end = Tokenizer.from_file(tokenizer_path()), "<|endoftext|>"
    texts = [end, f"a {end} b", f"a  {end}  b", end * 3, f"<|{end}|>", "<|endof", "text|> x", f"é{end}é\n", f" {end} {end}\t", "<|endoftext|", "", f"don't{end}'s 12"]
    want = [exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [50256]
    encoder = packing.Encoder(tokenizer_path(), added=True)
    ids, begin = encoder.encode(*kernels.text_buffer(pa.array(texts)))
    assert [ids[begin[i]:begin[i + 1]].tolist() for i in range(len(texts))] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in packing.pack(df, tokenizer_path(), with_ids=True).collect()} == {i: [*x, 0] for i, x in enumerate(want)}


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(3)
    units, demand = np.arange(1, 65), rng.integers(0, 40, 64)
    units, demand = units[demand > 0], demand[demand > 0]
    used = packing.solve_patterns(units, demand.astype(float), 128)
    assert (sum(p * n for p, n in used) == demand).all() and all((p * units).sum() <= 128 for p, _ in used)
    assert sum(n for _, n in used) <= 1.03 * (units * demand).sum() / 128 + 3
