"""Phrase mining, the byte-level encoder and vector codes against plain code."""

import math
import random
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import pytest

pytest.importorskip("strandweave.llm")
from strandweave.llm import bytepair, phrases, pivots  # noqa: E402

P = pytest.importorskip("public_tokenizers")


# ------------------------------------------------------------------ phrases


def plain_phrases(rows, least, longest=4, most=2000):
    """lang -> list of (phrase, a, l, r, score), by definition."""
    grams, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for sep in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(sep, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                grams.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in grams.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in cand.items()):
                continue
            score, k = min((math.floor(Fraction(2_000_000 * a, f[g[:k]] + f[g[k:]])), k) for k in range(1, len(g)))
            found.append((" ".join(g), a, f[g[:k]], f[g[k:]], score))
        found.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        if found:
            out[lang] = [(i + 1, *x, total[lang]) for i, x in enumerate(found[:most])]
    return out


def corpus(seed=5, n=150):
    r = random.Random(seed)
    words = ["the", "cat", "sat", "on", "a", "mat", "É", "dog", "ran", "far", "naïve"]
    fixed = ["the cat sat on", "New York city", "x x x x x", "a, the. on"]
    rows = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randint(0, 40))]
        rows.append((r.choice(["en", "fr", None]), r.choice([" ", "  ", "\t", "   "]).join(parts).replace("far", "far" + r.choice([".", "\n", "!?", " "]))))
    return [*rows, rows[0], (None, None), ("en", ""), ("de", " . "), ("und", "the cat sat on")]


@pytest.mark.parametrize("head", [400_000, 5, 0])
def test_phrases(spark, monkeypatch, head):
    """Also where few or no codes go to the tasks by broadcast and the others are joined."""
    monkeypatch.setattr(phrases, "HEAD", head)
    rows = corpus()
    docs = spark.createDataFrame([(i % 7, t, lang, "open", i) for i, (lang, t) in enumerate(rows)], "doc int, text string, lang string, open string, ids int").repartition(5)
    found, totals = phrases.collocations(docs, least=20)
    got = {}
    for x in phrases.top_phrases(found, totals, 30).collect():
        got.setdefault(x["lang"], []).append((x["rank"], x["phrase"], x["a"], x["l"], x["r"], x["score"], x["n"]))
    assert {k: sorted(v) for k, v in got.items()} == plain_phrases(rows, 20, most=30)


def test_phrases_of_an_empty_table(spark):
    found, totals = phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert phrases.top_phrases(found, totals).collect() == []


def test_one_very_long_text(spark):
    found, _ = phrases.collocations(spark.createDataFrame([("ab cd ef " * 100_000, None)], "text string, lang string"))
    assert {(x["phrase"], x["a"]) for x in found.collect()} == {("ab cd ef ab", 99_999), ("cd ef ab cd", 99_999), ("ef ab cd ef", 99_999)}


def test_tiles(monkeypatch):
    """Dense tiles and sorted coordinates give the counts of a dictionary."""
    import numpy as np

    monkeypatch.setattr(phrases, "DENSE", 1 / 4096)
    r = np.random.default_rng(3)
    tiles, want = phrases.Tiles(), Counter()
    for _ in range(4):
        x, y = (np.minimum(r.zipf(1.3, 20_000), 5_000_000) - 1 for _ in range(2))
        code = x.astype(np.int64) << 32 | y
        want.update(code.tolist())
        tiles.add(code)
    assert tiles.dense
    got = Counter()
    for codes, n in [tiles.sparse(), *tiles.full()]:
        got.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    assert got == want


# ------------------------------------------------------------------ byte-level BPE


def odd_texts():
    r = random.Random(2)
    letters = "aaabeelo tthiingé ÿ\n\r\t 漢字🙂\x00\x1c_'s0129<|endoftext|>▁"
    texts = ["", None, " ", "\n\n\n", "don't  we'll\t\tgo ", "x" * 300_000, "ab " * 60_000, "   " * 50_000 + "x", "\U0003d288褖 ⭳a", "<|endoftext|> <unk> <3>"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(300)]
    texts += ["".join(chr(r.choice([r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF), r.randint(0, 300)])) for _ in range(40)) for _ in range(300)]
    return texts


def test_bytes_as_the_tokenizer_library(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytepair.read_ranks(path), special_tokens={})
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "own", b"x") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded binary").repartition(3)
    coded = bytepair.encode(docs, path, P.PATTERN)
    got = {x["doc_id"]: x["ids"] for x in coded.collect()}
    assert got == {i: want.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {x["doc_id"]: bytes(x["decoded"]) for x in bytepair.decode(coded, path).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_every_piece_has_its_rank():
    ranks = bytepair.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoder = bytepair.Encoder(bytepair.serialise(ranks), P.PATTERN)
    assert encoder.known == {bytepair.letters(p): r for p, r in ranks.items()}


def test_gaps_missing_bytes_and_bad_ids(spark, tmp_path):
    import base64

    with pytest.raises(ValueError):
        bytepair.serialise({b"a": 0})
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 400}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for p, r in ranks.items()))
    docs = spark.createDataFrame([(1, "abcab"), (2, None)], "doc_id long, text string")
    assert {x["doc_id"]: x["ids"] for x in bytepair.encode(docs, str(path), P.PATTERN).collect()} == {1: bytes_ids("abcab", ranks), 2: []}
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {x["doc_id"]: x["decoded"] for x in bytepair.decode(ids, str(path)).collect()} == {1: None, 2: b""}
    for bad in (299, 401, -1, None):
        with pytest.raises(Exception, match="no piece"):
            bytepair.decode(spark.createDataFrame([(1, [97, bad])], "doc_id long, ids array<int>"), str(path)).collect()


def bytes_ids(text, ranks):
    """Plain merges: the pair of least rank first, the leftmost among equals."""
    parts = [bytes([b]) for b in text.encode()]
    while True:
        options = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not options:
            return [ranks[p] for p in parts]
        _, i = min(options)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_empty_documents_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = P.path("byte_bpe_50k.tiktoken")
    assert bytepair.decode(bytepair.encode(docs, path, P.PATTERN), path).collect() == []


# ------------------------------------------------------------------ vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(rows of id, code, error), digest of entries; rows of id, label, vector in order."""
    kept = [(i, lab, [math.floor(Fraction(256) * Fraction(x)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(book)]
    out = []
    for (i, lab, _), c in zip(kept, cut, strict=True):
        best = [near(x, b) for x, b in zip(c, books, strict=True)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def run_codes(spark, rows):
    df = spark.createDataFrame([(i, lab, v, "x", 1.0) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, error string, rows double").repartition(4)
    coded, books = pivots.compress(df)
    out = pivots.with_label_errors(coded)
    return [(r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in out.withColumn("code", pivots.code(out["indexes"])).collect()], books


@pytest.mark.parametrize("scale,labels", [(1.0, 200_000), (1e-2, 3), (1e6, 3), (2.0**40, 0)])
def test_codes(spark, monkeypatch, scale, labels):
    """Ties (coarse components), repeated rows, nulls, and components whose squares pass 64 bits; labels joined either way."""
    monkeypatch.setattr(pivots, "LABELS", labels or 200_000)
    r = random.Random(7)
    rows = [(i, r.choice([0, 0, 0, 1, 2, 3, 4, None]), [r.choice([-2, -1, -0.5, 0, 0.25, 1, 1.5]) * scale for _ in range(32)]) for i in range(150)]
    rows += [rows[3], (3, 1, None), (None, None, rows[5][2]), (1000, None, [float("nan")] * 32), (1001, 2, [None] + [0.0] * 31), (1002, 2, [float("inf")] + [0.0] * 31)]
    want, digest = plain_codes(rows)
    got, books = run_codes(spark, rows)
    assert books.digest == digest
    fits = lambda e: e if e < 1 << 63 else None
    assert sorted(((a, b, c, e) for a, b, c, e, _ in got), key=repr) == sorted(((a, b, c, fits(e)) for a, b, c, e in want), key=repr)
    sums = {}
    for _, lab, _, e in want:
        sums.setdefault(lab, []).append(fits(e))
    for _, lab, _, _, s in got:
        own = sums[lab]
        assert s == (None if None in own or sum(own) >= 1 << 63 else sum(own))


def test_the_largest_components(spark):
    rows = [(0, 0, [1e308] * 16), (1, 0, [-1e308] * 16), (2, 0, [1.0] * 16)]
    got, books = run_codes(spark, rows)
    assert books.digest == plain_codes(rows)[1] and {g[3] for g in got} == {0}


def test_odd_lengths_and_empty_table(spark):
    got, _ = run_codes(spark, [(0, 1, [1.0] * 16), (1, 1, [1.0] * 5), (2, 2, [])])
    assert sorted(got) == [(0, 1, "00" * 16, 0, None), (1, 1, None, None, None), (2, 2, None, None, None)]
    got, books = run_codes(spark, [(0, 1, [1.0] * 5)])
    assert got == [(0, 1, None, None, None)] and books is None
    assert run_codes(spark, []) == ([], None)


def test_bounds_prune():
    """Entries far from a part by a pivot are not compared: squared() sees a share of them only."""
    import numpy as np

    r = np.random.default_rng(1)
    entries = r.integers(-1000, 1000, (64, 4))
    parts = entries[r.integers(0, 64, 500)] + r.integers(-3, 4, (500, 4))
    chosen = entries[pivots.spread_out(entries, 3)]
    far = pivots.roots(pivots.squared(parts[:, None], chosen[None]))
    seen, exact = [], pivots.squared
    pivots.squared = lambda a, b: (seen.append(len(a)), exact(a, b))[1]
    try:
        index, d = pivots.nearest(parts, far, entries, chosen)
    finally:
        pivots.squared = exact
    full = exact(parts[:, None], entries[None])
    assert (index == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert sum(seen[1:]) < 0.2 * full.size
