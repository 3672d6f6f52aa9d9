"""Language identification by the nearest of several centroids for each language.

A text's features are its byte trigrams, hashed, weighted by TF-IDF and normalised. Document frequencies come from all
labelled training rows; the centroids from all their different texts, by spherical k-means: texts are counted once, each round
is a pass over these counts in which tasks add up the vectors nearest to each centroid. A prediction is the language of the
centroid with the highest cosine; texts farther from it than nearly all learned texts of that language are at their length are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import passing
from .kernels import chunks, lower_table, text_buffer

BINS = 4096
UNKNOWN = "und"
#: Classes of length: class c has texts of 2**c trigrams to below twice as many.
CLASSES = 40
#: Parts of the learned texts; each is compared with centroids of the others.
FOLDS = 4
#: Vectors are added up as integers of this many to one, so sums do not depend on the order of tasks.
SCALE = 1 << 16
#: Steps of cosines from 0 to 1 that limits are found among.
STEPS = 4096
#: Least rank of a score that is a limit, so that one or two odd texts do not set it.
LEAST_RANK = 3
#: Logarithms of small counts plus one.
LOGS = np.log1p(np.arange(1 << 16, dtype=np.float32))
#: Counts of a text's trigrams: BINS bits, of which those of counts above 0 are set; a byte of each such count, 255 at most; and
#: what counts of 255 or more have above it, of eight bytes. Of the bits, bytes that are not zero are kept and ``top`` says which
#: they are, so that short texts take little room.
COUNTS = ("top", "bits", "low", "more")


@dataclass
class Model:
    idf: np.ndarray  # by bin
    centroids: np.ndarray  # unit vectors by row
    langs: list[str]  # language of each centroid
    radius: dict[str, np.ndarray]  # least cosine that is not rejected, by class of length


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin letters of two bytes; all that is not a letter becomes a space."""
    table = lower_table().copy()
    code = np.arange(256)
    table[(code < 128) & ~((table >= 97) & (table <= 122))] = 32
    b = np.frombuffer(bytearray(raw.tobytes().translate(table.tobytes())), np.uint8)
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    b[second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]] += np.uint8(32)
    return b


def trigram_bins(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash below BINS) of trigrams in their order, without those of spaces alone and those across documents."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = fold(raw)
    space = b == 32
    two = space[:-1] & space[1:]
    keep = ~(two[:-1] | two[1:])
    for back in (1, 2):
        across = offsets[1:-1] - back
        keep[across[(across >= 0) & (across < len(keep))]] = False
    at = np.flatnonzero(keep)
    wide = b.astype(np.uint32)
    code = ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:])[at]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    return doc, ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, BINS) counts of hashed trigrams."""
    n = len(offsets) - 1
    doc, bins = trigram_bins(raw, offsets)
    return np.bincount(doc * BINS + bins, minlength=n * BINS).reshape(n, BINS)


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of consecutive runs of ``data``, of so many bytes each."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def packed(counts: np.ndarray) -> list[pa.Array]:
    """The columns of COUNTS, a row of ``counts`` each."""
    on = counts > 0
    bits = np.packbits(on, axis=1)
    some = bits != 0
    value, large = counts[on], counts >= 255
    top = np.packbits(some, axis=1)
    return [binary(top, np.full(len(top), top.shape[1])), binary(bits[some], some.sum(axis=1)),
            binary(np.minimum(value, 255).astype(np.uint8), on.sum(axis=1)), binary((counts[large] - 255).astype("<i8").view(np.uint8), 8 * large.sum(axis=1))]


def unpacked(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(number of row * BINS + bin, count) of the counts above 0 in the columns of COUNTS, in order."""
    top, bits, low, more = (text_buffer(c)[0] for c in columns)
    n = len(columns[0])
    some = np.unpackbits(top.reshape(n, -1), axis=1).view(bool)
    all_bits = np.zeros(some.shape, np.uint8)
    all_bits[some] = bits
    at, value = np.flatnonzero(np.unpackbits(all_bits, axis=1).view(bool)), low.astype(np.int64)
    value[low == 255] += more.view("<i8")
    return at, value


def counted(texts: DataFrame) -> DataFrame:
    """(lang, k, COUNTS) of each row of (lang, k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part, at in small_chunks(batch.column(2)):
                key = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*key, *packed(trigram_counts(part, at))], names=["lang", "k", *COUNTS])

    return texts.select("lang", "k", "text").mapInArrow(run, ", ".join(["lang string, k long", *(f"{c} binary" for c in COUNTS)]))


def counts_of_batches(batches: Iterator[pa.RecordBatch]):
    """(lang, k or what stands in its place, places, counts) of at most 256 of the (lang, k, COUNTS) of a task at once."""
    for batch in batches:
        lang, k = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
        for lo in range(0, batch.num_rows, 256):
            hi = min(lo + 256, batch.num_rows)
            yield lang[lo:hi], k[lo:hi], *unpacked([batch.column(i).slice(lo, hi - lo) for i in range(2, 6)])


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), CLASSES - 1)


def placed_vectors(n: int, at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """n unit vectors of the counts above 0 at these places of all rows together."""
    logs = LOGS[counts] if counts.max(initial=0) < len(LOGS) else np.log1p(counts.astype(np.float32))
    x = np.zeros((n, len(idf)), np.float32)
    x.ravel()[at] = logs * idf.astype(np.float32)[at % len(idf)]
    x /= np.maximum(np.sqrt(np.add.reduce(x * x, axis=1, keepdims=True)), 1e-12)
    return x


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(counts)
    return placed_vectors(len(counts), at, counts.ravel()[at], idf)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a letter: ASCII at once, others by their Unicode class."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def small_chunks(column: pa.Array):
    """Chunks of at most 256 documents, so that the matrix of counts stays small."""
    raw, offsets = text_buffer(column)
    for lo, hi, part, at in chunks(raw, offsets):
        for a in range(0, hi - lo, 256):
            z = min(a + 256, hi - lo)
            yield lo + a, lo + z, part[at[a]:at[z]], at[a:z + 1] - at[a]


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each bin, documents) over the (lang, n, COUNTS) of n documents each: a vector for each partition is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BINS, np.int64), 0
        for _, times, at, _ in counts_of_batches(batches):
            df += np.bincount(at % BINS, weights=times[at // BINS], minlength=BINS).astype(np.int64)
            n += int(times.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BINS), -1)), pa.array(np.append(df, n))], names=["bin", "n"])

    got = rows.select("lang", "n", *COUNTS).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows
    df = np.zeros(BINS + 1, np.int64)
    for r in got:
        df[r["bin"]] = r["n"]
    return df[:BINS], int(df[BINS])


def labelled_sample(labelled: DataFrame, bound: int) -> DataFrame:
    """(lang, text, k): different texts, numbered from 1 in a language, shared equally by the languages.

    They are the texts of least hash: at most ``bound`` in all, but always one of each language. Different hashes of texts are
    counted, so neither copies of a text nor their number matter. Rows above a hash threshold drop out before the ranking, so
    no language is ranked as a whole."""
    h = F.xxhash64("text")
    sizes = labelled.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")).collect()
    if not sizes:
        return labelled.select("lang", "text", F.lit(1).alias("k")).limit(0)
    each = max(1, bound // len(sizes))
    # Fewer than ``each`` stay below the threshold with a chance of less than 1e-15.
    rates = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * each + 60) / r["n"]), r["first"]) for r in sizes], "lang string, rate double, first long")
    picked = labelled.select("lang", "text", h.alias("h")).join(F.broadcast(rates), "lang")
    picked = picked.where((F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("rate")) | (F.col("h") == F.col("first"))).dropDuplicates(["lang", "h"])
    return picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).select("lang", "text", "k")


def different_counts(texts: DataFrame) -> DataFrame:
    """(lang, k, n, COUNTS): every text of a language once, k being a hash of it, and how many rows have it.

    Counts are shuffled, not texts: they take less room."""
    one = [F.first(c).alias(c) for c in COUNTS]
    return counted(texts).groupBy("lang", "k").agg(F.count(F.lit(1)).alias("n"), *one)


def vectors_by_language(batches: Iterator[pa.RecordBatch], idf: np.ndarray):
    """(lang, k, vectors) of runs of the (lang, k, COUNTS) of a task; texts without trigrams are left out."""
    for lang, k, at, counts in counts_of_batches(batches):
        on, x = np.zeros(len(k), bool), placed_vectors(len(k), at, counts, idf)
        on[at // BINS] = True
        for name in sorted(set(lang[on])):
            own = on & (lang == name)
            yield (name, k, x) if own.all() else (name, k[own], x[own])


def nearest_sums(texts: DataFrame, idf: np.ndarray, centres: dict[str, np.ndarray] | None, folds: int = 1) -> dict[tuple[str, int, int], np.ndarray]:
    """Sum of the vectors of each (lang, nearest centroid, k modulo ``folds``); without ``centres`` a language has one sum.

    A task sends one sum for each of them; those of one are added up in one task. Nothing but the sums comes to the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for lang, k, x in vectors_by_language(batches, idf):
            near = np.argmax(x @ centres[lang].T, axis=1) if centres else np.zeros(len(x), np.int64)
            group, row = np.unique(near * folds + k % folds, return_inverse=True)
            member = np.zeros((len(group), len(x)), np.float32)
            member[row, np.arange(len(x))] = 1
            x *= SCALE
            total = (member @ np.rint(x, out=x)).astype(np.int64)  # exact: at most 256 rows of at most 2**16
            for g, v in zip(group.tolist(), total, strict=True):
                key = lang, g // folds, g % folds
                sums[key] = sums[key] + v if key in sums else v
        for (lang, c, f), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c]), pa.array([f]), pa.array([v.tobytes()])], names=["lang", "c", "f", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for lang, c, f, v in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                key, v = (lang, c, f), np.frombuffer(v, np.int64)
                sums[key] = sums[key] + v if key in sums else v
        for (lang, c, f), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c]), pa.array([f]), pa.array([v.astype(np.float32).tobytes()])], names=["lang", "c", "f", "sums"])

    schema = "lang string, c long, f long, sums binary"
    got = texts.select("lang", "k", *COUNTS).mapInArrow(local, schema).repartition("lang", "c", "f").mapInArrow(added, schema).collect()
    return {(r["lang"], r["c"], r["f"]): np.frombuffer(r["sums"], np.float32) for r in got}


def farthest(texts: DataFrame, idf: np.ndarray, begun: dict[str, np.ndarray], sign: int) -> dict[str, tuple[int, np.ndarray]]:
    """(k, vector) of the text of each language whose highest cosine with its vectors ``begun``, times ``sign``, is least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[float, int, bytes]] = {}
        for lang, k, x in vectors_by_language(batches, idf):
            if lang in begun:
                cosine = sign * (x @ begun[lang].T).max(axis=1).astype(np.float64)
                i = int(np.lexsort((k, cosine))[0])
                best[lang] = min(best.get(lang, (np.inf, 0, b"")), (float(cosine[i]), int(k[i]), x[i].tobytes()))
        for lang, (cosine, k, v) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([cosine]), pa.array([k]), pa.array([v])], names=["lang", "cosine", "k", "vector"])

    rows = texts.select("lang", "k", *COUNTS).mapInArrow(run, "lang string, cosine double, k long, vector binary")
    got = rows.groupBy("lang").agg(F.min(F.struct("cosine", "k", "vector")).alias("best")).collect()
    return {r["lang"]: (r["best"]["k"], np.frombuffer(r["best"]["vector"], np.float32)) for r in got}


def unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.linalg.norm(x)), 1e-12)


def spherical_kmeans(texts: DataFrame, idf: np.ndarray, k: int, rounds: int = 15) -> tuple[dict[str, np.ndarray], dict[tuple[str, int, int], np.ndarray]]:
    """At most k unit centroids a language, and the sums of each part of the texts that they are made of.

    Begun from the text nearest to the mean and those farthest from the ones begun before."""
    means = {lang: unit(v)[None] for (lang, _, _), v in nearest_sums(texts, idf, None).items()}
    if not means:
        return {}, {}
    begun, taken = {}, {}
    for lang, (at, v) in farthest(texts, idf, means, -1).items():
        begun[lang], taken[lang] = v[None], {at}
    grow = dict(begun)
    for _ in range(k - 1):
        for lang, (at, v) in farthest(texts, idf, grow, 1).items():
            if at in taken[lang]:  # it has no more texts
                del grow[lang]
            else:
                taken[lang].add(at)
                begun[lang] = grow[lang] = np.concatenate([begun[lang], v[None]])
        if not grow:
            break
    centres = begun
    for i in range(rounds):
        folds = FOLDS if i == rounds - 1 else 1
        sums = nearest_sums(texts, idf, centres, folds)
        new = {lang: np.stack([moved(sums, lang, c, folds, old) for c, old in enumerate(own)]) for lang, own in centres.items()}
        done = all(np.allclose(new[lang], centres[lang], atol=1e-6) for lang in centres)
        centres = new
        if done:
            break
    return centres, sums if folds == FOLDS else nearest_sums(texts, idf, centres, FOLDS)


def moved(sums: dict[tuple[str, int, int], np.ndarray], lang: str, c: int, folds: int, old: np.ndarray) -> np.ndarray:
    """The centroid of what is nearest to it; it stays where nothing is."""
    own = [sums[lang, c, f] for f in range(folds) if (lang, c, f) in sums]
    return unit(np.sum(own, axis=0)) if own else old


def excerpt_cosines(texts: DataFrame, idf: np.ndarray, others: dict[tuple[str, int], np.ndarray]) -> dict[str, list[np.ndarray]]:
    """Of each language and class of length, how many of its different texts, and of their beginnings in every shorter class,
    have each cosine, in STEPS, with the nearest of their language's centroids of other texts.

    Copies of a text drop out when its steps are known, so no texts are shuffled. At most CLASSES * (STEPS + 1) counts of a
    language, of all texts, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(BINS, np.int64)
        for batch in batches:
            lang, part_of = batch.column(0).to_pylist(), (batch.column(1).to_numpy() % FOLDS).tolist()
            for lo, hi, part, at in small_chunks(batch.column(2)):
                doc, bins = trigram_bins(part, at)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows, steps = [], []
                for i in range(hi - lo):
                    own, n = bins[cuts[i]:cuts[i + 1]], int(cuts[i + 1] - cuts[i])
                    c = others.get((lang[lo + i], part_of[lo + i]))
                    if n and c is not None:
                        top = int(length_class(np.array([n]))[0])
                        sizes = [2**k + n % 2**k for k in range(top)] + [n]
                        used = np.flatnonzero(np.bincount(own, minlength=BINS))
                        place[used] = np.arange(len(used))
                        between = np.repeat(np.arange(len(sizes)) * len(used), np.diff([0, *sizes]))
                        counts = np.bincount(between + place[own], minlength=len(sizes) * len(used)).reshape(len(sizes), -1).cumsum(axis=0)
                        rows.append(lo + i)
                        steps.append(np.clip(np.floor((vectors(counts, idf[used]) @ c[:, used].T).max(axis=1) * STEPS), 0, STEPS).astype(np.int32))
                if rows:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in steps])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(steps)))], names=["lang", "k", "steps"])

    rows = texts.select("lang", "k", "text").mapInArrow(run, "lang string, k long, steps array<int>").dropDuplicates(["lang", "k"])
    rows = rows.select("lang", F.posexplode("steps").alias("class", "step"))
    out: dict[str, list[np.ndarray]] = {}
    for r in rows.groupBy("lang", "class", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r["lang"], [np.zeros(STEPS + 1, np.int64) for _ in range(CLASSES)])[r["class"]][r["step"]] = r["n"]
    return out


def limits(scores: list[np.ndarray], rate: float, counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, bool]:
    """(least cosine of each class that is not rejected, whether there are scores enough for ``rate``).

    counts: how often each score occurs; once without it.

    Of m scores the one of rank rate * (m + 1) is exceeded by another text of the kind with a chance of 1 - rate or more. A
    class where that rank is below LEAST_RANK takes the limit of the next shorter one, where cosines are lower. If the
    shortest has too few, the limits have rank 1 at least, among the scores above 0: a text that shares nothing with the rest
    of its language would set a limit that rejects nothing."""
    out, held = np.zeros(CLASSES), 0.0
    counts = counts or [np.ones(len(s), np.int64) for s in scores]
    enough = int(rate * (int(counts[0].sum()) + 1)) >= LEAST_RANK
    for c, (s, n) in enumerate(zip(scores, counts, strict=True)):
        on = np.argsort(s, kind="stable") if enough else np.flatnonzero(s > 0)[np.argsort(s[s > 0], kind="stable")]
        upto = np.cumsum(n[on])
        m = int(upto[-1]) if len(upto) else 0
        rank = int(rate * (m + 1))
        if rank >= LEAST_RANK if enough else m:
            held = float(s[on[np.searchsorted(upto, max(rank, 1))]])
        out[c] = held
    return out, enough


def fit(docs: DataFrame, trainable: Column, sample: int | None = None, clusters: int = 4, rate: float = 0.01) -> Model:
    """A model of the rows where ``trainable`` holds and lang and text are there: of all their different texts.

    sample: bound of different texts for centroids and limits, shared equally by the languages, for a quick model (with more
    languages than that it is one text of each); document frequencies cover all rows.

    rate: share of texts of a language, at any length, that may be rejected although they are like those learned. The limits
    come from all texts learned and beginnings of them, compared with centroids of the other parts of these texts, rounded down
    to a step of 1 / STEPS. A language with fewer than LEAST_RANK / rate texts has the lower of its own limit (its least
    score, if need be) and that of all languages together; one with a single text rejects nothing by distance.

    Sums of vectors (16 kB for each centroid, FOLDS times that at the end) and counts of cosines come to the driver."""
    labelled = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = labelled.select("lang", F.xxhash64("text").alias("k"), "text")
    with passing(docs.sparkSession) as put:
        if sample is None:
            counts = put(different_counts(texts), "language-texts")
            df, n = document_frequencies(counts)
        else:
            df, n = document_frequencies(counted(texts).withColumn("n", F.lit(1).cast("long")))
            texts = put(labelled_sample(labelled, sample).select("lang", F.col("k").cast("long").alias("k"), "text"), "language-sample")
            counts = put(different_counts(texts), "language-texts")
        idf = np.log((1 + n) / (1 + df)) + 0.1
        centres, parts = spherical_kmeans(counts, idf, clusters)
        others = {}  # centroids without the vectors of one part
        for lang, own in centres.items():
            for f in range(FOLDS):
                rest = [[parts[lang, c, g] for g in range(FOLDS) if g != f and (lang, c, g) in parts] for c in range(len(own))]
                if any(rest):
                    others[lang, f] = np.stack([unit(np.sum(v, axis=0)) for v in rest if v])
        seen = excerpt_cosines(texts, idf, others) if others else {}
    langs = [lang for lang in sorted(centres) for _ in centres[lang]]
    empty = [np.zeros(STEPS + 1, np.int64)] * CLASSES
    value = [np.arange(STEPS + 1) / STEPS] * CLASSES
    of_all, _ = limits(value, rate, [np.sum([seen[lang][c] for lang in seen], axis=0) if seen else empty[c] for c in range(CLASSES)])
    radius = {}
    for lang in centres:
        own, enough = limits(value, rate, seen.get(lang, empty))
        radius[lang] = own if enough else np.minimum(own, of_all)
    return Model(idf, np.concatenate([centres[lang] for lang in sorted(centres)]).astype(np.float32) if centres else np.zeros((0, BINS), np.float32), langs, radius)


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and lang_pred, score, rejected for every row.

    ``und`` with score 0, rejected: null, empty and letterless texts, and all texts if nothing was learnt. Otherwise the
    language of the nearest centroid (the first in order of name on a tie), the score being the cosine; rejected says whether
    it is below the language's limit for texts of that length; texts with letters but no trigram are not rejected. Whole texts
    are read; repeated rows are judged alike; an empty table gives an empty one. Columns of ``carry`` called lang_pred, score or rejected are replaced."""
    carry = tuple(c for c in carry if c not in ("lang_pred", "score", "rejected"))
    fields = {f.name: f for f in docs.schema.fields}
    text = carry.index("text") if "text" in carry else len(carry)
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in carry), "lang_pred string, score double, rejected boolean"])
    radius = np.stack([*(model.radius[x] for x in model.langs), np.full(CLASSES, 2.0)])
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, rejected = [], [], []
            for lo, hi, part, at in small_chunks(batch.column(text)):
                best, near = np.zeros(hi - lo), np.full(hi - lo, len(model.langs))
                known = has_letter(part, at)
                if len(model.langs):
                    counts = trigram_counts(part, at)
                    cosine = vectors(counts, model.idf) @ model.centroids.T
                    near = np.where(known, np.argmax(cosine, axis=1), len(model.langs))
                    best = np.where(known, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0)
                    size = counts.sum(axis=1)
                    rejected.append(~known | ((best < radius[near, length_class(size)]) & (size > 0)))
                else:
                    rejected.append(np.ones(hi - lo, bool))
                pred.append(names[near])
                score.append(best)
            if batch.num_rows:
                cols = [batch.column(i) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(pred), pa.string()), pa.array(np.concatenate(score).astype(np.float64)), pa.array(np.concatenate(rejected))],
                                                 names=[*carry, "lang_pred", "score", "rejected"])

    more = [] if "text" in carry else [F.col("text").cast("string").alias("__text")]
    return docs.select(*carry, *more).mapInArrow(run, schema)


def training_rows() -> Column:
    """Documents whose CRC-32 of doc_id, as text, is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))
