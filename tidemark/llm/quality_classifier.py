"""Quality classifier by importance resampling.

Two hashed n-gram models are counted: the target text (labelled documents of good quality that aren't toxic) and the raw text (all
documents). An n-gram here is a word, a pair of neighbouring words, or the outline of a word (its classes of characters), each counted once
for a document, under its own 64-bit hash. The models' vocabulary is the grams that LEAST_DOCS or more labelled documents have, good or not.
A gram's log ratio is log((t + a) / (e + a)), where t target documents have it, e would if target and raw text were alike, and a smooths.
Ratios are truncated: above exp(LEAST_LOG) they count as one, so that much clean text does not buy off a toxic passage and no sum of small
chances rejects a long text. A document's log weight is the sum over its grams. Documents are resampled by Gumbel top-k: to
SHARPNESS times the log weight goes Gumbel noise from a hash of doc_id, and the k largest keys are kept, where k is the number of documents
whose log weight is above the margin. The margin is set by a quarter of the labelled rows, weighed by models counted without them: it leaves
the largest share of their rejects below it, less the share of their good documents. The models that weigh all documents then count all
labelled rows.

The labelled rows are a sample by hash, at most LABELLED of them in expectation; raw counts, k and the cutoff cover all documents.

Defined results: null and blank texts have log weight 0; texts of any length are read whole; a null doc_id has the noise of id 0; rows with
equal keys at the cutoff are all kept; a document with several labels counts as target only if all are good; without labels, or if no
margin separates the held-out ones, nothing is rejected; an empty table gives an empty result; other columns are ignored. Counts are summed
by Spark; to the driver come those of the vocabulary, which the size of the labelled sample bounds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, slices, table, worker_cache
from .wordhash import KEPT, MIX, Split, mixed

#: Most labelled rows used, about.
LABELLED = 20_000
#: One in so many labelled rows is held out of the models that set the margin.
HELD = 4
#: Documents added to both counts of a gram: a share of the target documents, so that the words of one group of copies, which some good
#: documents have by chance, weigh little.
SMOOTH, SMOOTH_SHARE = 2.0, 1 / 2000
LEAST_LOG, LEAST_DOCS, SHARPNESS = -1.0, 3, 8.0
COUNTS = ["good", "bad", "held_good", "held_bad"]
#: Each byte as its class of characters, or as itself.
CLASSES = re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[0-9]", b"0", bytes(range(256)))))
STRIPPED = b".,;:!?\"()[]{}*#$%&|<>'"
#: The gram of texts in which one word in five or more repeats the one before it.
REPEATS = np.uint64(1)


class Grams:
    """Hashes of words and of their outlines; those of the first KEPT words stay."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.shapes: dict[bytes, int] = {}

    def hashes(self, word: bytes) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            import xxhash

            shape = word[:64].translate(CLASSES)
            outline = self.shapes.get(shape)
            if outline is None:
                outline = xxhash.xxh3_64_intdigest(b"outline " + re.sub(rb"(.)\1+", rb"\1\1", re.sub(rb"([aA0])\1+", rb"\1", shape))[:12])
                if len(self.shapes) < KEPT // 10:
                    self.shapes[shape] = outline
            got = xxhash.xxh3_64_intdigest(word.lower().strip(STRIPPED)), outline
            if len(self.known) < KEPT:
                self.known[word] = got
        return got

    def of(self, texts: pa.Array) -> tuple[Split, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The texts' words, and parts (grams, which of them, the text it is in) that together list the grams of all texts, some more than once."""
        split = Split(texts)
        both = np.array(list(map(self.hashes, split.words())), np.uint64).reshape(-1, 2)
        rows, codes = split.rows(), split.codes
        h = both[codes, 0] if len(codes) else np.zeros(0, np.uint64)
        near = rows[1:] == rows[:-1]
        pairs = mixed(h[:-1] * MIX + h[1:])[near]
        same = np.bincount(rows[1:][near & (h[1:] == h[:-1])], minlength=len(split))
        repeated = np.flatnonzero(5 * same > split.sizes())
        return split, [
            (mixed(both[:, 0]), codes, rows),
            (both[:, 1], codes, rows),
            (pairs, np.arange(len(pairs)), rows[1:][near]),
            (np.array([REPEATS]), np.zeros(len(repeated), np.int64), repeated),
        ]


class Model:
    """Grams by their sorted hashes, the log ratio of each, and the margin of log weights."""

    def __init__(self, hashes: np.ndarray, ratios: np.ndarray, margin: float = -np.inf):
        self.hashes, self.ratios, self.margin = hashes, ratios, margin
        self.leading = np.zeros(1 << 22, bool)
        self.leading[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def sent(self, spark: SparkSession):
        """A broadcast of plain arrays, which executors without this package can read; Model(*value) makes it again."""
        return spark.sparkContext.broadcast((self.hashes, self.ratios, self.margin))

    def places(self, grams: np.ndarray) -> np.ndarray:
        """The place of each gram in hashes, or -1."""
        out = np.full(len(grams), -1, np.int64)
        maybe = np.flatnonzero(self.leading[(grams >> np.uint64(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)
            found = self.hashes[at] == grams[maybe]
            out[maybe[found]] = at[found]
        return out

    def among(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, place): each of the texts' grams that is in hashes, once for each text."""
        keys, n = [np.zeros(0, np.int64)], len(self.hashes)
        for grams, which, rows in worker_cache("grams", Grams).of(texts)[1]:
            at = self.places(grams)[which] if n else np.full(len(which), -1)
            some = at >= 0
            keys.append(rows[some] * n + at[some])
        keys = np.unique(np.concatenate(keys))
        return keys // max(1, n), keys % max(1, n)

    def weights(self, texts: pa.Array) -> np.ndarray:
        rows, at = self.among(texts)
        return np.bincount(rows, weights=self.ratios[at] if len(at) else None, minlength=len(texts)).astype(np.float64)


def _count_labelled(batches):
    """gram, then the number of good and bad rows to fit by and of those held out that have it; the row of a null gram counts the rows."""
    for batch in slices(batches):
        kind = (~batch.column("good").to_numpy(zero_copy_only=False)) + 2 * batch.column("held").to_numpy(zero_copy_only=False)
        grams, rows = (np.concatenate(x) for x in zip(*[(g[which], r) for g, which, r in worker_cache("grams", Grams).of(batch.column("text"))[1]], strict=True))
        used, place = np.unique(grams, return_inverse=True)
        once = np.unique(rows * len(used) + place)
        place, of = once % max(1, len(used)), kind[once // max(1, len(used))]
        counts = [np.r_[(kind == k).sum(), np.bincount(place[of == k], minlength=len(used))] for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([None], pa.int64()), pa.array(used.view(np.int64))]), *[pa.array(c, pa.int64()) for c in counts]], names=["gram", *COUNTS])


def _count_raw(sent):
    """at, raw for the grams of a model; place -1 counts the documents."""

    def run(batches):
        model, docs = Model(*sent.value), 0
        counts = np.zeros(len(model.hashes), np.int64)
        for batch in slices(batches):
            counts += np.bincount(model.among(batch.column("text"))[1], minlength=len(counts))
            docs += batch.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[docs, counts[used]])], names=["at", "raw"])

    return run


def _weigh_labelled(sent):
    """good, log_weight of each row."""

    def run(batches):
        model = Model(*sent.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(model.weights(batch.column("text")))], names=["good", "log_weight"])

    return run


def separating(good: np.ndarray, bad: np.ndarray) -> float:
    """The log weight, midway between two that occur, with the largest share of bad below it less that of good; minus infinity if none has more bad."""
    levels = np.unique(np.concatenate([good, bad]))
    if not len(good) or not len(bad) or len(levels) < 2:
        return -np.inf
    cuts = (levels[1:] + levels[:-1]) / 2
    gain = np.searchsorted(np.sort(bad), cuts) / len(bad) - np.searchsorted(np.sort(good), cuts) / len(good)
    return float(cuts[gain.argmax()]) if gain.max() > 0 else -np.inf


def log_ratios(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int) -> np.ndarray:
    """Log ratio for each gram; zero where it is not below the truncation."""
    if not n_target or not n_raw:
        return np.zeros(len(raw), np.float64)
    smooth = max(SMOOTH, n_target * SMOOTH_SHARE)
    ratio = np.log((target + smooth) / (raw * (n_target / n_raw) + smooth))
    return np.where(ratio < LEAST_LOG, ratio, 0.0)


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """The grams with a log ratio below zero, and the margin."""
    spark = docs.sparkSession
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)).alias("good"))
    share = min(1.0, labelled / max(1, labels.count()))
    sample = one.where(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # a sample of `labelled` ids in expectation, whatever the size of the tables
    joined = texts.join(F.broadcast(sample), "doc_id").select("text", "good", (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0).alias("held"))
    counts = joined.mapInArrow(_count_labelled, ", ".join(f"{c} long" for c in ("gram", *COUNTS)))
    counts = counts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS]).where(f"gram IS NULL OR {' + '.join(COUNTS)} >= {LEAST_DOCS}").toArrow()
    known = pc.is_valid(counts["gram"])
    n = np.array([pc.sum(counts.filter(pc.invert(known))[c]).as_py() or 0 for c in COUNTS])
    counts = counts.filter(known)
    hashes = counts["gram"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, of = hashes[order], np.array([counts[c].to_numpy()[order] for c in COUNTS])
    sent = Model(hashes, np.zeros(len(hashes))).sent(spark)
    rows = texts.select("text").mapInArrow(_count_raw(sent), "at long, raw long").groupBy("at").agg(F.sum("raw").alias("raw")).toArrow()
    at, found = rows["at"].to_numpy(), rows["raw"].to_numpy()
    raw, n_raw = np.zeros(len(hashes), np.int64), int(found[at < 0].sum())
    raw[at[at >= 0]] = found[at >= 0]
    # without and with the rows held out
    part, model = (_model(hashes, raw, n_raw, *x) for x in ((of[0], of[:2].sum(0), int(n[0])), (of[0] + of[2], of.sum(0), int(n[0] + n[2]))))
    held = joined.where("held").select("text", "good").mapInArrow(_weigh_labelled(part.sent(spark)), "good boolean, log_weight double").toPandas()
    good, weights = held["good"].to_numpy(bool), held["log_weight"].to_numpy(float)
    return Model(model.hashes, model.ratios, separating(weights[good], weights[~good]))


def _model(hashes: np.ndarray, raw: np.ndarray, n_raw: int, target: np.ndarray, labelled: np.ndarray, n_target: int) -> Model:
    ratios = np.where(labelled >= LEAST_DOCS, log_ratios(raw, target, n_raw, n_target), 0.0)
    return Model(hashes[ratios < 0], ratios[ratios < 0])


def _keys(doc_ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    u = ((mixed(doc_ids.astype(np.uint64) * MIX + np.uint64(7)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return SHARPNESS * weights - np.log(-np.log(u))


def _scored(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    weights = model.weights(batch.column("text"))
    return weights, _keys(batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), weights)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log_weight, key for each row."""
    sent = model.sent(docs.sparkSession)

    def run(batches):
        model = Model(*sent.value)
        for batch in slices(batches):
            weights, keys = _scored(batch, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weights), pa.array(keys)], names=["doc_id", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight double, key double")


def kth_largest(df: DataFrame, column: str, k: int, few: int = 5000) -> float:
    """The k-th largest value, exactly: histograms narrow the range until few values are left. All values if k is not positive: none is below."""
    if k <= 0:
        return float("inf")
    while True:
        r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
        if r["lo"] == r["hi"] or k > r["n"]:
            return r["lo"] if r["n"] else float("-inf")
        if r["n"] <= few:
            return sorted((x[0] for x in df.select(column).collect()), reverse=True)[k - 1]
        width = (r["hi"] - r["lo"]) / 1000
        if r["lo"] + width == r["lo"]:
            return r["lo"]
        bins = F.least(F.floor((F.col(column) - r["lo"]) / width), F.lit(999))
        for b, n in sorted(((x["b"], x["n"]) for x in df.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
            if k <= n:
                df = df.where(bins == b)
                break
            k -= n


def cutoff(scored: DataFrame, margin: float) -> float:
    k = scored.where(F.col("log_weight") >= margin).count()
    return kth_largest(scored, "key", k)


def resampled(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, log_weight, key, kept for each row of (doc_id, text)."""
    model = fitted(docs, labels, labelled)
    scored = settled(scores(docs, model))
    return scored.withColumn("kept", F.col("key") >= F.lit(cutoff(scored, model.margin)))


def accepted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Keys are computed again in the filtering scan, so that no text is exchanged."""
    model = fitted(docs, labels, labelled)
    cut = cutoff(settled(scores(docs, model)), model.margin)
    sent = model.sent(docs.sparkSession)

    def run(batches):
        model = Model(*sent.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(_scored(batch, model)[1] >= cut))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
