"""Mixing sources to target weights by the cube method of balanced sampling.

Targets: sources, in code point order with null last, weigh 5, 2, 1 and so on, and share all words; a target stops at three times its
source's words and the excess is shared again by weight until none is above. Shares are found by repeated sums over the sources,
capping those below their limit, so the number of sources may grow.

Taking: a document of a source with ratio r = target / words is taken floor(r) times, and once more with inclusion probability
r - floor(r). The cube method draws these extras: in a block of documents, probabilities move along a direction in the null-space of the
constraints (number of documents, number of words) until one of them is 0 or 1, with the two ends drawn so that the expectation
stays; at most LANDED documents of a block stay fractional. These meet in fewer and fewer blocks, until each source has one. Its
last LANDED documents land by a draw among the corners of their cube near the balance, with shares whose mean is the probabilities as far
as such corners can carry them: near totals come first, then every document's expectation. Blocks are formed by a hash of the row, so a source
with any share of the rows is spread; random draws come from a seed of the block, so reruns agree.

Defined results: a null text has size 0; documents of size 0 are left out of the draw and of the balanced number, as they change no total; a
document of any length counts whole and never exceeds three times its size; sources without words have target 0; rows equal in doc_id, text
and source are drawn each for itself, numbered under their key; a null doc_id is a value like others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import n_words_of, numbered, settled, table

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Documents of a block of the flight phase, about.
BLOCK = 4000
#: Documents of a source that are landed together: 2^LANDED corners are tried.
LANDED = 14
#: Corners within this share of the expected words are as good as any.
NEAR = 0.04
SEED = 20240
EDGE = 1e-9


def null_direction(sizes: list[float]) -> list[float]:
    """A direction that keeps the number of documents and of words; for up to three documents."""
    if len(sizes) == 3:
        a, b, c = sizes
        u = [c - b, a - c, b - a]
        return u if any(u) else [1.0, -1.0, 0.0]
    return [1.0, -1.0] if len(sizes) == 2 and sizes[0] == sizes[1] else []


def flight(p: np.ndarray, sizes: np.ndarray, draws: np.random.Generator, spared: int = 0) -> np.ndarray:
    """Probabilities after the flight phase: nearly all 0 or 1 but the last `spared`, sums of p and of p * size unchanged."""
    p, sizes = p.astype(float).tolist(), sizes.astype(float).tolist()
    todo = [i for i, x in enumerate(p) if EDGE < x < 1 - EDGE]
    todo = todo[: max(0, len(todo) - spared)]
    held, nxt = [], 0
    coins = iter(draws.random(2 * len(todo) + 4).tolist())
    while True:
        while len(held) < 3 and nxt < len(todo):
            held.append(todo[nxt])
            nxt += 1
        u = null_direction([sizes[i] for i in held])
        if not u:
            break
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(held, u, strict=True) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(held, u, strict=True) if x)
        step = up if next(coins) * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            q = p[i] + step * x
            p[i] = 0.0 if q <= EDGE else 1.0 if q >= 1 - EDGE else q
        held = [i for i in held if 0.0 < p[i] < 1.0]
    return np.array(p)


def landing(p: np.ndarray, sizes: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """The fractional documents, few, on a corner near the balance: within NEAR of the expected words and one of the number, or the nearest.

    Of these the one that can take the largest share is drawn with that share; else the probabilities that remain go on, with one more of
    them 0 or 1. So each document keeps its expectation as long as corners near the balance can carry what remains, else the first lands.
    """
    at = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    q, size, out = p[at].astype(float), sizes[at], np.round(p)
    if not len(at):
        return out
    corners = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1 == 1
    off = np.abs(corners @ size - (q * size).sum())
    far = np.where(np.abs(corners.sum(1) - q.sum()) < 1, off, off + 1e18)
    corners = corners[far <= max(NEAR * (q * size).sum(), far.min())]
    first = None
    while True:
        share = np.where(corners, q, 1 - q).min(1)
        best = int(share.argmax())
        first = corners[best] if first is None else first
        if share[best] <= EDGE:
            out[at] = first
            return out
        if draws.random() < share[best]:
            out[at] = corners[best]
            return out
        q = np.clip((q - share[best] * corners[best]) / (1 - share[best]), 0.0, 1.0)


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="k").sort_values(["h", "key", "dup", "size"], kind="stable").reset_index(drop=True)
        draws = np.random.default_rng([SEED, int(pdf["h"].min()) & 0xFFFFFFFF, len(pdf)])
        p = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), draws, LANDED - 3)
        pdf["p"] = landing(p, pdf["size"].to_numpy(float), draws) if last else p
        return pdf

    return run


def source_targets(sources: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, n, source_size, target for (source, n, source_size) rows."""
    df = settled(numbered(sources, F.col("source").isNull(), F.col("source"), name="place").withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int"))))
    total = df.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    capped = F.lit(False)
    while True:
        r = df.agg(F.sum(F.when(capped, F.lit(limit) * F.col("source_size")).otherwise(0)).alias("used"), F.sum(F.when(capped, 0).otherwise(F.col("w"))).alias("w"), F.sum(capped.cast("long")).alias("n")).first()
        rest, share = total - (r["used"] or 0), r["w"] or 0
        # above its limit: rest * w / share > limit * source_size, in integers
        above = F.lit(rest).cast("decimal(38,0)") * F.col("w") > F.lit(share * limit).cast("decimal(38,0)") * F.col("source_size")
        now = df.agg(F.sum((capped | above).cast("long")).alias("n")).first()["n"] or 0
        if now == (r["n"] or 0):
            break
        capped = capped | above
    target = F.when(capped, (F.lit(limit) * F.col("source_size")).cast("double")).otherwise(F.lit(float(rest)) * F.col("w") / F.lit(float(share or 1)))
    return settled(df.select("source", "n", "source_size", target.alias("target")))


SCHEMA = "s long, key long, dup long, h long, size long, p double"


def row_key(docs: DataFrame) -> Column:
    """Tells apart rows that differ in doc_id, text or source."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"), F.col("source"))


def mixed(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, key, dup (0, 1, .. among rows of equal key), size, source_size, target, copies, taken for each row of (doc_id, text, source)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words_of(F.col("text")).alias("size"), row_key(docs).alias("key"))
    again = W.partitionBy("key").orderBy("size", "source")
    base = settled(base.withColumn("dup", (F.row_number().over(again) - 1).cast("long")))
    sources = base.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, limit).withColumn("s", F.xxhash64("source"))
    known = base.alias("b").join(targets.alias("g"), F.expr("b.source <=> g.source")).select("b.doc_id", "b.key", "b.dup", "b.size", "g.source_size", "g.target", "g.n", "g.s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + EDGE)
    known = settled(known.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), ratio - whole)).withColumn("h", F.xxhash64("key", "dup", F.lit(SEED))))
    counts = targets.select("s", "n")
    largest = counts.agg(F.max("n").alias("n")).first()["n"] or 0
    # flights over blocks, then over the few that stay fractional, until a source has one block
    rest, done, blocks = known.where((F.col("p") > EDGE) & (F.col("size") > 0)).select("s", "key", "dup", "h", "size", "p"), [], -(-largest // block)
    while True:
        spread = rest.join(counts, "s").withColumn("k", F.pmod(F.col("h"), F.least(F.lit(blocks).cast("long"), F.ceil(F.col("n") / block)))) if blocks > 1 else rest.withColumn("k", F.lit(0).cast("long"))
        flown = settled(spread.select("s", "k", "key", "dup", "h", "size", "p").groupBy("s", "k").applyInPandas(_fly(blocks <= 1), SCHEMA))
        if blocks <= 1:
            done.append(flown)
            break
        done.append(flown.where("p = 0 OR p = 1"))
        rest, blocks = flown.where("p > 0 AND p < 1"), blocks // max(2, block // (2 * LANDED))
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.union(d)
    out = known.join(drawn.select("key", "dup", F.col("p").alias("extra")), ["key", "dup"], "left")
    copies = (F.col("whole") + F.coalesce(F.round("extra"), F.lit(0.0))).cast("long")
    return out.select("doc_id", "key", "dup", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
