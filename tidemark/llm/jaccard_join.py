"""Near duplicates by word shingles: exact Jaccard join by a universe partition and the pigeonhole principle.

A document's set holds its distinct 5-word shingles as 64-bit hashes; equal sets are one class, represented by a digest of the set. Two
sets link at Jaccard >= 0.8, that is if their symmetric difference is at most (a + b) / 9 for sizes a and b.

Index. Sizes fall into bands of ratio 1.25, so linked sets lie in the same or in neighbouring bands; group g takes bands g and g + 1. In
a group, a hash of the shingle deals the universe to segments: k0 exact ones, of which a set sends the whole part as one signature, and
k1 one-deletion ones, of which it also sends the part less each one shingle. A pair without a common signature differs by one at
least in each exact segment and by two in each one-deletion segment, but for parts that are (nearly) empty, which are not sent. So with
2 k1 + k0 = H + 1 + slack, where H is the group's largest difference, every linked pair has a common signature if either of its sets
lost no more than `slack` units to empty parts. Sets that lost more send signatures again under other hash seeds, and after the
last seed one signature for the group, so no link is missed. Under the first seed the universe is without the shingles that many documents
have (lines and passages in common), as dropping shingles only lowers a difference; sets made of these lose more than the slack and go on. k0, k1 and the slack are those of least cost: signatures sent, and sets that need
another seed.

Verification. Classes are compared by the exact size of their intersection. Every class is first compared with the one drawn member it
shares most signatures with, which closes most groups of near copies. Classes that share STRONG signatures or more with a drawn member
form families, and families that share MERGED signatures one; in a family that is still in several components, blocks of members are compared as products of 0/1 matrices,
which yields links, not pairs. Pairs across families that share a signature are compared one by one, after an exact filter: the difference
of histograms over 256 hash buckets is a lower bound of the symmetric difference. Pairs inside a component are skipped: their links don't
change component_id.

Defined results: null and blank texts have no shingles and are their own component; fewer than five words are one shingle; repeated rows
are equal sets; rows with a null doc_id have a null component unless linked to others; an empty table gives an empty result; other columns are
ignored. Two sets with one 128-bit digest are taken as equal.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import done_with, release, settled, slices, small, table, unskewed_join, worker_cache
from .wordhash import MIX, WordHashes, mixed, windows

WORDS = 5
#: Sets of sizes a and b link if 9 * |symmetric difference| <= a + b.
FACTOR = 9
RATIO = 1.25
SEEDS = 3
#: A shingle is common if documents of one slice have it OFTEN times, OFTEN_IN_ALL in sum over such slices; the COMMON most frequent count.
OFTEN, OFTEN_IN_ALL, COMMON = 3, 20, 300_000
HISTOGRAM = 256
#: Signatures shared with a drawn member that make a family, those that join families, and members and shingles of a block of a family, about.
STRONG, MERGED, BLOCK, BLOCK_SHINGLES = 3, 4, 1000, 400_000


def shingles(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Arrow's ASCII lower case and white space are those of the rule."""
    h, ends = worker_cache("words", WordHashes).split(column, lower=True)
    every, ends = windows(h, words), ends.tolist()
    runs = [every[a : b - words + 1] if b - a >= words else windows(h[a:b], b - a) if b > a else h[:0] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return list(map(np.unique, runs))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return _signed(x >> 64), _signed(x & (1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_ALL = (1 << 64) - 1


def band(size: int) -> int:
    """Largest b with floor(1.25^b) <= size; integer bounds, so all workers agree."""
    b = int(math.log(size) / math.log(RATIO) + 1e-9)
    while _low(b + 1) <= size:
        b += 1
    while _low(b) > size:
        b -= 1
    return b


def _low(b: int) -> int:
    return math.ceil(RATIO**b - 1e-9)


def allocation(group: int) -> tuple[int, int, int, int]:
    """(k0, k1, slack, H) of a group, of least cost."""
    if group not in _ALLOCATIONS:
        _ALLOCATIONS[group] = _allocation(group)
    return _ALLOCATIONS[group]


_ALLOCATIONS: dict[int, tuple[int, int, int, int]] = {}


def _allocation(group: int) -> tuple[int, int, int, int]:
    low, mid, high = _low(group), _low(group + 1), _low(group + 2) - 1
    if high < low:
        return 0, 0, 0, 0
    most = max((a + min(high, a * RATIO)) // FACTOR for a in {max(low, min(mid, high)), low, high, max(low, int(high / RATIO))})
    size, best = max(1.0, (low + high) / 2), None
    for one in sorted({0, 1, 2, 3, (int(most) + 1) // 4, (int(most) + 2) // 2}):
        for slack in range(0, 4 + int(most) // 4):
            exact = max(0, int(most) + 1 + slack - 2 * one)
            if not exact + one:
                continue
            t = max(1.0, float(low)) / (exact + one)
            empty = math.exp(-t)
            lost = exact * empty + one * (2 * empty + t * empty)
            spread = math.sqrt(exact * empty + one * (4 * empty + t * empty) + 1e-9)
            again = 0.5 * math.erfc((slack + 0.5 - lost) / spread / math.sqrt(2))
            sent = exact + one * (1 + size / (exact + one))
            # small parts are common to many sets by chance: a part of t shingles costs as if sent 1 + e^(3 - t) times
            cost = sent * (1 + math.exp(3 - size / (exact + one))) * (1 + 4 * again)
            if best is None or cost < best[0]:
                best = cost, (exact, one, slack, int(most))
    return best[1]


def signatures(s: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """All signatures of a set, for the groups it belongs to. The first seed's universe is without the common shingles."""
    out, b, rare = [], band(len(s)), s
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = s[common[at] != s]
    for group in (b - 1, b):
        if group < 0 or _low(group + 2) <= _low(group):
            continue
        exact, one, slack, _ = allocation(group)
        k = exact + one
        if not k:
            continue
        for seed in range(SEEDS):
            part_of = s if seed else rare
            salt = np.uint64((group * 64 + seed + 1) * int(MIX) & _ALL)
            h = mixed(part_of ^ salt)
            part = ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            value = mixed(h + MIX)
            sums = np.zeros(k, np.uint64)
            np.add.at(sums, part, value)
            sizes = np.bincount(part, minlength=k)
            tags = mixed(np.arange(k, dtype=np.uint64) + salt)
            whole = sizes > 0
            out.append(mixed(sums[whole] ^ tags[whole]))
            if one:
                single = (part >= exact) & (sizes[part] > 1)
                p = part[single]
                out.append(mixed((sums[p] - value[single]) ^ tags[p]))
            lost = int((sizes[:exact] == 0).sum() + 2 * (sizes[exact:] == 0).sum() + (sizes[exact:] == 1).sum())
            if lost <= slack:
                break
        else:
            out.append(mixed(np.array([group], np.uint64) * MIX + np.uint64(99)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sets(batches):
    """The set's size and digest for each row; and rows (hi, n_shingles) of shingles that several documents of a slice have, with their number."""
    for batch in slices(batches):
        got = shingles(batch.column("text"))
        pairs = [digest(s) if len(s) else (None, None) for s in got]
        ids, sizes, his, los = batch.column("doc_id").to_pylist(), [len(s) for s in got], [p[0] for p in pairs], [p[1] for p in pairs]
        often, times = np.unique(np.concatenate([*got, np.zeros(0, np.uint64)]), return_counts=True)
        often, times = often[times >= OFTEN].view(np.int64).tolist(), times[times >= OFTEN].tolist()
        none = [None] * len(often)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids + none, pa.int64()), pa.array(sizes + times, pa.int64()), pa.array(his + often, pa.int64()), pa.array(los + none, pa.int64()), pa.array([False] * len(ids) + [True] * len(often))],
            names=["doc_id", "n_shingles", "hi", "lo", "often"],
        )


def _index(common):
    """(key, sig, lo), lo naming the class; a slice sends a class only once. common: the sorted shingles that many documents have.

    A signature that several classes of a slice have is known to be shared: all these classes are sent under keys of their own, with the
    signature, and only the first also under the signature, for other slices. So no key has more rows than there are slices.
    """

    def run(batches):
        for batch in slices(batches):
            seen, sigs, los, pending = set(), [], [], 0
            for s in shingles(batch.column("text")):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                sigs.append(signatures(s, common.value))
                los.append(d[1])
                pending += len(sigs[-1])
                if pending > 500_000:
                    yield _keyed(sigs, los)
                    sigs, los, pending = [], [], 0
            if sigs:
                yield _keyed(sigs, los)

    return run


def _keyed(sigs: list[np.ndarray], los: list[int]) -> pa.RecordBatch:
    sig, lo = np.concatenate(sigs), np.repeat(np.array(los, np.int64), list(map(len, sigs)))
    order = np.argsort(sig, kind="stable")
    first = np.r_[True, sig[order][1:] != sig[order][:-1]]
    known, asks = np.zeros((2, len(sig)), bool)
    known[order], asks[order] = ~first | np.r_[~first[1:], False], first
    # rows of a class stay together, which packs well in the exchange
    own = mixed(mixed(sig[known]) ^ lo[known].view(np.uint64))
    keys, n = np.r_[own, sig[asks]].view(np.int64), len(own)
    shared = pa.array(np.r_[sig[known].view(np.int64), np.zeros(asks.sum(), np.int64)], mask=np.arange(len(keys)) >= n)
    return pa.RecordBatch.from_arrays([pa.array(keys), shared, pa.array(np.r_[lo[known], lo[asks]])], names=["key", "sig", "lo"])


def _contents(batches):
    """c, n, hist, s of the rows whose set is the class named by lo."""
    for batch in slices(batches):
        rows = []
        for c, lo, s in zip(batch.column("c").to_pylist(), batch.column("lo").to_pylist(), shingles(batch.column("text")), strict=True):
            if len(s) and digest(s)[1] == lo:
                rows.append((c, s))
        marks = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=HISTOGRAM), 127).astype(np.int8) for _, s in rows]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array(marks, pa.list_(pa.int8())), pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))], names=["c", "n", "hist", "s"])


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between different components in two blocks of a family: a forest of them for each pair of components."""
    pdf = pdf.drop_duplicates(["c", "side"])
    left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
    out: list[tuple[int, int]] = []
    if len(left) and len(right) and pdf["root"].nunique() > 1:
        ls, rs = left["s"].to_list(), right["s"].to_list()
        tokens, at = np.unique(np.concatenate([*ls, *rs]), return_inverse=True)
        ln, rn = np.array([len(x) for x in ls]), np.array([len(x) for x in rs])
        lo, ro = np.repeat(np.arange(len(ls)), ln), np.repeat(np.arange(len(rs)), rn)
        la, ra = at[: ln.sum()], at[ln.sum() :]
        common = np.zeros((len(ls), len(rs)), np.float32)
        for start in range(0, len(tokens), 8192):  # columns of the matrices, a part at a time
            x, y = np.zeros((len(ls), 8192), np.float32), np.zeros((len(rs), 8192), np.float32)
            i, j = (la >= start) & (la < start + 8192), (ra >= start) & (ra < start + 8192)
            x[lo[i], la[i] - start] = 1
            y[ro[j], ra[j] - start] = 1
            common += x @ y.T
        other = left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
        a, b = np.nonzero(other & (180 * common.astype(np.int64) >= 80 * (ln[:, None] + rn[None, :])))
        joined: dict[int, int] = {}

        def top(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for u, v, ru, rv in zip(left["c"].to_numpy()[a].tolist(), right["c"].to_numpy()[b].tolist(), left["root"].to_numpy()[a].tolist(), right["root"].to_numpy()[b].tolist(), strict=True):
            p, q = top(ru), top(rv)
            if p != q:
                joined[p] = q
                out.append((u, v))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


SIZES_LINK = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)"
HISTOGRAMS_LINK = f"{FACTOR} * aggregate(zip_with(ha, hb, (x, y) -> abs(CAST(x AS INT) - CAST(y AS INT))), 0, (t, x) -> t + x) <= na + nb"


def verified(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The (a, b) that link, after the histograms' filter. Intersection o: 100 o >= 80 (n + m - o)."""
    mark = lambda k: content.select(F.col("c").alias(k), F.col("n").alias("n" + k), F.col("hist").alias("h" + k))
    pairs = settled(pairs.select("a", "b").join(mark("a"), "a").join(mark("b"), "b").where(HISTOGRAMS_LINK).select("a", "b").distinct())
    # sets are sent only for the pairs left: those of a with each pair, those of b once
    left = content.select(F.col("c").alias("a"), F.col("s").alias("sa")).join(small(pairs), "a")
    right = content.select(F.col("c").alias("b"), F.col("s").alias("sb")).join(small(settled(pairs.select("b").distinct())), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return left.join(right, "b").where(F.expr("180") * common >= 80 * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(c, root): smallest member of the component for each end of the links. Stars of ever smaller centres, until nothing changes."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # large star: neighbours above u go to u's smallest neighbour
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = settled(small)
        sums = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for d in (edges, after)]
        done_with(edges)
        edges = after
        if sums[0] == sums[1]:
            return edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("root"))


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(c) with its root."""
    return nodes.join(components(links), "c", "left").withColumn("root", F.coalesce("root", "c"))


def classes(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n_shingles, hi, lo: the set's size and digest for each row; and the common shingles, sorted, COMMON at most."""
    both = settled(_binary(docs).mapInArrow(_sets, "doc_id long, n_shingles long, hi long, lo long, often boolean"))
    counts = both.where("often").groupBy("hi").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= OFTEN_IN_ALL)
    top = counts.orderBy(F.desc("n"), "hi").limit(COMMON).select("hi").toPandas()["hi"].to_numpy(dtype=np.int64)
    return both.where("NOT often").drop("often"), np.sort(top.view(np.uint64))


def shared_signatures(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(sig, lo) of the signatures that several classes have."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    rows = _binary(docs).mapInArrow(_index(sent), "key long, sig long, lo long")
    # one exchange: the classes of a signature lie together, and those that are alone in it end here
    w = W.partitionBy("key")
    found = rows.withColumn("x", F.min("lo").over(w)).withColumn("y", F.max("lo").over(w)).where("sig IS NOT NULL OR x <> y")
    return settled(found.select(F.coalesce("sig", "key").alias("sig"), "lo").distinct())


def with_extremes(member: DataFrame, **columns: Column) -> DataFrame:
    """member with aggregates of its signatures' rows: summed before the exchange and joined, as a window can't split a signature that many classes have."""
    per = member.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in columns.items()]).where("_n > 1").drop("_n")
    return member.join(per, "sig")


def merged_families(member: DataFrame, families: DataFrame) -> DataFrame:
    """(c, fam) after joining families that share MERGED signatures or more with one that comes first in them."""
    held = with_extremes(member.select("sig", "c").join(small(families), "c").select("sig", "fam"), f0=F.min("fam"))
    ties = held.where("fam <> f0").distinct().groupBy(F.col("fam").alias("a"), F.col("f0").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    to = _roots(families.select(F.col("fam").alias("c")).distinct(), settled(ties.where(F.col("times") >= MERGED).select("a", "b")))
    return families.join(to.select(F.col("c").alias("fam"), F.col("root").alias("to")), "fam").select("c", F.col("to").alias("fam"))


def family_links(content: DataFrame, families: DataFrame, roots: DataFrame) -> DataFrame:
    """Links inside the families (c, fam) that are in several components."""
    held = families.join(roots, "c").join(content.select("c", "n"), "c")
    sizes = held.groupBy("fam").agg(F.countDistinct("root").alias("k"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("t")).where("k > 1")
    blocks = sizes.select("fam", F.greatest(F.ceil(F.col("g") / BLOCK), F.ceil(F.col("t") / BLOCK_SHINGLES)).alias("blocks"))
    placed = families.join(blocks, "fam").join(roots, "c").withColumn("me", F.pmod(F.xxhash64("c"), F.col("blocks")))
    # a member goes to each pair of blocks that holds its own, as left (0), right (1), or both where the blocks are one (2)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("me", o).alias("i"), F.greatest("me", o).alias("j"), F.when(o == F.col("me"), 2).when(F.col("me") < o, 0).otherwise(1).alias("side")))
    dealt = placed.select("c", "fam", "root", F.explode(pair).alias("p")).select("c", "fam", "root", "p.*")
    return content.select("c", "s").join(small(settled(dealt)), "c").groupBy("fam", "i", "j").applyInPandas(_product, "a long, b long")


def class_links(docs: DataFrame, sets: DataFrame, common: np.ndarray) -> DataFrame | None:
    """Links (a, b) between classes, named by their representatives' doc_id; enough of them for the components."""
    shared = shared_signatures(docs, common)
    release(docs.sparkSession)
    firsts = sets.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("c")).where("c IS NOT NULL")
    # half of the digest names a class in the index: should two classes share it, both are members
    reps = settled(firsts.join(shared.select("lo").distinct(), "lo", "left_semi").select("lo", "c"))
    if reps.isEmpty():
        return None
    ids = reps.select(F.col("c").alias("doc_id"), "lo")
    texts = _binary(docs).join(small(ids), "doc_id").select(F.col("doc_id").alias("c"), "lo", "text")
    content = settled(texts.mapInArrow(_contents, "c long, n long, hist array<tinyint>, s array<long>"))
    nodes = settled(content.select("c", "n").distinct())
    named = settled(reps.join(nodes, "c"))
    member = settled(shared.join(small(named), "lo").select("sig", "c", "n"))
    drawn = with_extremes(member, m=F.min(F.struct(F.xxhash64("c").alias("h"), "c", "n")))
    met = drawn.where("m.c <> c AND 5 * least(n, m.n) >= 4 * greatest(n, m.n)").groupBy("c", F.col("m.c").alias("m")).agg(F.count(F.lit(1)).alias("times"))
    met = settled(met.where(F.col("times") >= STRONG))
    best = met.groupBy("c").agg(F.max_by("m", F.struct("times", "m")).alias("m")).select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()
    links = settled(verified(best, content))
    release(docs.sparkSession)
    roots = settled(_roots(nodes.select("c"), links))
    families = settled(_roots(nodes.select("c"), met.select(F.col("c").alias("a"), F.col("m").alias("b"))).withColumnRenamed("root", "fam"))
    families = settled(merged_families(member, families))
    links = settled(links.union(family_links(content, families, roots)))
    release(docs.sparkSession)
    roots = _roots(nodes.select("c"), links).withColumnRenamed("root", "r")
    known = settled(roots.join(families, "c"))
    among = {"r0": F.min("r"), "r1": F.max("r"), "f0": F.min("fam"), "f1": F.max("fam")}
    rest = settled(with_extremes(member.join(small(known), "c"), **among).where("r0 <> r1 AND f0 <> f1").drop(*among))
    both = rest.alias("x").join(rest.alias("y"), F.expr(f"x.sig = y.sig AND x.c < y.c AND x.r <> y.r AND x.fam <> y.fam AND {SIZES_LINK}"))
    pairs = both.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    return settled(links.union(verified(pairs, content)))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of (doc_id, text)."""
    sets, common = classes(docs)
    links = class_links(docs, sets, common)
    first = sets.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("c"), F.count(F.lit(1)).alias("rows"))
    if links is not None:
        # the smallest representative of a component is its smallest document
        first = first.join(components(links), "c", "left").select("hi", "lo", F.coalesce("root", "c").alias("c"), "rows")
    out = unskewed_join(sets, settled(first), ["hi", "lo"], "rows")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
