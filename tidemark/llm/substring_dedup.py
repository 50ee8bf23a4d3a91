"""Removal of long repeated passages with suffix automata of reference shards.

A window of 50 words is removed if its words also start, as a window, in a document with a smaller doc_id.

1. Anchors. The smallest hash of the 8-word grams in a window is the same wherever the window stands. Anchors that two documents share
   mark the windows worth looking at; all other text ends here.
2. References. Hashes of these windows find the first document of each, and the place there; runs of windows in their first documents are
   the references, each distinct passage about once.
3. Matching. References are cut into shards of bounded size by the hash of their document and by their place in it. A suffix automaton of
   each shard is built where the shard's documents are streamed (for a shard with very many segments in several places): the longest match
   that ends at each word, and the smallest doc_id it occurs in, decide about the window that ends there, word for word.
4. The words covered by such windows go.

Within a slice of rows, anchors and windows that several documents have are resolved at once and only the first is sent on under its hash,
so a passage that a third of all documents share is a row for each slice, not for each document.

Defined results: null and blank texts have no words; texts of any length are read whole; rows with a null doc_id are kept whole and are no
reference; rows of one doc_id are the same document, so they don't count as earlier for each other, whether their texts are equal or
not, and each is judged by its own text; an empty table gives an empty result; other columns are ignored. Texts of one doc_id with equal
64-bit hashes are taken as equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import done_with, settled, slices, small, table, worker_cache
from .wordhash import WordHashes, mixed, windows

WINDOW = 50
GRAM = 8
#: Reference words of a shard, and words of segments streamed through one copy of its automaton, about.
SHARD_WORDS, STREAM_WORDS = 40_000, 400_000


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values, by doubling."""
    m, k = g, 1
    while 2 * k <= n:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    size = len(g) - n + 1
    return np.minimum(m[:size], m[n - k : n - k + size])


def anchors(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The anchor of each window."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    gram = min(GRAM, window)
    return sliding_min(windows(h, gram), window - gram + 1)


class Automaton:
    """Suffix automaton of several word sequences; each state knows the smallest doc_id its strings occur in."""

    def __init__(self):
        self.go, self.link, self.size, self.first = [{}], [-1], [0], [1 << 63]

    def _state(self, go: dict, link: int, size: int, first: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.go) - 1

    def _split(self, p: int, w, q: int) -> int:
        """The part of state q that is one word longer than p, as a state of its own."""
        copy = self._state(dict(self.go[q]), self.link[q], self.size[p] + 1, self.first[q])
        self.link[q] = copy
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, words, doc: int) -> None:
        go, link, size = self.go, self.link, self.size
        last = 0
        for w in words:
            q = go[last].get(w)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, w, q)
                self.first[last] = min(self.first[last], doc)
                continue
            new, p = self._state({}, 0, size[last] + 1, doc), last
            while p >= 0 and w not in go[p]:
                go[p][w] = new
                p = link[p]
            if p >= 0:
                q = go[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
            last = new

    def close(self) -> None:
        """Carries the smallest doc_ids to the shorter strings."""
        for s in sorted(range(1, len(self.go)), key=self.size.__getitem__, reverse=True):
            up = self.link[s]
            if self.first[s] < self.first[up]:
                self.first[up] = self.first[s]

    def repeats(self, words, doc: int, window: int) -> list[int]:
        """Ends of the windows of the words that occur in a document before doc."""
        go, link, size, first = self.go, self.link, self.size, self.first
        state, length, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in go[state]:
                state = link[state]
                length = size[state]
            state = go[state].get(w, 0)
            length = length + 1 if state else 0
            if length >= window:
                at = state
                while size[link[at]] >= window:
                    at = link[at]
                # strings of a state share their occurrences, so the window's are those of its state
                if first[at] < doc:
                    out.append(i)
                state, length = at, min(length, size[at])
        return out


def _binary(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), text; (doc_id, t) tells apart the texts of one doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))


def _slices(batches):
    """Slices of rows with the hashes of their words: (slice, hashes, ends)."""
    for batch in slices(batches):
        h, ends = worker_cache("words", WordHashes).split(batch.column("text"))
        yield batch, h, ends.tolist()


def _send_anchors(window):
    """anchor, doc_id, known: anchors that several documents of a slice have are known to be shared; their first document also asks for others."""

    def run(batches):
        for batch, h, ends in _slices(batches):
            found, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                if doc is not None and b - a >= window:
                    found.append(np.unique(anchors(h[a:b], window)))
                    ids.append(np.full(len(found[-1]), doc, np.int64))
            anchor, doc = np.concatenate(found), np.concatenate(ids)
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            first = np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
            group = np.cumsum(first) - 1
            known = (doc[first] < doc[np.r_[np.flatnonzero(first)[1:], len(doc)] - 1])[group] if len(doc) else first
            asks = first
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[anchor[known], anchor[asks]].view(np.int64)), pa.array(np.r_[doc[known], doc[asks]]), pa.array(np.arange(known.sum() + asks.sum()) < known.sum())], names=["anchor", "doc_id", "known"])

    return run


def _send_windows(window):
    """key, doc_id, t, start, first, at, ref: windows with a shared anchor. Those with an earlier document in the slice carry it, their place in it and a key of their own."""

    def run(batches):
        for batch, h, ends in _slices(batches):
            keys, docs, texts, starts = [], [], [], []
            for doc, t, a, b, shared in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), ends[:-1], ends[1:], batch.column("anchors"), strict=True):
                at = np.flatnonzero(np.isin(anchors(h[a:b], window), shared.values.to_numpy().view(np.uint64)))
                keys.append(windows(h[a:b], window)[at])
                docs.append(np.full(len(at), doc, np.int64))
                texts.append(np.full(len(at), t, np.int64))
                starts.append(at)
            if not sum(map(len, keys)):
                continue
            key, doc, text, start = np.concatenate(keys), np.concatenate(docs), np.concatenate(texts), np.concatenate(starts).astype(np.int32)
            order = np.lexsort((start, text, doc, key))
            new = np.r_[True, key[order][1:] != key[order][:-1]]
            group = np.zeros(len(key), np.int64)
            # each row's group and the group's first row; rows stay in their order, which packs well in the exchange
            group[order] = np.cumsum(new) - 1
            low = order[new][group]
            known = doc[low] < doc
            ref = ~known & (np.bincount(group, weights=known) > 0)[group]
            own = mixed(mixed(mixed(doc.view(np.uint64)) + text.view(np.uint64)) + start.astype(np.uint64))
            key = np.where(known, own, key).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(text), pa.array(start), pa.array(doc[low], mask=~known), pa.array(start[low], mask=~known), pa.array(ref)], names=["key", "doc_id", "t", "start", "first", "at", "ref"])

    return run


def _send_segments(window):
    """first, block, doc_id, t, start, ref, words for each run of windows of a text."""
    schema = pa.schema([("first", pa.int64()), ("block", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("ref", pa.bool_()), ("words", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc, t, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "text", "runs")), strict=True):
                words = text.split()
                rows += [(r["first"], r["block"], doc, t, r["s"], r["first"] == doc, b" ".join(words[r["s"] : r["e"] + window])) for r in runs]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return run


def _match(window):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton()
        refs = pdf[pdf["ref"]]
        for doc, words in zip(refs["doc_id"], refs["words"], strict=True):
            automaton.add(words.split(), doc)
        automaton.close()
        spans = []
        streamed = pdf[~pdf["ref"]]
        for doc, t, start, words in zip(streamed["doc_id"], streamed["t"], streamed["start"], streamed["words"], strict=True):
            for end in automaton.repeats(words.split(), doc, window):
                low, high = start + end - window + 1, start + end + 1
                if spans and spans[-1][0] == doc and spans[-1][1] == t and spans[-1][3] >= low >= spans[-1][2]:
                    spans[-1][3] = high
                else:
                    spans.append([doc, t, low, high])
        return pd.DataFrame(spans, columns=["doc_id", "t", "low", "high"])

    return run


def _remove(batches):
    for batch in slices(batches):
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            kept = words
            if spans:
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["low"] : s["high"]] = False
                kept = [words[i] for i in np.flatnonzero(keep)]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, spans): word ranges [low, high) to remove, for the texts that have any."""
    rows = settled(_binary(docs).mapInArrow(_send_anchors(window), "anchor long, doc_id long, known boolean"))
    asks = rows.where("NOT known")
    shared = asks.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    both = rows.where("known").select("doc_id", "anchor").unionByName(asks.join(shared, "anchor").select("doc_id", "anchor"))
    marked = settled(both.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    # a text repeated under its doc_id is looked at once
    texts = settled(_binary(docs).join(small(marked, "anchors"), "doc_id").dropDuplicates(["doc_id", "t"]))
    sent = texts.mapInArrow(_send_windows(window), "key long, doc_id long, t long, start int, first long, at int, ref boolean")
    w = W.partitionBy("key")
    found = sent.withColumn("low", F.min(F.struct("doc_id", "start")).over(w)).withColumn("high", F.max("doc_id").over(w))
    found = found.withColumn("at", F.coalesce("at", "low.start")).withColumn("first", F.coalesce("first", "low.doc_id"))
    own = F.col("ref") | ((F.col("first") == F.col("doc_id")) & (F.col("high") > F.col("doc_id")))
    mine = F.struct(F.col("doc_id").alias("first"), F.col("start").alias("at"))
    roles = F.array_compact(F.array(F.when(own, mine), F.when(F.col("first") < F.col("doc_id"), F.struct("first", "at"))))
    found = found.select("doc_id", "t", "start", F.explode(roles).alias("r")).select("doc_id", "t", "start", "r.first", F.floor(F.col("r.at") / SHARD_WORDS).cast("int").alias("block"))
    line = W.partitionBy("doc_id", "t", "first", "block").orderBy("start")
    runs = found.withColumn("d", F.col("start") - F.row_number().over(line)).groupBy("doc_id", "t", "first", "block", "d").agg(F.min("start").alias("s"), F.max("start").alias("e"))
    runs = settled(runs.drop("d"))
    done_with(rows, marked)
    size = F.col("e") - F.col("s") + window
    total = runs.agg(F.sum(F.when(F.col("first") == F.col("doc_id"), size)).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("first", "block", F.lit("shard")), F.lit(shards))
    load = runs.where("first < doc_id").groupBy(shard.alias("shard")).agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / STREAM_WORDS)).alias("copies"))
    per = settled(runs.groupBy("doc_id", "t").agg(F.collect_list(F.struct("first", "block", "s", "e")).alias("runs")))
    parts = texts.select("doc_id", "t", "text").join(small(per, "runs"), ["doc_id", "t"]).mapInArrow(_send_segments(window), "first long, block int, doc_id long, t long, start int, ref boolean, words binary")
    dealt = parts.withColumn("shard", shard).join(load, "shard")
    copy = F.when(F.col("ref"), F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("copies"))))
    dealt = dealt.select("shard", F.explode(copy).alias("copy"), "doc_id", "t", "start", "ref", "words")
    spans = dealt.groupBy("shard", "copy").applyInPandas(_match(window), "doc_id long, t long, low int, high int")
    out = settled(spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    done_with(texts, runs, per)
    return out


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by a space) for each row of (doc_id, text)."""
    spans = repeated_spans(docs, window)
    return _binary(docs).join(small(spans, "spans"), ["doc_id", "t"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: sha256(array_to_string(w[i:i + {WINDOW - 1}], ' '))) ELSE [] END) AS s,
  unnest(CASE WHEN len(w) >= {WINDOW} THEN range(1, len(w) - {WINDOW} + 2) ELSE [] END) AS i FROM t),
m AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS f FROM g) WHERE f < doc_id),
p AS (SELECT DISTINCT doc_id, i + o AS p FROM m, range({WINDOW}) r(o)),
x AS (SELECT t.doc_id, w, coalesce(list(p.p) FILTER (p.p IS NOT NULL), []) AS gone FROM t LEFT JOIN p USING (doc_id) GROUP BY t.doc_id, w)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]), ' ')) AS kept_sha256 FROM x
"""
