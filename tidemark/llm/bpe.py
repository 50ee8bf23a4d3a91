"""BPE encoding and decoding by speculation and verification.

The tokenizer file gives normaliser, splitting rule, vocabulary and merges. For the distinct words of a batch, a greedy longest match
proposes tokens. A proposal is the BPE result if each token is the result of its own characters and each two neighbours are compatible:
undoing the later merge on either side of their border step by step, no merge across the border ever comes first. All pairs of a batch
are tested at once on arrays; only words with a failing pair are merged exactly, with a heap. Blanks end words and no rule looks across
them, so the distinct runs of non-blank bytes of a slice are split to words, the distinct words are encoded, and tokens are dealt to the
places of the runs, all on arrays. A worker keeps the tokens of about KEPT_BYTES of words.

Decoding follows the file: without a decoder the tokens are joined by one space.

Defined results: null and empty texts have no tokens, and the digests of empty strings; the added tokens' strings in a text become their
ids; any length of text or word is processed whole; repeated rows each get their row; an empty table gives an empty result; other
columns are ignored. Only maps over rows: there is no exchange.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, worker_cache
from .wordhash import Split

VOCABULARY = "word_bpe_49k.json"
#: Bytes of words and their tokens that a worker keeps, about, and what a word takes besides; the most frequent words come first.
KEPT_BYTES, WORD_BYTES = 40_000_000, 150
#: Symbols up to which a word is merged by scanning a list.
SHORT, NEVER = 48, 1 << 60
#: Printable ASCII is its own byte-level form; the file's splitting rule for it, after lower-casing.
PLAIN = r"^[!-~]+$"
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
PLAIN_RULES = json.dumps(
    [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ],
    sort_keys=True,
)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder for one tokenizer file with BPE merges and an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        #: a word that stands for an added token; no byte-level word has a zero
        self.marks = {c: f"\0{i}" for c, i in self.added.items()}
        self.added_by_mark = {f"\0{i}": i for i in self.added.values()}
        # the short way for ASCII holds for files with these rules
        self.plain = json.dumps([spec["normalizer"], spec["pre_tokenizer"]], sort_keys=True) == PLAIN_RULES and all(c.startswith("<|") for c in self.added)
        self.special = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) or r"(?!)")
        names = {**self.ids, **self.added}
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        n = self.n = len(self.names)
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.merge = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(pairs)}
        keys = np.array([a * n + b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order.astype(np.int64)
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        for rank, (a, b, made) in enumerate(pairs):
            self.rank[made], self.left[made], self.right[made] = rank, a, b
        sound, k = self.sound_tokens(), len(self.suffix)
        #: sound tokens by their text, inside and at the end of a word
        self.inner = {t: i for t, i in self.ids.items() if sound[i] and not (k and t.endswith(self.suffix))}
        self.last = {t[:-k] if k else t: i for t, i in self.ids.items() if sound[i] and t.endswith(self.suffix)}
        self.longest = max(map(len, self.ids))
        #: length of the longest inner token that begins with these three characters
        self.reach: dict[str, int] = {}
        for t in self.inner:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.decimal, self.texts = pa.array(map(str, range(n)), pa.string()), pa.array(self.names, pa.string())
        #: the words that are kept, numbered, and their tokens one after the other
        self.known: dict[str, int] = {}
        self.sizes, self.tokens, self.held = array("i"), array("i"), 0

    def symbols(self, word: str) -> list[int]:
        """Ids of the single characters, the last with the suffix; unknown ones are left out."""
        parts = [*word[:-1], word[-1] + self.suffix]
        return [self.ids[p] for p in parts if p in self.ids]

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging: lowest rank first, then leftmost."""
        return self._merged_short(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        ids, none = list(ids), (NEVER, -1)
        get = self.merge.get
        best = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while best:
            first = min(best)
            if first is none or first[0] == NEVER:
                break
            i = best.index(first)
            ids[i : i + 2] = [first[1]]
            del best[i]
            if i:
                best[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(best):
                best[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """With a heap, for words of any length."""
        ids = list(ids)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            if i >= 0 and after[i] < n and (m := self.merge.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def sound_tokens(self) -> np.ndarray:
        """Whether each token is the BPE result of its own characters: so are its parts, and nothing crosses their border before its own merge."""
        made = np.flatnonzero(self.rank >= 0)
        alone = np.ones(self.n, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            alone[t] &= alone[self.left[t]] & alone[self.right[t]]
        return alone

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest match, or None where it finds no way."""
        whole = self.last.get(word)
        if whole is not None:
            return [whole]
        out, i, n, inner, last, longest, reach = [], 0, len(word), self.inner.get, self.last.get, self.longest, self.reach.get
        while i < n:
            if n - i <= longest and (token := last(word[i:])) is not None:
                out.append(token)
                return out
            for j in range(min(n - 1, i + reach(word[i : i + 3], 2)), i, -1):
                token = inner(word[i:j])
                if token is not None:
                    out.append(token)
                    i = j
                    break
            else:
                return None
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For pairs of neighbours: does BPE leave the border between them, at least up to the merge `limit`?"""
        x, y = x.copy(), y.copy()
        good, live = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), np.iinfo(np.int64).max) if limit is None else limit.copy()
        while len(live):
            a, b, key = x[live], y[live], x[live] * self.n + y[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crosses = (self.keys[at] == key) & (self.key_ranks[at] < limit[live])
            good[live[crosses]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo_left = ra > rb
            on = ~crosses & ((ra >= 0) | (rb >= 0))
            # merges on the left of the border come before an equal one across it, those on its right after it
            limit[live] = np.where(undo_left, ra, rb + 1)
            x[live], y[live] = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            live = live[on]
        return good

    def learn(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        out = list(map(self.proposed, words))
        exact = [i for i, p in enumerate(out) if p is None]
        guessed = [i for i, p in enumerate(out) if p is not None and len(p) > 1]
        if guessed:
            sizes = np.array([len(out[i]) for i in guessed])
            flat = np.fromiter((t for i in guessed for t in out[i]), dtype=np.int64, count=int(sizes.sum()))
            word = np.repeat(np.array(guessed), sizes)
            inner = word[:-1] == word[1:]
            pairs, where = np.unique(flat[:-1][inner] * self.n + flat[1:][inner], return_inverse=True)
            bad = ~self.compatible(pairs // self.n, pairs % self.n)[where]
            exact += np.unique(word[:-1][inner][bad]).tolist()
        for i in exact:
            out[i] = [self.added_by_mark[words[i]]] if words[i] in self.added_by_mark else self.merged(self.symbols(words[i]))
        return out

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, tokens): word i has `size[i]` of the tokens from begin[i] on."""
        number = np.fromiter((self.known.get(w, -1) for w in words), np.int64, count=len(words))
        fresh = np.flatnonzero(number < 0)
        learned = self.learn([words[i] for i in fresh])
        sizes = np.r_[np.array(self.sizes, np.int64), np.array(list(map(len, learned)), np.int64)]
        tokens = np.r_[np.array(self.tokens, np.int32), np.fromiter((t for p in learned for t in p), np.int32)]
        number[fresh] = len(self.sizes) + np.arange(len(fresh))
        begin = np.cumsum(sizes) - sizes
        for i, p in zip(fresh, learned, strict=True):
            if self.held >= KEPT_BYTES:
                break
            self.known[words[i]] = len(self.sizes)
            self.sizes.append(len(p))
            self.tokens.extend(p)
            self.held += WORD_BYTES + len(words[i]) + 4 * len(p)
        return begin[number], sizes[number], tokens

    def pieces(self, text: str) -> list[str]:
        """Words of a run without blanks, after normalising and splitting; an added token is its mark."""
        out, end = [], 0

        def plain(part: str):
            if part:
                out.extend(w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)) if w)

        for m in self.special.finditer(text):
            plain(text[end : m.start()])
            out.append(self.marks[m.group()])
            end = m.end()
        plain(text[end:])
        return out

    def all_pieces(self, runs: list[str]) -> list[list[str]]:
        """The same for many runs, in one call of the splitting rule where a blank between them changes nothing."""
        out: list[list[str]] = [[] for _ in runs]
        alone = [i for i, r in enumerate(runs) if BLANK.search(r) or self.special.search(r)]
        some = sorted(set(range(len(runs))) - set(alone))
        text = self.normalizer.normalize_str(" ".join([runs[i] for i in some]))
        if text.count(" ") != max(0, len(some) - 1):
            some, alone = [], range(len(runs))
        if some:
            starts = np.cumsum([0] + [len(t) + 1 for t in text.split(" ")])
            got = self.splitter.pre_tokenize_str(text)
            for i, (w, _) in zip(np.searchsorted(starts, [at for _, (at, _) in got], "right") - 1, got, strict=True):
                if w:
                    out[some[i]].append(w)
        for i in alone:
            out[i] = self.pieces(runs[i])
        return out

    def words_of(self, runs: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(words, begin, size, codes): run i has `size[i]` words, numbered by the codes from begin[i] on."""
        plain = np.zeros(len(runs), bool)
        if self.plain and len(runs):
            plain = pc.and_not(pc.match_substring_regex(runs, PLAIN), pc.match_substring(runs, "<|")).to_numpy(zero_copy_only=False)
        parts = Split(pc.replace_substring_regex(pc.ascii_lower(runs.filter(pa.array(plain))), PLAIN_PIECES, r"\0 "))
        words = parts.distinct.to_pylist()
        size, codes = np.zeros(len(runs), np.int64), [parts.codes]
        size[plain] = parts.sizes()
        number = {w: i for i, w in enumerate(words)}
        other = self.all_pieces(runs.filter(pa.array(~plain)).to_pylist())
        size[~plain] = list(map(len, other))
        codes.append(np.fromiter((number.setdefault(w, len(number)) for p in other for w in p), np.int64))
        begin = np.zeros(len(runs), np.int64)
        begin[plain] = parts.ends[:-1]
        begin[~plain] = len(parts.codes) + np.cumsum(size[~plain]) - size[~plain]
        return list(number), begin, size, np.concatenate(codes)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """For each text the number of its tokens, and the digests of its ids and of its decoded text."""
        split = Split(texts)
        words, begin, size, codes = self.words_of(split.distinct)
        codes, words_to = dealt(begin, size, codes, np.arange(len(begin)))
        tokens, tokens_to = dealt(*self.tokens_of(words), codes)
        run_ends = tokens_to[words_to]
        ids, to = dealt(run_ends[:-1], np.diff(run_ends), tokens, split.codes)
        ends = to[split.ends]
        return np.diff(ends), digests(self.decimal, ids, ends), digests(self.texts, ids, ends)


def dealt(begin: np.ndarray, size: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the codes one after the other, ends): code i stands for the `size[i]` values from begin[i] on."""
    n = size[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(n, dtype=np.int64)]
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - (begin[codes] if len(codes) else 0), n)
    return values[at], ends


def digests(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """SHA-256 of each row's names joined by a blank; row i has the ids from ends[i] to ends[i + 1]."""
    out, row = [], 0
    while row < len(ends) - 1:  # so many rows at a time as have about JOINED ids
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + JOINED, "right")) - 1)
        lists = pa.LargeListArray.from_arrays(pa.array(ends[row : stop + 1] - ends[row]), names.take(pa.array(ids[ends[row] : ends[stop]])))
        joined = pc.binary_join(lists, " ").cast(pa.large_binary())
        at, data = np.frombuffer(joined.buffers()[1], np.int64, stop - row + 1), memoryview(joined.buffers()[2] or b"")
        out += [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        row = stop
    return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tokens joined at a time, about.
JOINED = 300_000
#: What any rule may take for a blank.
BLANK = re.compile(r"\s")


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens and the digests of ids and decoded text for each row of (doc_id, text). vocabulary: a file of the public tokenizers, or a path on the executors."""

    def run(batches):
        codec = worker_cache(f"bpe {vocabulary}", lambda: Codec(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary)))
        for batch in slices(batches):
            n, ids, decoded = codec.encode_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
