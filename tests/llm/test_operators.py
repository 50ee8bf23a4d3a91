"""Corpus operators against SQL or brute force, on the test tables and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, mixing, pii, quality_classifier, quality_rules, queries, sharding, substring_dedup, topk, url_trust

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, extra string, w string, c long"


def awkward():
    """Nulls, blanks, ties, repeats, very long texts, clashing extra columns."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "Ünï", "🙂", "it's", "don't,", "A|B", "x@y.org", "1.2.3.4"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(120)
    long = text(20_000)
    texts = [None, "", " \t\n", "one", "one two three four", "ONE two Three four five", base, base, base.upper(), base + " tail", text(40) + " " + base, long, long + " end", "a" * 50_000, text(9), text(10), "x\ny\nx\nx\n\n", "\x1c\x85\xa0 　 z"]
    texts += [base[:200] + " " + text(100) for _ in range(5)] + [text(rng.randint(5, 80)) for _ in range(30)]
    rows = [(i, t, rng.choice(["a", "b", None, "c"]), "e", "w", 1) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], rows[0], (None, base, "a", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall((t or "").encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck(queries.ORACLE[name]))


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))


# --- 1


def test_url_awkward(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "HTTP://WWW.Example.COM/en/7?x#y", None), (4, "http://evil.com/en/", '<a href="http://friend.net/x">'), (4, "http://evil.com/en/", None), (5, "http://friend.net/x", None), (6, "http://x.de://y/z", None), (None, "http://a.net/de/1", None), (7, "://h", None), (8, "http://com/en/\n", None)]
    out = url_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[1] == (1, "", "", None, "allow") and by[2][1:3] == ("", "") and by[3] == (3, "www.example.com", "/en/7", "example.com/en/7", "allow")
    assert by[4][3:] == ("com/en/", "block") and by[6][1] == "x.de:" and by[7][1:3] == ("h", "") and by[None][3] == "net/de/"
    assert url_trust.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_distrust_goes_against_links(spark):
    rows = [(1, "http://bad.org/es/1", ""), (2, "http://feeder.fr/", '<a class="x" href="http://bad.org/q">'), (3, "http://good.net/de/", '<a href="//liked.fr/">'), (4, "http://liked.fr/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_url_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = [(0, "http://bad.org/es/1", ""), (1, "http://h1.fr/", '<a href="http://bad.org/">')] + [(i, f"http://h{i}.fr/", f'<a href="http://h{i - 1}.fr/">') for i in range(2, 31)]
    got = {r["page_id"]: r["verdict"] for r in url_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(31), "block")


# --- 2


def rule_base(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_awkward(docs, empty):
    out = quality_rules.judged(docs)
    have = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out.collect())
    assert have == collections.Counter((r[0], *rule_base(r[1])) for r in awkward())
    assert all(not r["kept"] for r in out.collect() if r["base_failed"])
    assert quality_rules.judged(empty).count() == 0


def test_rules_order_does_not_matter(docs):
    based = quality_rules.base_columns(docs)
    names = list(quality_rules.RULES)
    a, b = (based.select("doc_id", quality_rules.rejected_by(o).isNull().alias("kept")) for o in (names, names[::-1]))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_rules_order_follows_cost_and_rejections(spark):
    """Of rules that reject alike the cheap one comes first, of rules of like cost the one that rejects more."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(300)) + "!" * (i % 10)) for i in range(200)], "doc_id long, text string")
    hard = lambda c: F.size(F.array_distinct(F.transform("w", lambda x: F.sha2(F.concat(x, F.col("text")), 512)))) + c > 0
    rules = {"dear": lambda: hard(F.col("doc_id")) & (F.col("doc_id") % 2 == 0), "cheap": lambda: F.col("doc_id") % 2 == 0, "seldom": lambda: F.col("doc_id") % 20 == 0}
    based = quality_rules.base_columns(docs).cache()
    assert quality_rules.order_rules(based, rules) == ["cheap", "seldom", "dear"]


# --- 3


def water_fill(sizes, weights=(5, 2, 1), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, share = total - sum(limit * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        t = {s: limit * sizes[s] if s in capped else rest * w[s] / share for s in order}
        more = {s for s in order if s not in capped and t[s] > limit * sizes[s]}
        if not more:
            return t
        capped |= more


def test_mixing(spark, docs, empty):
    for df in (docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = mixing.mixed(df).collect()
        again = mixing.mixed(df.repartition(7)).collect()
        key = lambda r: (r["key"], r["dup"])
        assert [tuple(r) for r in sorted(rows, key=key)] == [tuple(r) for r in sorted(again, key=key)]
        sizes = collections.Counter()
        for r in df.select("source", "text").collect():
            sizes[r["source"]] += len(words(r["text"]))
        targets = water_fill(sizes)
        assert len(rows) == df.count()
        by_size = collections.defaultdict(lambda: [0, 0])
        for r in rows:
            assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
            by_size[r["source_size"], round(r["target"], 6)][0] += r["taken"]
        assert sorted({round(t, 6) for t in targets.values()}) == sorted({round(r["target"], 6) for r in rows})
    # the test table's sources: near their targets
    assert all(abs(v[0] - t) <= max(0.1 * t, 300) for (_, t), v in by_size.items())
    assert mixing.mixed(empty).count() == 0


def test_landing_stays_near_and_keeps_expectations():
    """Totals stay near theirs in each draw; over many draws each document is taken about as often as its probability says."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 14, 14):
        p, s = rng.uniform(0.05, 0.95, n), rng.integers(50, 1500, n).astype(float)
        got = np.array([mixing.landing(p, s, np.random.default_rng(i)) for i in range(1000)])
        corners = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        off, number = np.abs(corners @ s - (p * s).sum()), np.abs(corners.sum(1) - p.sum()) < 1
        assert set(np.unique(got)) <= {0.0, 1.0} and np.abs(got @ s - (p * s).sum()).max() <= max(mixing.NEAR * (p * s).sum(), off[number].min())
        assert n < 14 or np.abs(got.mean(0) - p).mean() < 0.1


def test_taken_brute_force(spark):
    """Copies are floor(ratio) or one more, and their mean over many sources is the ratio."""
    rng = random.Random(14)
    rows = [(i, " ".join(["x"] * rng.randint(1, 40)), f"s{i % 60}") for i in range(3000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=40).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = water_fill(sizes)
    of = {i: (s, len(t.split())) for i, t, s in rows}
    taken = collections.Counter()
    for r in got:
        source, size = of[r["doc_id"]]
        ratio = target[source] / sizes[source]
        assert r["copies"] - math.floor(ratio + 1e-9) in (0, 1) and r["taken"] == r["copies"] * size
        taken[source] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, s = rng.random(500), rng.integers(0, 1000, 500)
    q = mixing.flight(p, s, rng)
    assert ((q > 0) & (q < 1)).sum() <= 3 and q.sum() == pytest.approx(p.sum(), abs=1e-6) and (q * s).sum() == pytest.approx((p * s).sum(), rel=1e-9)


# --- 4


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i in sorted(sets):
        for j, o in collections.Counter(j for g in sets[i] for j in inverted[g]).items():
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o) and top(i) != top(j):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            inverted[g].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard(spark, docs, empty):
    # chains of near copies around the threshold, for many sizes
    rng, rows = random.Random(2), []
    for n in (4, 5, 8, 12, 20, 40, 90, 200, 500):
        for _ in range(4):
            w = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            for _ in range(6):
                rows.append((len(rows), " ".join(w)))
                w = list(w)
                for _ in range(rng.randint(1, max(1, n // 45))):
                    w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), docs.where("doc_id IS NOT NULL"), spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")):
        want = brute_components([(r["doc_id"], r["text"]) for r in df.collect()])
        got = jaccard_join.joined(df.select("doc_id", "text")).collect()
        assert len(got) == df.count()
        assert [r for r in got if want[r["doc_id"]] != (r["n_shingles"], r["component_id"])] == []
    assert jaccard_join.joined(empty.select("doc_id", "text")).count() == 0
    assert jaccard_join.joined(docs.select("doc_id", "text")).where("doc_id IS NULL").count() == 1


def test_signatures_miss_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(400):
        a = set(rng.integers(0, 2**63, int(np.exp(rng.uniform(0, 6)))).tolist())
        b = set(a)
        while True:
            c = set(b)
            c.remove(next(iter(c))) if rng.random() < 0.5 and len(c) > 1 else c.add(int(rng.integers(0, 2**63)))
            if 9 * len(a ^ c) > len(a) + len(c):
                break
            b = c
        x, y = (np.unique(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert len(np.intersect1d(jaccard_join.signatures(x), jaccard_join.signatures(y)))
        for share in (0.1, 0.5, 1.0):
            known = np.sort(x[rng.random(len(x)) < share])
            assert len(np.intersect1d(jaccard_join.signatures(x, known), jaccard_join.signatures(y, known)))


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(900):
        w = list(base)
        for p in rng.sample(range(100), 3):
            w[p] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((900, " ".join(base)))
    want = brute_components(rows)
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(want[r["doc_id"]] == (r["n_shingles"], r["component_id"]) for r in got)


# --- 5

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_pii(t):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if passes(k, m.group()))
    return [sum(s[3] == k for s in spans) for k in PATTERNS], ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_pii(spark, docs, empty):
    rng = random.Random(1)
    bits = ["a@b.c", "%", ".", "@", "1.2.3.4", "256.", "0", "00255.", "+1 ", "(555) ", "-", "4111111111111111", " ", "12 34", "\n", "é", "🙂", "x", "+49-30-1234567", "a.b@c-d.e"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(600)] + [(600, 'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')] * 3
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        x = pii.with_spans(df.select("doc_id", "text")).select("text", *[f"n_{k}" for k in PATTERNS], F.sha2(pii.listed(F.col("base")), 256).alias("sha"), pii.listed(F.col("spans")).alias("spans"))
        n = 0
        for r in x.collect():
            counts, listed = brute_pii(r["text"])
            assert [r[f"n_{k}"] for k in PATTERNS] == counts and r["sha"] == hashlib.sha256(listed.encode()).hexdigest()
            assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
            n += 1
        assert n == df.count()
    assert pii.with_spans(empty.select("doc_id", "text")).count() == 0


def planted_pii(rng, n):
    """Texts with spans that the base patterns miss: (doc_id, text, spans to find, spans to leave alone)."""
    some = lambda chars, k: "".join(rng.choices(chars, k=k))
    digits, letters = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    private = [
        lambda: ("", some(digits, 16)),
        lambda: ("card ", "-".join(some(digits, 4) for _ in range(4))),
        lambda: ('token = "', some("0123456789abcdef", 40)),
        lambda: ("api_key: ", "sk-" + some(letters, 32) + "7a"),
        lambda: ("", "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 14) + "27"),
        lambda: ("password=", some(letters, 24) + "x9"),
        lambda: ("ssn ", f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{some(digits, 4)}"),
        lambda: ("phone ", f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{some(digits, 4)}"),
        lambda: ("iban ", f"DE{some(digits, 2)} " + " ".join(some(digits, 4) for _ in range(4)) + " " + some(digits, 2)),
    ]
    public = [
        lambda: ("on ", f"20{rng.randint(10, 24)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        lambda: ("isbn ", f"978-{rng.randint(0, 9)}-{some(digits, 3)}-{some(digits, 5)}-{rng.randint(0, 9)}"),
        lambda: ("commit ", some("0123456789abcdef", 40)),
        lambda: ("", f"a-rather-long-name-of-{rng.randint(2, 9)}-words"),
        lambda: ("sold ", f"{rng.randint(1_000_000, 9_999_999)}"),
        lambda: ("version ", f"{rng.randint(1, 9)}.{rng.randint(10, 99)}.{rng.randint(1000, 9999)}"),
    ]
    out = []
    for i in range(n):
        text, sets = "", ([], [])
        for _ in range(4):
            text += " ".join(rng.choices(["some", "clean", "words", "stand", "here"], k=rng.randint(2, 6))) + " "
            k = rng.random() < 0.4
            ahead, span = rng.choice(public if k else private)()
            sets[k].append((len(text) + len(ahead), len(text) + len(ahead) + len(span)))
            text += ahead + span + ('" ' if ahead.endswith('"') else " ")
        out.append((i, text + "end", *sets))
    return out


def test_pii_recall_and_precision(spark):
    """Of planted spans that the base patterns miss, nine in ten are found, and nine in ten of those found are planted."""
    rows = planted_pii(random.Random(31), 400)
    got = {r["doc_id"]: r["spans"] for r in pii.with_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).select("row.doc_id", "spans").collect()}
    hit = lambda a, b, found: any(s["s"] < b and a < s["e"] for s in found)
    private, public = [hit(*x, got[i]) for i, _, xs, _ in rows for x in xs], [hit(*x, got[i]) for i, _, _, xs in rows for x in xs]
    assert np.mean(private) >= 0.9 and sum(private) / (sum(private) + sum(public)) >= 0.9


def test_pii_time_follows_length(spark):
    """Many spans in one text: found, told apart from proposed ones, and masked."""
    n = 30_000
    df = pii.with_spans(spark.createDataFrame([(1, "1.2.3.4 é 9807915762804490 " * n)], "doc_id long, text string"))
    r = df.select("n_ip", pii.masked(df).alias("m")).first()
    assert r["n_ip"] == n and r["m"].replace("<number>", "9807915762804490") == "<ip> é 9807915762804490 " * n


def test_pii_clashing_columns(spark):
    names = "email ip card phone cand base spans n_ip row _d _null _masked text".split()
    df = pii.with_spans(spark.createDataFrame([(1, *["a@b.org"] * 13)], "doc_id long, " + ", ".join(f"{n} string" for n in names)))
    r = df.select("row.*", F.size("spans").alias("size")).first()
    assert all(r[n] == "a@b.org" for n in names) and r["size"] == 1


def test_pii_adds_and_masks(spark):
    rows = [(i, f'write to a{i}@b.org now. token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end') for i in range(20)] + [(99, None)]
    df = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r[1] for r in df.select("row.doc_id", pii.masked(df).alias("m")).collect()}
    assert got[3] == 'write to <email> now. token = "<secret>" end' and got[99] == ""


def test_pii_long_texts(spark):
    long = ["1" * 200_000, "1 " * 60_000, "a" * 300_000, "a." * 90_000 + "@b" + ".c" * 50_000, "+" * 50_000, "+1" + "(" * 100_000]
    df = pii.with_spans(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.select("row.doc_id", "n_email", "n_card").collect()}
    assert got[3]["n_email"] == 1 and got[0]["n_card"] == 0


# --- 6


def brute_removed(rows, window):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), reverse=True):
        w = words(t)
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = i
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return collections.Counter(out)


def words_named(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_substring_shards_long_references(spark, monkeypatch):
    """References of one long document lie in several shards."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    rng = random.Random(8)
    long = [f"q{rng.randrange(400)}" for _ in range(1500)]
    rows = [(0, " ".join(long))] + [(i, " ".join(long[(a := rng.randrange(1300)) : a + rng.randint(50, 300)] + [f"z{i}"] + long[:60])) for i in range(1, 30)]
    got = collections.Counter(tuple(r) for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50).collect())
    assert got == brute_removed(rows, 50)


def test_substring(spark, docs, empty):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(60):
        w = [f"r{rng.randrange(50)}" for _ in range(rng.randint(0, 60))]
        cut = passage[rng.randrange(20) : 70 - rng.randrange(20)]
        rows.append((i, " ".join(w + (cut if i % 2 else passage) + w[::-1] + ["x"] * rng.choice([0, 60]))))
    rows += [(i, None if i % 3 else " ".join(f"s{rng.randrange(2)}" for _ in range(200))) for i in range(60, 75)]
    # texts of one doc_id, equal or not, are judged each for itself
    twice = [(1, words_named("w", 60)), (1, words_named("v", 60)), (2, words_named("w", 60)), (3, words_named("v", 60)), (3, words_named("v", 60)), (3, words_named("u", 60)), (1, words_named("u", 59))]
    for df, window in ((spark.createDataFrame(twice, "doc_id long, text string"), 50), (spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 50), (spark.createDataFrame(rows, "doc_id long, text string"), 12), (docs.select("doc_id", "text"), 50)):
        got = collections.Counter(tuple(r) for r in substring_dedup.deduplicated(df, window).collect())
        assert got == brute_removed([tuple(r) for r in df.collect()], window)
    assert substring_dedup.deduplicated(empty.select("doc_id", "text")).count() == 0


def test_automaton():
    rng = random.Random(3)
    for _ in range(60):
        refs = [(rng.randrange(9), [rng.randrange(3) for _ in range(rng.randint(1, 30))]) for _ in range(rng.randint(1, 5))]
        text, doc, window = [rng.randrange(3) for _ in range(40)], rng.randrange(9), rng.randint(1, 5)
        a = substring_dedup.Automaton()
        for d, w in refs:
            a.add(w, d)
        a.close()
        want = [e for e in range(window - 1, len(text)) if any(d < doc and text[e - window + 1 : e + 1] == w[i : i + window] for d, w in refs for i in range(len(w) - window + 1))]
        assert a.repeats(text, doc, window) == want


# --- 7


def test_classifier(spark, docs, empty):
    rng = random.Random(11)
    clean = [f"c{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [rng.choice(clean) for _ in range(60)] + (["vile", "awful"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.resampled(d, lab).collect()}
    held = [i for i in got if i % 2]
    assert np.mean([got[i] for i in held if i % 5]) > 0.97 and np.mean([got[i] for i in held if i % 5 == 0]) < 0.2
    assert sorted(r["doc_id"] for r in quality_classifier.accepted(d, lab).collect()) == sorted(i for i in got if got[i])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.resampled(docs, none).where("NOT kept").count() == 0
    assert quality_classifier.resampled(docs, spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).count() == len(awkward())
    assert quality_classifier.resampled(empty, none).count() == 0


def brute_grams(t):
    """The n-grams of a text, as what they stand for."""
    w = words(t)
    stripped = [x.lower().strip(b".,;:!?\"()[]{}*#$%&|<>'") for x in w]
    outline = lambda x: re.sub(rb"(.)\1+", rb"\1\1", re.sub(rb"([aA0])\1+", rb"\1", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", x[:64])))))[:12]
    repeated = 5 * sum(a == b for a, b in zip(stripped, stripped[1:], strict=False)) > len(w)
    return {("w", x) for x in stripped} | {("p", *x) for x in zip(stripped, stripped[1:], strict=False)} | {("o", outline(x)) for x in w} | ({("repeats",)} if repeated else set())


def brute_weights(rows, fit, labelled, least=3):
    """Log weight of each text by models of the good rows in fit (text, good) and of all rows."""
    raw = collections.Counter(g for _, t in rows for g in brute_grams(t))
    target = collections.Counter(g for t, good in fit if good for g in brute_grams(t))
    have = collections.Counter(g for t, _ in labelled for g in brute_grams(t))
    n = sum(good for _, good in fit)
    a = max(2.0, n / 2000)
    ratios = {g: x for g in have if have[g] >= least and (x := math.log((target[g] + a) / (raw[g] * (n / len(rows)) + a))) < -1}
    return lambda t: sum(sorted(ratios.get(g, 0.0) for g in brute_grams(t)))


def test_classifier_brute_force(spark):
    """Ratios, margin, keys and cutoff from their definitions; rows with equal keys at the cutoff stay together."""
    rng = random.Random(21)
    clean, vile = [f"c{k}" for k in range(200)], ["vile", "AWFUL!", "x9%%%"]
    rows = [(i, " ".join(rng.choices(clean, k=40) + (rng.sample(vile, 2) if i % 4 == 0 else [])) + (" so so so so so so so so so so so so" if i % 8 == 0 else "")) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "vile " * 3000)] + [rows[4], rows[5]] * 3
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality_classifier.resampled(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = {r[0] for r in spark.range(400).where(F.pmod(F.xxhash64("id", F.lit("held")), F.lit(quality_classifier.HELD)) == 0).collect()}
    good = {i: not t for i, _, t in labels}
    known = [(i, t) for i, t in rows if i in good]
    fit = [(t, good[i]) for i, t in known if i not in held]
    part, whole = brute_weights(rows, fit, fit), brute_weights(rows, [(t, good[i]) for i, t in known], [(t, good[i]) for i, t in known])
    g, b = ([part(t) for i, t in known if i in held and good[i] == x] for x in (True, False))
    levels = sorted(set(g + b))
    cuts = [(x + y) / 2 for x, y in zip(levels, levels[1:], strict=False)]
    margin = max(cuts, key=lambda c: (sum(x < c for x in b) / len(b) - sum(x < c for x in g) / len(g), -c))
    want = sorted((i, whole(t)) for i, t in rows)
    assert [(i, pytest.approx(w, abs=1e-9)) for i, w in want] == sorted((r["doc_id"], r["log_weight"]) for r in got)
    keys = quality_classifier._keys(np.array([i for i, _ in want]), np.array([w for _, w in want]))
    cut = sorted(keys, reverse=True)[sum(w >= margin for _, w in want) - 1]
    assert [bool(k >= cut - 1e-9) for k in keys] == [r["kept"] for r in sorted(got, key=lambda r: r["doc_id"])]
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["key"], r["kept"]))
    assert all(len(x) == 1 for x in by.values())
    tied = spark.createDataFrame([(float(x), -float(x)) for x in (3, 3, 3, 2, 1)], "key double, log_weight double")
    assert quality_classifier.cutoff(tied, -3.0) == 1.0 and quality_classifier.cutoff(tied, -1.5) == 3.0


def test_classifier_length_does_not_reject(spark):
    """Clean texts of 20,000 different words keep log weight 0: no gram of theirs shares the weight of a flagged one."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("bcdfghklmnprstvw", k=9))
    clean, vile = [word() for _ in range(300)], ["".join(rng.choices("aeiou", k=9)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(clean, k=60) + rng.sample(vile, 12) * (i % 5 == 0))) for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    long = [(1000 + 10 * k + j, " ".join(word() for _ in range(n))) for k, n in enumerate((200, 2000, 20_000)) for j in range(10)]
    got = {r["doc_id"]: r["log_weight"] for r in quality_classifier.resampled(spark.createDataFrame(rows + long, "doc_id long, text string"), labels).collect()}
    assert [got[i] for i, _ in long] == [0.0] * len(long)
    assert all((got[i] < 0) == (i % 5 == 0) for i, _ in rows)


def test_classifier_one_weak_feature_rejects(spark):
    """A word of log weight between -3 and -2 is enough where the labelled rows say so."""
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices([f"c{k}" for k in range(300)], k=60) + ["m7"] * (i % 5 == 0 or i % 60 == 1))) for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.resampled(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert -3 < np.median([got[i]["log_weight"] for i in range(0, 900, 5)]) < -2
    assert np.mean([got[i]["kept"] for i in got if i % 5 == 0]) < 0.4 and np.mean([got[i]["kept"] for i in got if i % 5]) > 0.88


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth(spark, k):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=1000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert quality_classifier.kth_largest(df, "x", k, few=20) == sorted(x, reverse=True)[k - 1]


# --- 8


def test_sharding(spark, docs, empty):
    for df in (docs, spark.read.parquet(f"{DATA}/documents.parquet"), docs.limit(5)):
        got = sharding.sharded(df).collect()
        assert len(got) == df.count()
        by = collections.defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        counts = [len(by[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in got:
            if r["doc_id"] is not None:
                t = (texts[r["doc_id"]] or "").encode()
                assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
    assert sharding.sharded(empty).count() == 0


def test_sharding_keeps_groups(spark):
    rows = [(i, f"copy {i % 40}") for i in range(400)] + [(400 + i, f"single {i}") for i in range(2000)] + [(3000 + i, "hot") for i in range(1200)]
    got = {r["doc_id"]: r["shard"] for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    where = collections.defaultdict(set)
    for i, t in rows:
        where[t].add(got[i])
    assert len(where["hot"]) <= 7
    assert np.mean([len(where[f"copy {k}"]) == 1 for k in range(40)]) > 0.8


# --- 9


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(1)
    odd = ["".join(rng.choice("aaeebcd  thinger'sveré ß́ÅÅİΣσς\x1c\x85\xa0 \n\t0129!?<|endoftext|>日本語한가🙂") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    odd += ["a<|endoftext|>b <|startoftext|><|endoftext|> <|endoftext|", "x" * 5000, "ab" * 3000, "don't we'LL I'M O'S"]
    for df in (docs, spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), spark.read.parquet(f"{DATA}/documents.parquet")):
        want = collections.Counter()
        for r in df.collect():
            ids = own.encode(r["text"] or "", add_special_tokens=False).ids
            text = own.decode(ids, skip_special_tokens=False)
            want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert collections.Counter(tuple(r) for r in bpe.encoded(df).collect()) == want
    assert bpe.encoded(empty).count() == 0


# --- 10


def test_topk_beyond_64_bits(spark):
    """Large components: exact integers, cut to 64 bits, ties to smaller ids; clashing column names."""
    rng = random.Random(3)
    big = [3e15, -3e15, 2e10, 1e9, 0.5, 7.25, 1e30, -1e30]
    rows = [(i, [rng.choice(big) for _ in range(4)], "x", 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, query_id long, score long").repartition(3)
    got = topk.exact_topk(topk.as_integers(df), F.col("vec_id") % 20 == 0, 5).collect()
    cut = lambda x: min((1 << 63) - 1, max(-(1 << 63), x))
    v = {r[0]: [cut(math.floor(1024 * x)) for x in r[1]] for r in rows}
    want = [(q, k + 1, i, -s) for q in (0, 20, 40) for k, (s, i) in enumerate(sorted((-cut(sum(a * b for a, b in zip(v[q], v[i], strict=True))), i) for i in v if i != q)[:5])]
    assert sorted(map(tuple, got)) == want


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, None), (401, []), (402, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0, 2.0]), (None, [1.0] * 6), (100, rows[100][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    ints = topk.as_integers(df)
    got = topk.exact_topk(ints, F.col("vec_id") % 50 == 0, 10, block=3).collect()
    v = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q in sorted({i for i, _ in v if i % 50 == 0}):
        e = next(e for i, e in v if i == q)
        best = sorted(((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in v if i != q and len(f) == len(e)))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    none = topk.as_integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.exact_topk(none, F.col("vec_id") % 50 == 0).count() == 0
    few = topk.as_integers(df.where("vec_id IN (100, 3)"))
    assert [tuple(r)[:3] for r in topk.exact_topk(few, F.col("vec_id") == 100).collect()] == [(100, 1, 3)]
