"""Personal data by weak supervision.

Base spans (e-mail, IP, card, phone) come from fixed patterns and tests. For what they miss, a wide pattern proposes spans: long runs of
letters and digits, account numbers with a country code, and groups of digits. Labelers of three kinds vote on each (for, against, or no
vote): patterns (shape, number of digits, check digit, variety of characters), gazetteers (prefixes of issuers and keys, dates, book
numbers) and context (the word before, the sign before). Base cards and phones are examples too, with the vote of their test. The corpus is
summed to counts of vote patterns and features; expectation-maximisation on these counts estimates each labeler's reliability and the
posterior of each vote pattern, where a labeler without a vote says nothing; a naive Bayes span classifier over the span's features (shape,
length, word before, sign before, prefix) is trained on the posteriors and decides. Spans it accepts, and that don't overlap a base span, are
added with kind `secret` or `number`.

The counts have a row for each combination of votes and features, whatever the size of the input. Positions are code points, end exclusive.

Defined results: a null text is empty; repeated rows each get their row and count each for the training; without candidates nothing is
added; an empty table gives an empty result; other columns are ignored, whatever their names. All steps are DataFrame operations within the
row; the patterns use possessive loops and lists of spans are built in blocks, so a text's time follows its length.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, table

KINDS = ("email", "ip", "card", "phone", "secret", "number")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATE = (
    r"(?<![A-Za-z0-9_-])(?:[A-Z]{2}[0-9]{2}(?:[ ][0-9A-Z]{4}){3,7}+(?:[ ][0-9A-Z]{1,3})?+(?![A-Za-z0-9])|(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"
    r"|[0-9]{13,19}+(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|[(]?[0-9](?:[().-]?[ ]?[(]?[0-9]){6,}+)"
)

# Gazetteers and context words of the labelers.
ISSUER_PREFIXES = ("2014", "2149", "2221", "2720", "30", "34", "35", "36", "37", "38", "39", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "6011", "62", "63", "64", "65", "67")
KEY_PREFIXES = ("AC", "AIza", "AKIA", "ASIA", "EAA", "SG", "eyJ", "gh[opsru]_", "github_pat_", "glpat-", "hf_", "npm_", "pk_", "rk_", "sk-", "sk_", "ssh-", "whsec_", "xox[abprs]-", "ya29")
PRIVATE_WORDS = (
    "access account acct amex api apikey auth authorization bearer bic billing birth call card cell contact credential credentials credit customer cvv debit dial dob driver employee fax handy iban id "
    "insurance konto kontonummer key kreditkarte licence login mastercard member mobil mobile móvil nif number numero password passport passwort passwd patient pass pin phone private pwd rufnummer routing secret "
    "sin sms social ssn swift tarjeta tax tel telefon telefono telephone tfn token user visa wallet whatsapp"
).split()
PUBLIC_WORDS = (
    "article chapter checksum code commit copyright date digest doi edition error figure hash id3 invoice isbn issn issue license line lot md5 model order page part patent pmid port pp price revision rfc section serial sha sha1 sha256 "
    "size sku step temperature total uuid version vol volume year"
).split()

LABELERS = ("base", "shape", "digits", "check", "variety", "gazetteer", "context", "sign")
#: Prior votes for and against of a labeler's rates given the truth; the base tests are believed more.
PRIOR = {"base": (30.0, 0.3)}
ROUNDS = 25
ACCEPT = 0.5
#: Items of a list that are handled one by one; lists of any length are made of such blocks.
BLOCK = 128


def scan(items: Column, state: Column, kind: str, step) -> Column:
    """array<kind> of step's results along the items, where step(state, item) gives (next state, result): time follows the number of items."""
    none = F.array().cast(f"array<{kind}>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        return F.aggregate(b, F.struct(acc["state"].alias("state"), none.alias("out")), one, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, zero, block, lambda a: F.flatten(a["out"]))).otherwise(none)


SPAN = "struct<s:int,e:int,m:string,before:string>"
SPANS = f"array<{SPAN}>"


def found(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<s,e,m,before>>: the pattern's matches with positions and the text before them; empty where the guard says there are none."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("p"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = (at + F.length(x["p"])).cast("int")
        end = (start + F.length(x["m"])).cast("int")
        return end, F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(24)).alias("before"))

    return F.when(guard, let(F.filter(both, lambda x: x["m"].isNotNull()), lambda x: scan(x, F.lit(0), SPAN, step))).otherwise(F.array().cast(SPANS))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string (not empty) is right."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    d = digits_of(m)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))


def _ip(m: Column) -> Column:
    part = lambda x: F.ltrim(x, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda x: F.when(F.length(part(x)) <= 3, F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))


TESTS = {"email": lambda m: F.lit(True), "ip": _ip, "card": _card, "phone": lambda m: F.length(digits_of(m)).between(9, 15)}


def _passes(test):
    return lambda x: test(x["m"])


def base_spans(docs: DataFrame) -> DataFrame:
    """row (all columns), text (never null), a column of spans for each base kind, and `cand`, the proposed spans that overlap none of them."""
    text = F.col("text")
    df = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    digit = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    df = df.withColumns({k: found(text, p, guards[k]) for k, p in PATTERNS.items()} | {"cand": found(text, CANDIDATE, digit)})
    df = df.withColumns({k: F.filter(F.col(k), _passes(TESTS[k])) for k in PATTERNS})
    return df.withColumn("cand", F.when(F.size("cand") > 0, free(F.col("cand"), F.concat(*PATTERNS))).otherwise(F.col("cand")))


def free(spans: Column, base: Column) -> Column:
    """The spans that overlap none of the base spans: both sorted by start, a look back for the largest end so far, and one ahead for the next start."""
    tagged = lambda c, tag: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(tag).alias("own"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before")))
    every = F.sort_array(F.concat(tagged(base, 0), tagged(spans, 1)))
    kind = "struct<s:int,own:int,e:int,m:string,before:string,ok:boolean>"
    marked = lambda x, ok: F.struct(x["s"].alias("s"), x["own"].alias("own"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), ok.alias("ok"))
    back = lambda end, x: (F.when(x["own"] == 0, F.greatest(end, x["e"])).otherwise(end), marked(x, end <= x["s"]))
    ahead = lambda start, x: (F.when(x["own"] == 0, x["s"]).otherwise(start), marked(x, x["ok"] & (start >= x["e"])))
    once = let(every, lambda x: scan(x, F.lit(0), kind, back))
    twice = let(F.reverse(once), lambda x: scan(x, F.lit(2147483647), kind, ahead))
    kept = F.filter(F.reverse(twice), lambda x: (x["own"] == 1) & x["ok"])
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"))).cast(SPANS)


def word_before(before: Column) -> Column:
    return F.translate(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z]*$", 1), UPPER, LOWER)


def votes(c: Column, base: bool = False) -> dict[str, Column]:
    """1 for, 0 against, -1 no vote. base: the span is one of the base tests'."""
    m, before = c["m"], word_before(c["before"])
    digits, n = digits_of(m), F.length(digits_of(m))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    distinct = F.size(F.array_distinct(F.split(m, "")))
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    starts = lambda names: m.rlike("^(?:" + "|".join(names) + ")")
    return {
        "base": F.lit(1 if base else -1),
        "shape": vote(m.rlike(r"^[0-9A-Fa-f]{32,64}$") & (letters > 0) | ((letters > 5) & (n > 5) & (F.length(m) >= 24)) | m.rlike("^[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}"), m.rlike("^(?:[A-Za-z]+[-_]){3,}")),
        "digits": vote((letters == 0) & n.between(9, 19), (letters == 0) & ((n < 9) | (n > 24))),
        "check": vote((letters == 0) & F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)), m.rlike(r"^([0-9])\1+$")),
        "variety": vote((letters > 0) & (n > 3) & (distinct >= 10), distinct <= 3),
        "gazetteer": vote(starts(KEY_PREFIXES) & (letters > 0) | ((letters == 0) & n.between(13, 16) & starts(ISSUER_PREFIXES)), m.rlike("^(?:19|20)[0-9]{2}[.-]?(?:0[1-9]|1[0-2])") | m.rlike("^97[89][ -]?[0-9]")),
        "context": vote(before.isin(*PRIVATE_WORDS), before.isin(*PUBLIC_WORDS)),
        "sign": vote(F.rtrim(c["before"]).rlike("[\"'=:]$") & (F.length(m) >= 20), c["before"].rlike("[#/$€£@]$")),
    }


def features(c: Column) -> Column:
    """The classifier's features, joined: shape with length, word before, sign before, prefix."""
    m, before = c["m"], word_before(c["before"])
    shape = F.when(m.rlike("^[0-9]+$"), "digits").when(m.rlike("^[0-9A-Fa-f]+$"), "hex").when(m.rlike(r"^[0-9]+(?:\.[0-9]+)+$"), "dotted").when(~m.rlike("[A-Za-z]"), "groups").when(m.rlike("^(?:[A-Za-z]+[-_]){3,}"), "words").otherwise("mixed")
    n = F.length(m)
    size = F.when(n < 9, "8").when(n < 11, "10").when(n < 13, "12").when(n < 20, "19").when(n < 26, "25").when(n < 40, "39").when(n <= 64, "64").otherwise("long")
    ahead = F.when(before.isin(*PRIVATE_WORDS), "private").when(before.isin(*PUBLIC_WORDS), "public").otherwise("other")
    sign = F.when(F.rtrim(c["before"]).rlike("[\"'=:]$"), "given").when(c["before"].rlike("[#/$€£@]$"), "counted").otherwise("none")
    first = F.when(m.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), "key").when(m.rlike("^(?:19|20)[0-9]{2}[.-]?(?:0[1-9]|1[0-2])"), "date").when(m.rlike("^97[89][ -]?[0-9]"), "book").otherwise("none")
    return F.concat_ws("|", F.concat(shape, size), ahead, sign, first)


def _pattern(c: Column, base: bool = False) -> Column:
    v = votes(c, base)
    return F.concat_ws(",", *[v[k].cast("string") for k in LABELERS])


def posteriors(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], dict]:
    """Expectation-maximisation over vote patterns: posterior of each pattern, and for each labeler its rates of votes given the truth."""
    n, width = sum(counts.values()), len(LABELERS)
    post = {}
    for p in counts:  # start from the majority of the votes
        yes, no = p.count(1), p.count(0)
        post[p] = (1 + 2 * yes) / (2 + 2 * yes + 2 * no)
    rates: dict = {}
    for _ in range(rounds):
        rates = {}
        for truth in (1, 0):
            for j, name in enumerate(LABELERS):
                by = {v: sum(c * (post[p] if truth else 1 - post[p]) for p, c in counts.items() if p[j] == v) for v in (1, 0)}
                # a vote is a priori right three times in four
                right, wrong = PRIOR.get(name, (3.0, 1.0))
                prior = {1: right if truth else wrong, 0: wrong if truth else right}
                rates[truth, j] = {v: (by[v] + prior[v]) / (by[1] + by[0] + right + wrong) for v in (1, 0)}
        share = min(0.98, max(0.02, sum(c * post[p] for p, c in counts.items()) / max(1, n)))
        for p in counts:
            if all(v < 0 for v in p):
                continue  # what nobody votes on stays open
            logit = math.log(share / (1 - share)) + sum(math.log(rates[1, j][p[j]] / rates[0, j][p[j]]) for j in range(width) if p[j] >= 0)
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    return post, rates


def classifier(rows: list[tuple[str, str, int]]) -> dict[str, float]:
    """Probability for each joined feature value: naive Bayes trained on the posteriors. rows: (votes, features, count)."""
    counts: dict = defaultdict(int)
    for p, _, c in rows:
        counts[tuple(map(int, p.split(",")))] += c
    post, _ = posteriors(dict(counts))
    mass, by, values = {1: 0.0, 0: 0.0}, defaultdict(float), defaultdict(set)
    for p, f, c in rows:
        q = post[tuple(map(int, p.split(",")))]
        for j, value in enumerate(f.split("|")):
            values[j].add(value)
        for truth, x in ((1, q * c), (0, (1 - q) * c)):
            mass[truth] += x
            for j, value in enumerate(f.split("|")):
                by[truth, j, value] += x
    out = {}
    for f in {f for _, f, _ in rows}:
        logit = math.log((mass[1] + 1) / (mass[0] + 1))
        for j, value in enumerate(f.split("|")):
            logit += math.log((by[1, j, value] + 0.5) / (mass[1] + 0.5 * len(values[j]))) - math.log((by[0, j, value] + 0.5) / (mass[0] + 0.5 * len(values[j])))
        out[f] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    return out


def trained(docs: DataFrame) -> dict[str, float]:
    """The classifier, from the candidates, cards and phones of all documents."""
    df = base_spans(docs)
    row = lambda base: lambda c: F.struct(_pattern(c, base).alias("v"), features(c).alias("f"))
    examples = df.select(F.explode(F.concat(F.transform("cand", row(False)), F.transform(F.concat("card", "phone"), row(True)))).alias("x"))
    counts = examples.groupBy("x.v", "x.f").agg(F.count(F.lit(1)).alias("n"))
    return classifier([(r["v"], r["f"], r["n"]) for r in counts.collect()])


def with_spans(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """row (all columns of docs), text (never null), `base` and `spans` (arrays of struct<s, k, e>, k numbering KINDS) and the counts n_<kind> of base spans."""
    model = trained(docs) if model is None else model
    df = base_spans(docs)
    accepted = sorted(f for f, p in model.items() if p > ACCEPT)
    tagged = lambda k, i: F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))
    df = df.withColumns({f"n_{k}": F.size(k).cast("long") for k in PATTERNS} | {"base": F.sort_array(F.concat(*[tagged(k, i) for i, k in enumerate(PATTERNS)]))})
    fits = lambda c: features(c).isin(*accepted) if accepted else F.lit(False)
    kind = lambda c: F.when(c["m"].rlike("[A-Za-z]"), F.lit(4)).otherwise(F.lit(5))
    added = F.transform(F.filter("cand", fits), lambda c: F.struct(c["s"].alias("s"), kind(c).alias("k"), c["e"].alias("e")))
    return df.withColumn("spans", F.sort_array(F.concat("base", added))).drop("cand", *PATTERNS)


def listed(spans: Column) -> Column:
    name = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["k"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(df: DataFrame) -> Column:
    """The text of with_spans() with each span replaced by its kind in angle brackets; of overlapping spans the first."""
    name = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["k"])
    text, spans = F.col("text"), F.col("spans")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))

    def block(acc: Column, b: Column) -> Column:
        # the spans of a block are cut from the block's own part of the text, as finding a place takes time that follows its distance
        part = F.substring(text, acc["at"] + 1, F.greatest(F.array_max(F.transform(b, lambda x: x["e"])) - acc["at"], F.lit(0)))

        def cut(part: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                before = F.substring(part, a["at"] - acc["at"] + 1, x["s"] - a["at"])
                put = F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(before, F.concat(F.lit("<"), name(x), F.lit(">")))).alias("out"))
                return F.when(x["s"] >= a["at"], put).otherwise(F.struct(F.greatest(x["e"], a["at"]).alias("at"), a["out"].alias("out")))

            zero = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(b, zero, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(a["out"], ""))).alias("out")))

        return let(part, cut)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(blocks, zero, block, end))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{k}" for k in PATTERNS]
    return df.select("row.doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
