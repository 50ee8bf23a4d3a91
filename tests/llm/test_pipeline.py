"""The pipeline's stages on the test tables, each against its own input."""

import collections

from conftest import DATA
from tokenizers import Tokenizer

from tidemark.llm import bpe, mixing, quality_classifier
from tidemark.llm.common import settled


def test_stages(spark):
    import corpus_pipeline as P
    from test_operators import brute_components, brute_pii

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{DATA}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "BPE encoding and decoding"]
    kept = {r["doc_id"] for r in quality_classifier.resampled(docs, labels).where("kept").collect()}
    out = []
    for _, stage in P.STAGES:
        docs = settled(stage(spark, docs, DATA))
        out.append(docs.collect())
    assert all(list(r[0].asDict()) == columns for r in out[:4])
    assert {r["doc_id"] for r in out[0]} == kept
    parts = brute_components([(r["doc_id"], r["text"]) for r in out[0]])
    assert sorted(r["doc_id"] for r in out[1]) == sorted({c for _, c in parts.values()})  # given ids are unique, texts repeat
    assert all(brute_pii(r["text"])[1] == "" and r["n_chars"] == len(r["text"]) for r in out[2] if r["text"] is not None)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mixed(spark.createDataFrame(out[2])).collect()}
    assert collections.Counter(r["doc_id"] for r in out[3]) == collections.Counter({i: c for i, c in taken.items() if c})
    own = Tokenizer.from_file(bpe.vocabulary_path())
    counts = {r["doc_id"]: len(own.encode(r["text"] or "", add_special_tokens=False).ids) for r in out[3]}
    assert len(out[4]) == len(out[3]) and all(counts[r["doc_id"]] == r["n_tokens"] for r in out[4])


def test_awkward_rows_and_clashing_columns(spark):
    """Null and repeated ids, repeated rows, nulls in any column, and extra columns named like the stages' own."""
    import corpus_pipeline as P

    near = " ".join(f"w{i}" for i in range(100))
    extra = "key dup copies copy email ip card phone cand base spans row c k d n goes _d _masked".split()
    rows = [(7, near), (7, near), (7, near + " more"), (None, near), (None, None), (None, None), (3, None), (4, ""), (5, "short text"), (6, "mail a@b.org or +1 (017) 555-7713 now"), (6, "other words here"), (None, "x y z"), (9, None)]
    rows = [(*r, None if i % 3 else "en", None if i % 4 else "s1", None if i % 5 else len(r[1] or ""), *[f"e{i}"] * len(extra)) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{e}` string" for e in extra)).repartition(3)
    columns, out = docs.columns, [docs.collect()]
    for _, stage in P.STAGES:
        docs = settled(stage(spark, docs, DATA))
        out.append(docs.collect())
    assert all(list(r[0].asDict()) == columns for r in out[:5])
    # values of other columns stay with their row
    assert all(len({r[e] for e in extra}) == 1 for rs in out[:5] for r in rs)
    assert len(out[1]) == len(rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in out[2]), key=repr)
    # of the copies under id 7 and under no id one row stays, that of the smallest name
    assert [r for r in kept if r[1] and r[1].startswith("w0")] in ([(7, near)], [(7, near + " more")])
    assert sum(r[1] is None for r in kept) == 4 and sum(r[0] == 6 for r in kept) == 2 and len(kept) == 10
    assert any(r["text"] == "mail <email> or <phone> now" for r in out[3])


def test_empty(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = settled(stage(spark, docs, DATA))
    assert docs.count() == 0
