"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, fingerprint, lm, mixing, near, quality, quotes, repeats, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "one two three four five six seven eight nine ten eleven twelve"
LONG = "many different words stand in this very long text number {} " * 1
TEXTS = [
    "A clean first text with some words of its own, and a second sentence too.",
    "A clean first text with some words of its own, and a second sentence too.",
    f"before {ITEM} after, and then other words follow here until the end of it",
    None,
    "",
    " \t\n ",
    "short",
    "é ü 日本語 and others, mixed with plain words to make a text",
    " ".join(LONG.format(i) for i in range(20_000)),  # over 1 MB
]
CLASH = ["th", "sid", "sig", "rid", "slot", "words", "spans", "items", "h1", "h2", "k1", "k2", "k", "g", "size", "src", "target", "x", "y", "score", "predicted", "word", "c", "ids", "n", "_once", "_th", "_words", "_spans", "_key", "_taken", "shard", "hits", "copy", "bands", "block"]


def table(spark):
    rows = [(i, t, "en", "ab"[i % 2] if i != 6 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (1, "another text under an id that was there", "en", "a", 39), (None, "a text without an id", None, "b", 20), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([("q1", ITEM), ("q2", None), (None, "...")], "item_id string, text string")


OPERATORS = {
    "op1": lambda s, d: tokens.token_file(d).drop("start"),
    "op2": lambda s, d: near.near_duplicates(d),
    "op3": lambda s, d: mixing.mix_sources(d),
    "op4": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "op5": lambda s, d: quality.score_quality(d, labels(s)),
    "op6": lambda s, d: fingerprint.edited_likeness(d),
    "op6 buckets": lambda s, d: fingerprint.fingerprints(d),
    "op7": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "op8": lambda s, d: repeats.remove_repeats(d),
    "op9": lambda s, d: lm.score_texts(d, rounds=0),
}
STAGES = {
    "quality": lambda s, d: quality.keep_quality(d, labels(s), threshold=0.0),
    "near": lambda s, d: near.drop_near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, benchmark(s)),
    "mix": lambda s, d: mixing.mixed_documents(d),
}


def told(df):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_odd_rows(spark, name):
    d, run = table(spark), OPERATORS[name]
    want = told(run(spark, d))
    assert len(want) == d.count()
    clash = d.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    assert told(run(spark, clash)) == want
    assert run(spark, d.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_rows(spark, name):
    d, run = table(spark), STAGES[name]
    clash = d.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    out = run(spark, clash)
    assert out.columns == clash.columns
    assert out.where(" or ".join(f"`{c}` is null or `{c}` <> 'own {c}'" for c in CLASH)).count() == 0
    assert told(out.select(*d.columns)) == told(run(spark, d))
    empty = run(spark, d.limit(0))
    assert empty.columns == d.columns and empty.count() == 0
    texts = [r.text for r in out.select("text").collect()]
    if name == "near":
        assert texts.count(TEXTS[0]) == 1 and texts.count(None) == 2 and "" in texts
    if name == "decontaminate":
        assert len(texts) == d.count() and not any(ITEM in t for t in texts if t)
    if name == "quality":
        assert len(texts) == d.count()
    if name != "mix":
        assert max(len(t or "") for t in texts) == len(TEXTS[-1])


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "u", "words that were written first"), (2, 0, "u", "> words that were written first\nan answer"), (2, 0, "u", "> words that were written first\nan answer"), (3, 1, None, None), (None, 1, "u", "> words that were written first"), (4, None, "u", ""), (5, 0, "u", "long line of words " * 60_000)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = told(quotes.link_conversations(m))
    clash = m.withColumns({c: F.lit("own") for c in ["level", "lines", "h1", "p1", "thread", "depth", "component", "parent_conv", "n", "own", "quoted", "ls"]})
    assert told(quotes.link_conversations(clash)) == want and len(want) == len(rows)
    assert quotes.link_conversations(m.limit(0)).count() == 0
