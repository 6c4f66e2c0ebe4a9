"""Classifiers, quotation linking and the pipeline."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlake.llm import quality, quotes, toxicity

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def table(spark, name, d=DIR):
    return spark.read.parquet(f"{d}/{name}.parquet")


@pytest.mark.parametrize("score,label,cut", [(quality.score_quality, "quality", 0.3), (toxicity.score_toxicity, "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, score, label, cut):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "some text"), (0, "again")], SCHEMA)
    p = score(docs.select("doc_id", "text").unionByName(odd).withColumns({"y": F.lit(5), "x": F.lit("z"), "score": F.lit(0)}), labels).toPandas()
    assert len(p) == docs.count() + 4 and p.score.between(0, 1).all() and (p.predicted == (p.score >= cut)).all()
    assert (p.held_out == [zlib.crc32(("" if i != i else str(int(i))).encode()) % 5 == 0 for i in p.doc_id]).all()
    same = p[p.doc_id.isin([10**6, 10**6 + 1])].score
    assert same.nunique() == 1
    m = p.drop_duplicates("doc_id").merge(labels.toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.predicted == held[label]).mean() > 0.9


@pytest.mark.parametrize("score,label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_without_a_class(spark, score, label):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 1) for i in range(20)] + [(3, 0, 0), (4, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score < 1 for r in score(docs, ones).collect())
    assert score(docs.limit(0), ones).count() == 0


def test_labels_of_held_out_rows_never_teach(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_quality(docs, x).orderBy("doc_id").toPandas().score for x in (labels, flipped))
    assert np.allclose(a, b)


MSG = "conv_id long, turn long, role string, text string"


def linked(rows):
    """Parents by brute force."""
    own = []
    for c, t, _, x in rows:
        for line in re.split("\r?\n", x or ""):
            if not re.match(r"[ \t]{0,3}>", line):
                own.append((c, t, " ".join(line.lower().split())))
    out = {}
    for c, t, _, x in rows:
        if c is None or t is None:
            continue
        best = {}
        for line in re.split("\r?\n", x or ""):
            m = re.match(r"(?:[ \t]{0,3}>)+", line)
            body = " ".join(line[m.end() :].lower().split()) if m else ""
            if not body:
                continue
            home = [b for a, b, z in own if a == c and b is not None and z == body]
            away = sorted((a, b) for a, b, z in own if a is not None and b is not None and z == body)
            p = (c, min(home)) if home and min(home) < t else away[0] if away and away[0][0] != c else None
            if p:
                k = (m.group().count(">"), p)
                best[k] = best.get(k, 0) + 1
        if best:
            (_, p), _ = max(best.items(), key=lambda kv: (-kv[0][0], kv[1], kv[0][1]))
            out[c, t] = p
    return out


def test_quotation_links(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(12):
        for t in range(rnd.randrange(2, 9)):
            text = [f"Line {rnd.randrange(40)} of it", "hello"] if t % 2 else [f"own words {c} {t}", "Hello"]
            if rows and rnd.random() < 0.7:
                src = rnd.choice(rows)
                text = [*(("> " if rnd.random() < 0.7 else "> > ") + x.upper() for x in src[3].split("\n")[:2]), "", *text]
            rows.append((c, t, "user", "\n".join(text)))
    rows += [(90, 0, None, None), (90, 1, "user", ""), (91, 0, "user", "> nothing known"), (None, 1, "user", "> hello"), (92, None, "user", "hello")]
    df = spark.createDataFrame(rows, MSG).withColumn("n", F.lit(1)).withColumn("component", F.lit(2))
    got = quotes.link_conversations(df).collect()
    assert len(got) == len(rows)
    want = linked(rows)
    assert {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in got if r.parent_conv is not None} == want
    place = {(r.conv_id, r.turn): r for r in got}
    for k, p in want.items():
        assert place[k].thread == place[p].thread
        if place[k].depth is not None:
            assert place[k].depth == place[p].depth + 1
    assert not any(re.search(r"^[ \t]{0,3}>", r.text, re.M) for r in got)
    assert quotes.link_conversations(spark.createDataFrame([], MSG)).count() == 0


def test_deep_reply_chain(spark):
    rows = [(1, 0, "u", "start here")] + [(1, t, "u", f"> line {t - 1}\nline {t}" if t > 1 else "> start here\nline 1") for t in range(1, 70)]
    got = {r.turn: r.depth for r in quotes.link_conversations(spark.createDataFrame(rows, MSG)).collect()}
    assert got == {t: t for t in range(70)}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, "documents", "/root/testdata/sf0.001")
    cols = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() > 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == cols
    assert [f.name for f in docs.schema][:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    p = docs.orderBy("start").toPandas()
    assert (p.start == pd.Series([0, *p.n_tokens.cumsum()[:-1]])).all()


def test_quotations_wrapped_anew_and_foreign_authors(spark):
    para = "The first words of a long\nparagraph that somebody\nwrote by hand"
    rows = [(1, 0, "u", "before\n\n" + para + "\n\nafter"), (2, 0, "u", "> the first words of\n> a long paragraph that\n> somebody wrote by hand\nyes")]
    rows += [(3, 0, "u", "> shared line\nno"), (3, 1, "u", "shared line")] + [(c, 5, "u", "Shared  line") for c in range(4, 200)]
    rows += [(300, 0, "u", "> words of a long\nsome other text")]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in quotes.link_conversations(spark.createDataFrame(rows, MSG)).collect() if r.parent_conv is not None}
    assert got == {(2, 0): (1, 0), (3, 0): (4, 5)}
