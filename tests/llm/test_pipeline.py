"""The pipeline's stages on the smallest tables: each works on what the one before it kept."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from clientele.llm.common import saved, table

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select(*[c for c in columns if c in docs.columns]).collect()
        docs = saved(stage(spark, docs, SF), "test-stage")
        rows = docs.collect()
        seen.append(len(rows))
        if name != names[-1]:
            assert docs.columns == columns and set(rows) <= set(before)
        if name == "exact dedup":
            assert sorted(SPACE.sub("", r.text) for r in rows) == sorted({SPACE.sub("", r.text) for r in before})
        if name == "MinHash near-dedup":
            assert max(Counter(r.doc_id for r in rows).values()) == 1 and len(rows) < len(before)
        if name == "mixing":
            assert max(Counter(r.doc_id for r in rows).values()) == 2
    assert len(rows) == len(before) and all(r.round_trip for r in rows)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, table(spark, SF, "documents"), SF)
    kept = {r.doc_id for r in first.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.9 * len(good)


def test_run(spark):
    result = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_pieces", "ids", "round_trip"} <= set(result.columns) and result.count() > 0


def test_empty_table(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else table(spark, SF, "documents").where("false")


def test_stages_take_odd_rows(spark):
    """Null ids, texts and sources, blank and repeated rows, columns with the operators' own names."""
    word = "river stone light over under green house walks slow bright".split()
    text = " ".join(word[i * 7 % 10] + str(i) for i in range(80))
    rows = [(1, text, "a"), (None, text + " end", None), (None, None, None), (2, "", "a"), (3, " \n", "b"), (1, text, "a"), (1, text, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = [F.lit("x").alias(c) for c in ("row", "k", "n", "key", "size", "label", "h")]
    docs = docs.select("*", *extra)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        got = found.collect()
        if name == "SentencePiece":
            assert len(got) == len(rows) and all(r.round_trip for r in got)
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        else:
            assert found.columns == docs.columns and all(r.row == "x" for r in got)
            assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in rows}
        if name == "exact dedup":
            assert Counter(SPACE.sub("", r.text or "") for r in got) == Counter({SPACE.sub("", t or "") for _, t, _ in rows})
