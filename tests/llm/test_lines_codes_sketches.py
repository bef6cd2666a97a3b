"""Line labels, product codes and sketch search against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.llm import ball_codes, line_crf, sketch_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["label", "vec", "code", "salt", "rank", "score", "query", "none", "n_words", "quality", "k"]


def texts_of(rng, n):
    said = "the of and river stone light over under green É ß house".split()
    out = [None, "", " \t\n\r\x0b", "one", "a\n\na\na \n\ta", "É é É é É é", "x | y\x0c#*$%&|<>", "a b c " * 300, "z" * 3000, "\n" * 50 + "end"]
    for _ in range(n):
        lines = [" ".join(rng.choice(said) + rng.choice(["", "", ".", "###", " |"]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        out.append(rng.choice(["\n", "\n", "\r\n"]).join(lines + lines[:1]))
    return [*out, out[-1], " ".join(rng.choice(said) + str(i) for i in range(20000))]


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dups = text.split("\n"), 0
    for i, line in enumerate(lines):
        dups += bool(WORD.search(line)) and line in lines[:i]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), failed


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts_of(random.Random(3), 60))]
    df = spark.createDataFrame([*rows, rows[12], rows[12]], "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def best_labels(model, features):
    """The best of all labellings, ties to content from the last line on."""
    unary = features @ model.weight

    def total(labels):
        s = model.first * labels[0] + float(np.dot(unary, labels))
        return s + sum(model.step[a, b] for a, b in itertools.pairwise(labels))

    return max(itertools.product((0, 1), repeat=len(unary)), key=lambda x: (round(total(x), 9), x[::-1]))


def test_line_counts_are_the_plain_ones(docs, labels):
    found = line_crf.report(docs, line_crf.train(docs, labels, rows=20))
    assert found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect())
    assert got == Counter((r.doc_id, *plain_counts(r.text)) for r in docs.collect())
    assert not found.where("base_failed AND kept").count()


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(4)
    model = line_crf.Model(rng.normal(size=3), rng.normal(size=(2, 2)), 0.3)
    owner = np.repeat([0, 2, 3, 7], [5, 1, 9, 3])
    features = rng.normal(size=(len(owner), 3))
    found = line_crf.viterbi(model, features, owner)
    for o in set(owner):
        assert tuple(found[owner == o]) == best_labels(model, features[owner == o])
    assert line_crf.viterbi(model, features[:0], owner[:0]).shape == (0,)


def test_gradient_is_that_of_the_likelihood():
    """The fitted field is a maximum: the expected counts equal the observed ones up to the penalty."""
    rng = np.random.default_rng(1)
    owner = np.repeat(np.arange(30), 4)
    features = np.column_stack([np.ones(120), rng.normal(size=120)])
    truth = (features[:, 1] + rng.normal(size=120) > 0).astype(int)
    model = line_crf._fit(features, owner, truth, np.ones(120))
    base = sum(_log_likelihood(model, features[owner == o], truth[owner == o]) for o in range(30))
    for change in ([0.3, 0], [-0.3, 0], [0, 0.3], [0, -0.3]):
        other = line_crf.Model(model.weight + change, model.step, model.first)
        assert sum(_log_likelihood(other, features[owner == o], truth[owner == o]) for o in range(30)) < base


def _log_likelihood(model, features, truth):
    def total(labels):
        return model.first * labels[0] + float((features @ model.weight) @ np.array(labels)) + sum(model.step[a, b] for a, b in itertools.pairwise(labels))

    every = [total(x) for x in itertools.product((0, 1), repeat=len(truth))]
    return total(tuple(truth)) - math.log(sum(map(math.exp, every)))


def test_kept_follows_the_content_share(spark):
    rng = random.Random(1)
    said = lambda n: [f"{rng.choice('river stone light green house walks'.split())}{chr(97 + rng.randrange(26))}" for _ in range(n)]
    prose = lambda: "\n".join("The " + " ".join(said(10)) + "." for _ in range(9))
    menu = lambda: "\n".join(" | ".join(said(4)) + " | ####" for _ in range(20))
    good, poor = prose(), menu()
    rows = [(i, prose() if i % 2 else menu()) for i in range(80)]
    docs = spark.createDataFrame([*rows, (100, poor + "\n" + good), (101, good)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    found = {r.doc_id: r for r in line_crf.judge(docs, labels).collect()}
    assert all(found[i].kept == bool(i % 2) for i in range(80)) and found[101].kept
    model = line_crf.train(docs, labels)
    spans = {r.doc_id: r.lines for r in line_crf.line_spans(docs, model).collect()}
    text = poor + "\n" + good
    assert [text[s.start : s.end] for s in spans[100]] == text.split("\n")
    words = [len(text[s.start : s.end].split()) for s in spans[100]]
    assert sum(w for w, s in zip(words, spans[100], strict=True) if s.content) == found[100].content_words
    assert found[100].kept == (found[100].content_words >= 0.5 * found[100].n_words)


@pytest.mark.parametrize("only", [0, 1, None])
def test_one_class_or_none_to_learn_from(docs, labels, only):
    model = line_crf.train(docs, labels.where("quality IS NULL" if only is None else f"quality = {only}"))
    got = line_crf.report(docs, model).where("NOT base_failed")
    assert got.count() and got.where("kept").count() == (0 if only == 0 else got.count())


def test_line_labels_of_no_rows(docs, labels):
    assert line_crf.judge(docs.where("false"), labels).count() == 0
    assert line_crf.judge(docs, labels.where("false")).count() == docs.count()


# ---- codes ------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    return codes, [sum(far(c[p], books[p][k]) for p, k in enumerate(code)) for c, code in zip(cut, codes, strict=True)], books


@pytest.mark.parametrize("scale", [1, 2**40])
def test_codes_equal_plain_rounds(spark, scale):
    rng = random.Random(8)
    rows = [(rng.randrange(200), [rng.randint(-3, 3) * scale for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(180)]
    rows += [(None, rows[0][1], None), rows[5], rows[5]]
    df = spark.createDataFrame([(a, c, b) for a, b, c in rows], "vec_id long, label int, vec array<long>").repartition(3)
    codes, books = ball_codes.fit_codes(df, parts=4, entries=9, rounds=3)
    want, error, plain = plain_codes([(a, b) for a, b, _ in rows], 4, 9, 3)
    assert [b.tolist() for b in books] == plain
    got = Counter((r.vec_id, bytes(r.code), r.error) for r in codes.collect())
    assert got == Counter((r[0], bytes(c), min(e, 2**63 - 1)) for r, c, e in zip(rows, want, error, strict=True))
    if scale == 1:
        named = ball_codes.with_label_error(codes).collect()
        sums = Counter()
        for r, e in zip(rows, error, strict=True):
            sums[r[2]] += e
        assert len(named) == len(rows) and all(r.label_error == sums[r.label] for r in named)
        back = {bytes(r.code): r.vec for r in ball_codes.decoded(codes, books).collect()}
        assert all(back[bytes(c)] == [x for p, k in enumerate(c) for x in plain[p][k]] for c in want)


def test_balls_give_the_nearest_entries_with_less_work():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, size=(64, 4))
    points = (centres[rng.integers(0, 64, 4000)] + rng.integers(-60, 60, size=(4000, 4))).astype(np.int64)
    old, _ = ball_codes.nearest(points, centres + rng.integers(-9, 9, size=centres.shape))
    balls = ball_codes.Balls(centres)
    best, far = balls.reassign(points, old)
    want, d = ball_codes.nearest(points, centres)
    assert (best == want).all() and (far == d).all()
    assert balls.compared < 0.25 * len(points) * 63
    tied = np.array([[0, 0]] * 3)
    best, far = ball_codes.Balls(np.array([[2, 0], [0, 2], [0, -2], [9, 9]])).reassign(tied, np.array([2, 1, 3]))
    assert best.tolist() == [0, 0, 0] and far.tolist() == [4, 4, 4]


def test_codes_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.1 * i for i in range(16)]
    rows = [(1, good, 1), (None, good, None), (2, None, 1), (3, [*good[:15], nan], 2), (4, [*good[:15], inf], 2), (5, [*good[:15], None], 2),
            (6, [], 1), (7, good[:8], 1), (8, good, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in CLASH if c != "label"})
    got = ball_codes.report(df).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 8]
    assert all(r.code == "00" * 16 and r.error == 0 and r.label_error == 0 for r in got)
    assert ball_codes.report(df.where("vec_id = 2")).count() == 0
    assert ball_codes.report(df.where("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_many_labels_are_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(ball_codes, "BROADCAST_LABELS", 0)
    df = spark.createDataFrame([(i, bytes([i % 7]), i, None if i % 3 else i % 5) for i in range(90)], "vec_id long, code binary, error long, label int")
    got = ball_codes.with_label_error(df).collect()
    sums = Counter()
    for i in range(90):
        sums[None if i % 3 else i % 5] += i
    assert len(got) == 90 and all(r.label_error == sums[r.label] for r in got)


# ---- search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    worded = [(i, c) for i, c in held if c]
    n, total = len(worded), sum(c.total() for _, c in worded)
    df = Counter(t for _, c in worded for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    for item, q in asked.items():
        found = []
        for i, c in worded:
            m = 100 - 90 + (90 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def items_of(docs, rng):
    rows = [(i, (t or "")[: rng.randint(5, 200)]) for i, (_, t) in enumerate(docs[::3])]
    return [*rows, (0, "river É stone7"), (900, None), (None, "the river"), (None, "stone"), (901, "nowhere-to-be-found"), rows[4]]


@pytest.mark.parametrize("width,block", [(1024, 8192), (3, 4)])
def test_ranks_are_the_plain_ones(spark, docs, monkeypatch, width, block):
    monkeypatch.setattr(sketch_search, "BLOCK_QUERIES", block)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = items_of(rows, random.Random(2))
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ["rank", "score", "query", "df"]})
    got = Counter((r.item_id, r.rank, r.doc_id, r.score) for r in sketch_search.rank(docs, table, k=10, width=width).collect())
    assert got == plain_ranks(rows, items, 10)


def test_ranks_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    assert sketch_search.rank(docs, items.where("false")).count() == 0
    assert sketch_search.rank(docs.where("false"), items).count() == 0
    assert sketch_search.rank(docs.where("text IS NULL"), items).count() == 0


def test_bounds_hold_and_spare_exact_scores():
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randint(20, 200))) for _ in range(600)]
    counts = [Counter(sketch_search.terms(t)) for t in texts]
    n, total = len(texts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    queries = [{t: sketch_search.weight(df[t], n) for t in set(sketch_search.terms(texts[i])[:15])} for i in range(0, 600, 40)]
    sketches = sketch_search.Sketches(texts, n, total)
    searcher = sketch_search.Searcher(queries, 10)
    searcher.add(sketches, [(False, i) for i in range(n)])
    bounds = searcher.lookup @ sketches.table.T
    for q, row, best in zip(queries, bounds, searcher.best, strict=True):
        exact = [sum(w * sketch_search.impact(c[t], m) for t, w in q.items() if t in c) for c, m in zip(counts, sketches.unit, strict=True)]
        assert all(b >= e for b, e in zip(row, exact, strict=True))
        assert best == sorted((-e, (False, i)) for i, e in enumerate(exact) if e > 0)[:10]
    assert searcher.scored < 0.3 * len(queries) * n


def test_sums_with_empty_partitions(spark):
    rows = spark.createDataFrame([([2, 6], bytearray([0, 1])), ([5, 7], bytearray([0, 1]))], "vec array<long>, code binary")
    books = [np.array([[1], [9]]), np.array([[1], [9]])]
    assert [b.tolist() for b in ball_codes._updated(rows.repartition(6), books, True)] == [[[3], [9]], [[1], [6]]]
