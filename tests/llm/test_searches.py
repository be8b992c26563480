"""Searches by score, hard negatives, ranked lexical search and suffix dedup, against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.llm import lexical, mining, suffixes, topk
from contactspark.llm.products import products
from tests.llm.test_corpus import ODD, best, collected, good, prose

LONG = (-(2**63), 2**63 - 1)


@pytest.mark.parametrize("sizes", [[3], [3, 1e9], [1e7], [1e12], [3, 1e17], [1e40, 5], [1e300, 1], [0]])
def test_products_are_exact(sizes):
    r = np.random.default_rng(1)
    for dims in (1, 7, 64):
        a, b = (np.floor(r.normal(size=(n, dims)) * r.choice(sizes, size=(n, 1)) * 256) for n in (9, 13))
        want = [[max(LONG[0], min(LONG[1], sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
        assert products(a, b).tolist() == want


@pytest.mark.parametrize("huge", [[1e17], [6e4] * 3, [1e17, -1e17, 1e30, 4e15]])
def test_top_k_among_huge_vectors(spark, huge):
    """Several queries in a block with vectors whose sums no double holds."""
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(120)]
    rows += [(200 + i, [x * (1 + r.random()) for _ in range(64)]) for i, x in enumerate(huge)] + [(250, [1e15] + [0.5] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")
    want = []
    for q, _ in [x for x in rows if x[0] % 50 == 0]:
        # scores beyond a long count as its ends, so that they are ties
        scored = sorted((-max(LONG[0], min(LONG[1], s)), i) for _, _, i, s in best(rows, lambda i, q=q: i == q, len(rows)))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(got) == sorted(want)


# --- hard negatives ----------------------------------------------------------


def plain_negatives(rows, asks, positives=5, negatives=3, low=50, high=95):
    rows = [(i, [int(math.floor(256 * float(x))) for x in v], n) for i, v, n in rows if i is not None and n is not None and good(v)]
    out = []
    for a, (anchor, v, label) in enumerate(rows):
        if not asks(anchor):
            continue
        scored = sorted((-max(LONG[0], min(LONG[1], sum(x * y for x, y in zip(v, w, strict=True)))), i, n == label) for b, (i, w, n) in enumerate(rows) if b != a and len(w) == len(v))
        for s, positive, _ in [x for x in scored if x[2]][:positives]:
            fit = [(-t, i) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s]
            out += [(anchor, positive, rank, i, -s, t) for rank, (t, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("together", [(4096, 2048), (11, 3)])
def test_hard_negatives_match_all_pairs(spark, together):
    r = random.Random(5)
    rows = [(i, [r.choice([1.0, 2.0, 0.0, r.gauss(1, 1)]) for _ in range(4)], 0 if i % 3 else i % 5) for i in range(150)]
    rows += [(300 + i, rows[50][1], i % 2) for i in range(20)]  # ties
    rows += [(50, *rows[50][1:]), (100, *rows[100][1:]), (400, [1e12, -1e12, 1e12, 1e11], 3), (401, [1e12] * 4, 0), (450, [1.0, 1.0], 0), (451, [1.0, 1.5], 0), (452, [1.0, 1.0], 1)]
    rows += [(500, None, 1), (550, [1.0, None, 1.0, 1.0], 1), (600, [float("inf")] * 4, 0), (None, rows[0][1], 0), (650, rows[1][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("clash"))
    got = mining.mine(df, F.col("vec_id") % 50 == 0, rows_together=together[0], anchors_together=together[1])
    assert sorted(collected(got, *got.columns)) == plain_negatives(rows, lambda i: i % 50 == 0)
    assert mining.mine(df.limit(0), F.lit(True)).count() == 0


# --- ranked lexical search ---------------------------------------------------


def plain_ranking(docs, items, k=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(terms(text))
        weight = {t: n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, n in asked.items()}
        scored = []
        for (i, c), n in zip(counted, sizes, strict=True):
            if n:
                m = 100 - 75 + (75 * n * n_docs) // n_terms
                scored.append((-sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if c[t]), i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"documents": 7, "items_together": 2, "terms_together": 30}])
def test_ranking_matches_all_documents(spark, sizes):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(20 + i % 50, i % 40)) for i in range(150)] + [(100, prose(20, 0)), (None, prose(20, 0)), (None, prose(25, 5)), (2**60 + 1, prose(20, 0))]
    items = [(1, prose(20, 0)), (2, prose(60, 7)), (2, "word Word wORD"), (3, None), (4, "\n"), (None, "ßtraße 日本語"), (5, "nothing here has it"), (6, prose(20, 0))]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **sizes)
    assert sorted(collected(got, *got.columns), key=str) == sorted(plain_ranking(docs, items), key=str)


def test_wand_passes_over_documents_that_cannot_qualify(monkeypatch):
    r = np.random.default_rng(2)
    scored = []
    seen = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda docs, scores, k: scored.append(len(docs)) or seen(docs, scores, k))
    for turn in range(30):
        lists = []
        for size, top in ((40, 900), (300, 300), (2000, 40), (2500, 20), (3000, 10)):
            own = np.sort(r.choice(4000, size=size, replace=False))
            lists.append((own, r.integers(1 if turn % 2 else 0, top, size=size)))
        total = np.zeros(4000, dtype=np.int64)
        for own, impact in lists:
            total[own] += impact
        want = np.lexsort((np.arange(4000), -total))[:10]
        docs, scores = lexical.wand(lists, 4000, 10, first=64)
        assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert sum(scored) < 30 * 1500  # of 4000 documents, nearly all of which hold a term
    assert len(lexical.wand([], 10, 3)[0]) == 0


# --- suffix dedup ------------------------------------------------------------


def plain_spans_of(texts, length):
    """Maximal removed runs of each text."""
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def without(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


def passages(r):
    """Texts with copies, near copies, shared passages that begin and end anywhere, and runs of one letter."""
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", "a" * 1000, "ab" * 700, "é日" * 400, text(400)]
    base = [text(300) for _ in range(5)]
    for k in range(120):
        own = r.choice(base).split(" ")
        for _ in range(r.randint(1, 5) if k % 4 == 1 else 0):
            own[r.randrange(len(own))] = f"ZZ{r.randrange(9)}"
        at = r.randrange(200)
        texts.append(" ".join(own) if k % 4 < 2 else f"{text(60)} {' '.join(own[at : at + 100])} {text(50)}" if k % 4 == 2 else text(200))
    return texts


@pytest.mark.parametrize("length, heavy", [(400, 1000), (40, 3), (7, 1000)])
def test_suffix_dedup_matches_all_windows(spark, monkeypatch, length, heavy):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    texts = passages(random.Random(1))
    rows = [(i % 100 if i % 9 else None, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long").withColumn("a.b", F.lit(1)).repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.dedup(df, length).collect()]
    raw = [(t or "").encode() for t in texts]
    want = [(i, len(t), sum(b - a for a, b in spans), spans, without(t, spans)) for (i, *_), t, spans in zip(rows, raw, plain_spans_of(raw, length), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_texts_beyond_a_part_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BITS", 9)
    monkeypatch.setattr(suffixes, "_MASK", np.uint64(511))
    texts = [(t or "").encode() for t in passages(random.Random(3))]
    for t in texts:
        at, _, first, last = suffixes.anchors(t, 60)
        whole = [p for a, b in zip(first.tolist(), last.tolist(), strict=True) for p in range(a, b + 1)]
        assert whole == list(range(max(0, len(t) - 59)))
        assert ((at >= last) & (at + suffixes.gram_of(60) <= first + 60)).all()


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    shared = bytes(r.randrange(97, 110) for _ in range(900))
    one, two = (bytes(r.randrange(97, 110) for _ in range(n)) + shared for n in (50, 777))
    place = lambda t: {p: a - p for a, f, b in zip(*(x.tolist() for k, x in enumerate(suffixes.anchors(t, 400)) if k != 1), strict=True) for p in range(f, b + 1)}
    a, b = place(one), place(two)
    assert all(a[50 + i] == b[777 + i] for i in range(501))


def test_suffix_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup(df).count() == 0
    assert [r.n_removed for r in suffixes.dedup(spark.createDataFrame([(None,), ("x" * 399,)], "text string")).collect()] == [0, 0]
