"""The registered queries on a small folder of tables, against brute force on the columns of their contracts."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contactspark.llm import quality
from tests.llm.test_corpus import DOCS, ODD, WORD, best, collected, plain_classes, plain_counts, plain_runs, plain_spans, plain_targets, prose, words
from tests.llm.test_searches import plain_negatives, plain_ranking, plain_spans_of, without


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with nulls, ties, repeated rows, empty and long texts, a hot source, further columns; labels, embeddings, pages."""
    folder = tmp_path_factory.mktemp("tables")
    r = random.Random(4)
    rows = [(i, t, "en", "hot" if i % 3 else None, 1) for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(40 + 9 * (i % 30), i), "en", "hot" if i % 2 else f"s{i % 5}", 1) for i in range(120)]
    rows += [(300 + i, prose(80, 1), "de", "s0", 1) for i in range(25)]
    rows += [(400 + i, prose(80, 1) + f" more{i}", "de", "s0", 1) for i in range(10)]
    rows += [(500, prose(300, 300), "fr", "s2", 1), (500, prose(300, 300), "fr", "s2", 1), (None, prose(50, 5), None, None, None), (None, None, None, None, None)]
    rows += [(600 + i, f"write to a{i}@b.co or +44 20 7946 09{i:02d}\n4111 1111 1111 1111 at 10.0.0.{i}\nGB82 WEST 1234 5698 7654 32", "en", "s3", 1) for i in range(8)]
    rows += [(700, " | ".join(words(5000, 9)), "en", "s4", 1), (701, "é日" * 3000 + " <|endoftext|> end", "en", "s4", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_rules", F.lit("clash")).withColumn("a.b", F.lit(1)).withColumn("shard", F.lit(9))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(100 + i, i % 7 != 0, 0) for i in range(120)] + [(None, True, 0), (100, None, 1)]
    spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [r.choice([-1.0, 0.0, r.gauss(0, 1)]) for _ in range(5)], i % 4) for i in range(130)]
    vectors += [(500 + i, vectors[50][1], 2) for i in range(8)] + [(350, None, 1), (400, [1.0, None, 0.0, 0.0, 0.0], 1), (450, [float("nan")] * 5, 0), (700, [float("inf")] * 5, 0)]
    vectors += [(None, vectors[0][1], 0), (800, vectors[3][1], None), (850, [1e13] * 5, 1), (851, [-3e12] * 5, 1), (50, vectors[50][1], 2), (900, [1.0, 2.0], 1), (901, [2.0, 2.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash")).withColumn("key", F.lit(1)).repartition(2).write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, f"http://h{i % 3}/{i}", None if i % 7 == 0 else "" if i % 11 == 0 else f"<p>é {i % 5}</p>" * (1 + i % 3)) for i in range(40)] + [(99, None, "<b>\n\r\n</b>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).write.parquet(f"{folder}/pages.parquet")
    items = [(1, prose(40, 1)), (2, None), (3, ""), (4, "ünï çödé 日本語 WORD w0"), (5, prose(30, 9)), (5, prose(30, 9)), (None, "word line"), (6, "qqq zzz")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [(i, t, s) for i, t, _, s, _ in rows], r, {"vectors": vectors, "pages": pages, "items": items}


def rows_of(spark, tables, name):
    return entry.queries()[name](spark, tables[0]).collect()


def test_top_k(spark, tables):
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in rows_of(spark, tables, "op1_topk_search")]
    assert sorted(got) == best([(i, v) for i, v, _ in tables[3]["vectors"]], lambda i: i % 50 == 0, 5)


def test_hard_negatives(spark, tables):
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows_of(spark, tables, "op11_hard_negatives")]
    rows = [(i, v, (n + 1) % 10 if i is not None and n is not None and i % 7 == 0 else n) for i, v, n in tables[3]["vectors"]]
    want = plain_negatives(rows, lambda i: i % 50 == 0)
    assert sorted(got) == want and len({a for a, *_ in got}) > 2


def test_lexical_search(spark, tables):
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in rows_of(spark, tables, "op12_lexical_search")]
    want = plain_ranking([(i, t) for i, t, _ in tables[1]], tables[3]["items"])
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) >= 30


def test_suffix_dedup(spark, tables):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, tables, "op13_suffix_dedup")]
    texts = [(t or "").encode() for _, t, _ in tables[1]]
    want = [(i, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(t, spans)).hexdigest()) for (i, *_), t, spans in zip(tables[1], texts, plain_spans_of(texts, 400), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(n for _, _, n, _, _ in got) > 10_000


def test_warc(spark, tables):
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows_of(spark, tables, "op10_warc"))
    first, want = {}, []
    for i, _, html in tables[3]["pages"]:
        raw = (html or "").encode()
        kind = "revisit" if raw in first else "response"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first.get(raw)))
        first.setdefault(raw, i)
    assert got == sorted(want, key=lambda r: r[0])


def test_sharding(spark, tables):
    got = rows_of(spark, tables, "op2_sharding")
    size = lambda t: len((t or "").encode()) + 8
    want = sorted(((i is None, i or 0), size(t), zlib.crc32((t or "").encode())) for i, t, _ in tables[1])
    assert sorted(((r.doc_id is None, r.doc_id or 0), r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < 24 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 24) <= largest


def test_shards_are_cuts_of_one_order(spark, tables):
    """Against a plain version: all rows in the order of their groups' hashes, a row's shard by where its middle lies."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    rows = sorted((h, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for h, t in docs.select(F.xxhash64(F.xxhash64("text")), "text").collect())
    total, at, slots, want = sum(n for _, n, _ in rows), 0, collections.Counter(), collections.Counter()
    for _, n, crc in rows:
        shard = min(23, (2 * at + n) * 24 // (2 * total))
        want[n, crc, shard, slots[shard]] += 1
        slots[shard] += 1
        at += n
    assert collections.Counter((r["size"], r.text_crc32, r.shard, r.slot) for r in rows_of(spark, tables, "op2_sharding")) == want


def test_line_dedup(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    rows = collected(docs, "doc_id", "text", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    want = [(i, n, None if t is None else len(t), md5(t)) for i, t, n in plain_runs(rows)]
    got = [(r.doc_id, r.n_removed, r.n_chars, r.text_md5) for r in rows_of(spark, tables, "op3_line_dedup")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_quality(spark, tables):
    got = rows_of(spark, tables, "op4_quality_rules")
    counts = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert counts == sorted(((i is None, i or 0), *plain_counts(t)) for i, t, _ in tables[1])
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    # the verdict is the threshold's: it parts all scores
    judged = [r for r in got if not r.base_failed]
    kept, gone = [r.anomaly for r in judged if r.kept], [r.anomaly for r in judged if not r.kept]
    assert kept and (not gone or max(kept) < min(gone))


def test_quality_verdict_is_that_of_plain_trees(spark, tables, monkeypatch):
    """Each row's score by walking the trees that were grown, and the threshold by trying all."""
    made, grow = [], quality.grow
    monkeypatch.setattr(quality, "grow", lambda *a: made.append(grow(*a)) or made[-1])
    got = [r for r in rows_of(spark, tables, "op4_quality_rules") if not r.base_failed]
    forest = made[0]

    def depth(t, x):
        node = 0
        while forest.feature[t][node] >= 0:
            node = forest.left[t][node] + int(x[forest.feature[t][node]] >= forest.cut[t][node])
        return forest.path[t][node]

    mean = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    want = collections.defaultdict(set)
    for i, t, _ in tables[1]:
        x = quality.features(np.array([quality.count_rules((t or "").encode())]))[0]
        want[i].add(round(2.0 ** (-sum(depth(k, x) for k in range(len(forest.feature))) / len(forest.feature) / mean(forest.psi)), 9))
    assert all(round(r.anomaly, 9) in want[r.doc_id] for r in got) and len(got) > 100
    good = {100 + i: i % 7 != 0 for i in range(120)}
    judged = [(r.anomaly, good[r.doc_id], r.kept) for r in got if r.doc_id in good]
    fine, poor = sum(g for _, g, _ in judged), sum(not g for _, g, _ in judged)
    gain = lambda gone: sum(not g for g in gone) * fine - 4 * sum(gone) * poor
    tries = [[g for a, g, _ in judged if a > cut] for cut in [0.0, *(a for a, _, _ in judged)]]
    best = max(gain(gone) for gone in tries if sum(gone) <= quality.FALSE_REJECTS * fine)
    assert gain([g for _, g, kept in judged if not kept]) == best


def test_near_duplicates(spark, tables):
    got = [(r.doc_id, r.class_id) for r in rows_of(spark, tables, "op5_minhash_neardup")]
    assert sorted(got, key=str) == sorted(plain_classes([(i, t) for i, t, _ in tables[1]]), key=str)


def test_packing(spark, tables):
    from tokenizers import Tokenizer

    from contactspark.llm.packing import default_tokenizer

    model = Tokenizer.from_file(default_tokenizer())
    want = collections.Counter()
    for i, t, _ in tables[1]:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            want[i, n, at, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))] += 1
    got = rows_of(spark, tables, "op6_best_fit_packing")
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    room = []  # best fit decreasing, piece by piece
    for n in sorted((r.length for r in got), reverse=True):
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 2048) - n)
    assert len(by) == len(room)


def test_mixing(spark, tables):
    got = rows_of(spark, tables, "op7_source_mixing")
    size = lambda t: len(re.findall(WORD, t or ""))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r["size"]) for r in got) == sorted(((i is None, i or 0), size(t)) for i, t, _ in tables[1])
    sizes, most = collections.Counter(), collections.Counter()
    for _, t, s in tables[1]:
        sizes[s] += size(t)
        most[s] = max(most[s], size(t))
    target, taken = plain_targets(dict(sizes)), collections.Counter()
    source = {(i, size(t)): s for i, t, s in tables[1]}
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        # copies are the mean's whole part or one more
        assert not sizes[s] or r.copies in (int(target[s] / sizes[s]), int(target[s] / sizes[s]) + 1)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s]
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, rows_of(spark, tables, "op7_source_mixing")))


def test_personal_data(spark, tables):
    got = rows_of(spark, tables, "op8_pii")
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = []
    for i, t, _ in tables[1]:
        spans = plain_spans(t)
        n = collections.Counter(k for k, _, _ in spans)
        want.append((str(i), n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(spans).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    text = {str(i): t for i, t, _ in tables[1]}
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert {tuple([k, int(a), int(b)]) for k, a, b in spans} >= set(plain_spans(text[str(r.doc_id)])) if r.doc_id is not None else True
    assert all("iban" in r.spans for r in got if r.doc_id is not None and 600 <= r.doc_id < 608)


def test_every_query_stands_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] + ["pipeline"]:
        assert entry.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_pipeline_on_odd_tables(spark, tables):
    """Nulls, repeated rows and further columns (some of clashing names) go through all stages."""
    pieces = rows_of(spark, tables, "pipeline")
    ids = {i for i, _, _ in tables[1]}
    assert pieces and {r.doc_id for r in pieces} <= ids and max(r.length for r in pieces) <= 2048
