"""The pipeline's stages one by one on a small table, each held against what it should do with its own input."""

import collections
import re

import corpus_pipeline
from contactspark.llm import packing

from .test_corpus import DOCS, WORD, plain_classes, plain_targets, prose, words


def test_stages(spark, tmp_path):
    passage = prose(80, 12, per_line=6)
    rows = [(i, prose(60 + i % 60, i), "en", f"s{i % 3}", 1) for i in range(150)]
    rows += [(200 + i, " | ".join(words(60, i)), "en", "s0", 1) for i in range(25)]
    rows += [(300 + i, f"{prose(100, 900 + i)}\n{passage}", "de", "s1", 1) for i in range(6)]
    rows += [(400, prose(60, 0), "en", "s2", 1), (500, None, "en", "s2", 1), (501, "", "en", None, 1), (502, "few words", "en", "s2", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100)] + [(200 + i, 0, 0) for i in range(15)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, held = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    good, lined, near, mixed, packed = held.values()

    kept = {r.doc_id for r in good}
    assert len(kept & set(range(150))) >= 147 and not kept & {500, 501, 502} and not any(200 <= i < 225 for i in kept)
    assert {r.doc_id for r in lined} == kept and all(r.n_chars == len(r.text) or r.n_chars == 1 for r in lined)
    inner = "\n".join(passage.split("\n")[3:-3])
    assert sum(inner in r.text for r in lined) <= 1
    classes = plain_classes([(r.doc_id, r.text) for r in lined])
    assert sorted(r.doc_id for r in near) == sorted({c for _, c in classes})
    count = lambda t: len(re.findall(WORD, t))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in near:
        sizes[r.source] += count(r.text)
    for r in mixed:
        taken[r.source] += count(r.text)
    assert max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    for s, target in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= 150
    tokens = sum(len(x) // 4 + 1 for x in packing.encode([r.text.encode() for r in mixed], packing.default_tokenizer()))
    assert sum(r.length for r in packed) == tokens and max(r.offset + r.length for r in packed) <= packing.SEQUENCE
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)
