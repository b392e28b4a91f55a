"""The pipeline against a version that works on Python lists, and the registered queries."""

import base64
import hashlib
import os
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from halospark.llm import quality
from test_similarity import plain_classes
from test_text_operators import plain_dedup, plain_metrics
from test_warc_and_mix import plain_targets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_kept(text):
    m = plain_metrics(text)
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    m["n_shouts"] = sum(c in "!?" for c in text or "")
    m["n_stop_words"] = sum(w.strip(".,;:!?").lower() in quality.STOP_WORDS for w in words)
    if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
        return False
    for rule in quality.RULES:
        value = m[rule.above] / (m[rule.below] or 1) if rule.below else m[rule.above]
        if (rule.lowest is not None and value < rule.lowest) or (rule.highest is not None and value > rule.highest):
            return False
    return True


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    names = list(steps)
    assert len(names) == 5
    kept = steps[names[0]](spark, docs, SF)
    assert kept.columns == COLUMNS
    want = [r.doc_id for r in docs.collect() if plain_kept(r.text)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)

    clean = steps[names[1]](spark, kept, SF)
    assert clean.schema == kept.schema
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id: r.text for r in clean.collect()} == {d: t for d, t, _, _ in plain_dedup(texts)}

    single = steps[names[2]](spark, clean, SF)
    assert single.schema == clean.schema
    classes = plain_classes([(r.doc_id, r.text) for r in clean.collect()], 5, 80)
    rows = single.collect()
    assert {r.doc_id for r in rows} == {*classes.values()}

    mixed = steps[names[3]](spark, single, SF)
    assert mixed.columns == COLUMNS
    size, target = plain_targets([(r.doc_id, r.text, r.source) for r in rows])
    taken = {s: 0 for s in size}
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    for s in size:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 60), s

    coded = steps[names[4]](spark, mixed, SF)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in rows}
    for r in coded.collect():
        ids = np.array(bpe.encode_ordinary(text[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered_queries_cover_their_tables(spark):
    queries = entry.queries()
    assert [n for k in range(1, 11) for n in queries if n.startswith(f"op{k}_")].__len__() == 10 and "pipeline" in queries
    n_docs, n_pages = spark.read.parquet(f"{SF}/documents.parquet").count(), spark.read.parquet(f"{SF}/pages.parquet").count()
    for name in ("op2_katz_scores", "op3_jaccard_join", "op6_bit_planes", "op8_entropy_mix", "op9_byte_bpe"):
        got = queries[name](spark, SF)
        assert got.count() == got.select("doc_id").distinct().count() == n_docs, name
    assert queries["op1_warc_archive"](spark, SF).count() == n_pages
    assert queries["op10_secret_forest"](spark, SF).count() > 0
    assert queries["op5_curve_ann"](spark, SF).count() == 5 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()


def test_queries_repeat_themselves(spark):
    run = lambda: sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert run() == run()
