"""Quality rules, line dedup, BPE and token files against plain Python versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from halospark.llm import bitplanes, entropy_mix, jaccard_tree, line_dedup, quality, sp_bpe

LONG = " ".join(f"w{i % 700} the" for i in range(20_000))
TEXTS = [
    None,
    "",
    "   \t\n",
    "one",
    "The cat sat on the mat and the dog of the house was by the door in the sun with it as well as a bird",
    "a b c d e f g h " * 5,
    "the of and to in is that for " * 2 + "x y z the of and to in is that for",
    "line of the text\nline of the text\n  LINE OF THE TEXT \n\n\nshort\nshort",
    "Äpfel und Birnen im Garten \x0b tab\there\x0c form\r\nfeed # $ % & | <tag> ***",
    "SHOUT!! AT!! THE!! WORLD!! " * 10,
    LONG,
]


def docs_of(rows, texts=TEXTS, extra=True):
    data = [(i, t, "de", f"s{i % 3}", i, f"keep{i}", 1.5) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, `_lines_pos` double"
    df = rows(schema, data)
    return df if extra else df.select("doc_id", "text")


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_metrics(text):
    text, words = text or "", plain_words(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_quality_metrics_equal_plain_counts(rows):
    got = quality.judged(docs_of(rows)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = plain_metrics(TEXTS[r.doc_id])
        assert {k: r["_quality"][k] for k in want} == want, r.doc_id
        assert r["_quality_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (r["_quality_failed"] and r["_quality_kept"])


def test_quality_keeps_rows_and_columns(rows):
    df = docs_of(rows)
    kept = quality.keep_good(df)
    assert kept.schema == df.schema
    ids = {r.doc_id for r in kept.collect()}
    assert 4 in ids and not ids & {0, 1, 2, 3, 5, 9}
    assert quality.keep_good(df.limit(0)).count() == 0
    assert quality.keep_good(df.union(df)).count() == 2 * len(ids)


def test_quality_rules_are_a_table(rows):
    df = rows("doc_id long, text string", [(1, "a b"), (2, "a b c")])
    rules = (quality.Rule("words", "n_words", lowest=3), quality.Rule("none", "n_lines", "n_shouts", highest=0))
    m = {c: F.col("_quality")[c] for c in quality.METRICS}
    got = quality.metrics(df).select("doc_id", quality.verdict(m, rules).alias("ok")).collect()
    assert {r.doc_id: r.ok for r in got} == {1: False, 2: True}


def plain_dedup(docs, min_chars=10, min_docs=2):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc_id is not None:
                held.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held.get(key(x), ())) >= min_docs and min(held[key(x)]) != doc_id)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_equals_plain(rows):
    rng = random.Random(1)
    pool = [f"shared line number {i}" for i in range(6)] + ["Shared LINE number 1 ", "tiny", "", "äöüÄÖÜß äöü"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, pool[0] + "\nits own line here"), (None, None), (7, docs[7][1]), (8, "another version of eight")]
    docs += [(200, "\n".join(f"line {k} of a long text" for k in range(5000))), (201, "\n".join(f"line {k} of a long text" for k in range(0, 5000, 2)))]
    df = rows("doc_id long, text string", docs)
    got = line_dedup.dedup_lines(df).collect()
    want = plain_dedup(docs)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r["_lines_text"], r["_lines_n"], r["_lines_dropped"]) for r in got), key=order) == sorted(want, key=order)


def test_line_dedup_thresholds_and_shape(rows):
    docs = [(1, "aaaaaaaaaaaa\nb"), (2, "aaaaaaaaaaaa"), (3, "AAAAAAAAAAAA\nc")]
    df = rows("doc_id long, text string, n_chars long, lang string", [(*d, len(d[1]), "x") for d in docs])
    three = {r.doc_id: r["_lines_dropped"] for r in line_dedup.dedup_lines(df, min_docs=3).collect()}
    four = {r.doc_id: r["_lines_dropped"] for r in line_dedup.dedup_lines(df, min_docs=4).collect()}
    assert three == {1: 0, 2: 1, 3: 1} and four == {1: 0, 2: 0, 3: 0}
    out = line_dedup.replace_text(df)
    assert out.schema == df.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (docs[0][1], 14), 2: ("", 0), 3: ("c", 1)}
    assert line_dedup.replace_text(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return sp_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_tiktoken_and_decodes(rows, ranks):
    own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens={})
    rng = random.Random(2)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x2000, 0x2100), rng.randrange(0x1F300, 0x1F600), 10, 32])) for _ in range(200)) for _ in range(30)]
    texts = [*TEXTS, *odd, "<|endoftext|>", "x" * 5000, "it's we'll  \n\n  12345"]
    df = rows("doc_id long, text string, ids string", list(zip(range(len(texts)), texts, ["mine"] * len(texts))))
    model = sp_bpe.serialise(ranks)
    got = {r.doc_id: r for r in sp_bpe.round_trip(df, model, P.PATTERN).collect()}
    assert len(got) == len(texts)
    coded = sp_bpe.encode(df.drop("ids"), model, P.PATTERN)
    raw = {r.doc_id: bytes(r.bytes) for r in sp_bpe.decode(coded, model).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, i
        assert raw[i] == (t or "").encode()
    assert sp_bpe.round_trip(df.limit(0), model, P.PATTERN).count() == 0


def test_bpe_refuses_ranks_with_gaps(ranks):
    with pytest.raises(ValueError):
        sp_bpe.serialise({b"a": 0, b"b": 2})


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 2), (1000, 49408), (bitplanes.BLOCK, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        assert (bitplanes.from_planes(bitplanes.to_planes(ids), n) == ids).all()


def test_token_files_equal_the_library(spark, rows):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    tokenizer = Tokenizer.from_str(definition)
    texts = [*TEXTS, "é ́a  x y", "<|endoftext|> a<|startoftext|>b", "don't WE'LL 123"] * 3
    data = list(zip(range(len(texts)), texts)) + [(None, "no id"), (4, TEXTS[4])]
    random.Random(4).shuffle(data)
    df = rows("doc_id long, text string, start string", [(*d, "mine") for d in data]).repartition(5)
    got = bitplanes.store_tokens(df, definition, end_id=2).orderBy("start").collect()
    at, want = 0, []
    for doc_id, text in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert bitplanes.store_tokens(df.limit(0), definition, end_id=2).count() == 0


def test_columns_named_like_working_columns_pass_unchanged(rows):
    """Every working name of the document stages as a column of the input."""
    names = [f"_quality{x}" for x in ("", "_w", "_lines", "_h", "_win", "_ranked", "_starts", "_failed", "_kept")]
    names += [f"_lines_{x}" for x in ("id", "version", "pos", "parts", "kept", "text", "n", "dropped")]
    names += ["_lost", *(f"_mix_{x}" for x in ("id", "version", "n", "rows", "row", "share", "copy"))]
    names += ["h1", "h2", "keeper", "n_docs", "hot1", "component", "node", "size", "target", "copies", "_MIX_N", "__lines"]
    names = [n for k, n in enumerate(names) if n.lower() not in {m.lower() for m in names[:k]}]
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    texts = [" ".join(rng.choice(words) for _ in range(60)) + "\na line that all documents share" for _ in range(30)]
    docs = [(k, t, "en", "ab"[k % 2], len(t), *[f"mine {k}"] * len(names)) for k, t in enumerate([*texts, texts[0], texts[1] + " x"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    df = rows(schema, docs).repartition(3)
    plain = df.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (quality.keep_good, line_dedup.replace_text, jaccard_tree.one_of_each, entropy_mix.mix):
        got, want = stage(df), stage(plain)
        assert got.schema == df.schema
        assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, want.collect()))
        for r in got.collect():
            assert all(r[n] == f"mine {r.doc_id}" for n in names)
    assert line_dedup.dedup_lines(plain, into="own").columns[-3:] == ["own_text", "own_n", "own_dropped"]
    for clash in (quality.judged, line_dedup.dedup_lines):
        with pytest.raises(ValueError, match="another prefix"):
            clash(df)


def test_line_in_a_third_of_all_rows(rows, monkeypatch):
    """Hot keys are dropped like any other, also where the keeper has no doc_id."""
    docs = [(k, "the common line of many\nown line number %d" % k) for k in range(600)]
    docs += [(None, "the common line of many")] + [(1000 + k, f"pair line {k // 2:05d}\nx") for k in range(1200)]
    df = rows("doc_id long, text string", docs).repartition(3)
    want = {}
    for most_hot in (1, 5, 10**9):
        monkeypatch.setattr(line_dedup, "MOST_HOT", most_hot)
        got = {r.doc_id: (r["_lines_text"], r["_lines_dropped"]) for r in line_dedup.dedup_lines(df).collect()}
        want = want or got
        assert got == want and len(got) == 1801
    assert got[0][1] == 0 and got[599] == ("own line number 599", 1) and got[None] == ("", 1) and got[1001] == ("x", 1)
