"""The registered queries of the training-data operators, next to DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bitplanes,
    curve_ann,
    entropy_mix,
    four_russians,
    jaccard_tree,
    katz,
    line_dedup,
    periodic_runs,
    quality,
    secret_forest,
    simhash_variants,
    sp_bpe,
    warc,
)
from .common import LOWER, UPPER, table, words

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RUN = r"[\x20\x09-\x0D]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = sql
        return fn

    return add


def spark_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def duckdb_queries() -> dict[str, str]:
    return dict(_ORACLES)


@query(
    """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS sha, strlen(coalesce(html, '')) AS n FROM pages),
    k AS (SELECT page_id, sha, n, max(page_id) OVER (PARTITION BY sha, n) AS keeper FROM p)
    SELECT page_id, n AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(sha, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
      CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id < keeper THEN keeper END AS refers_to
    FROM k"""
)
def op1_warc_archive(spark, sf_dir):
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_katz_scores(spark, sf_dir):
    return katz.score(table(spark, sf_dir, "documents"))


@query()
def op3_jaccard_join(spark, sf_dir):
    df = jaccard_tree.linked(table(spark, sf_dir, "documents"), width=3, percent=90, counted=True)
    return df.select("doc_id", "n_shingles", "component_id", "n_links")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS line_key FROM l),
    c AS (SELECT line_key, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS keeper FROM k WHERE length(line_key) >= 10 GROUP BY line_key),
    j AS (SELECT k.*, coalesce(c.n_docs >= 2 AND k.doc_id <> c.keeper, false) AS lost FROM k LEFT JOIN c ON k.line_key = c.line_key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
    FROM j GROUP BY doc_id"""
)
def op4_line_dedup(spark, sf_dir):
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("_lines_n").alias("n_lines"),
        F.col("_lines_dropped").alias("n_dropped"),
        F.sha2(F.encode("_lines_text", "UTF-8"), 256).alias("kept_sha256"),
    )


@query()
def op5_curve_ann(spark, sf_dir):
    return curve_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op6_bit_planes(spark, sf_dir):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bitplanes.store_tokens(table(spark, sf_dir, "documents"), f.read(), end_id=2)


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


@query(
    rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '{_RUN}'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACES}) <> '') AS lines FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
    q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+7]) AS times FROM p),
    s AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS reach FROM q WHERE times > 1),
    r AS (SELECT doc_id, sum(reach) AS n FROM s GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '{_RUN}', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(t, '[^!?]', '', 'g')) AS n_shouts,
        len(list_filter(w, lambda x: lower(trim(x, '.,;:!?')) IN ({_STOP}))) AS n_stop_words,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 12.0 * n_words AND n_symbols <= 0.25 * n_words
        AND n_shouts <= 0.5 * n_words AND n_stop_words / n_words >= 0.02 AND n_dup_lines <= 0.5 * n_lines
        AND n_repeat_words / n_words <= 0.3 AS kept
    FROM b"""
)
def op7_quality_rules(spark, sf_dir):
    df = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select(
        "doc_id",
        *[F.col("_quality")[m].alias(m) for m in base],
        F.col("_quality_failed").alias("base_failed"),
        F.col("_quality_kept").alias("kept"),
    )


@query()
def op8_entropy_mix(spark, sf_dir):
    mixed = entropy_mix.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op9_byte_bpe(spark, sf_dir):
    model = sp_bpe.serialise(sp_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return sp_bpe.round_trip(table(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)


@query()
def op10_secret_forest(spark, sf_dir):
    return secret_forest.scan(table(spark, sf_dir, "documents"))


@query()
def op11_simhash_variants(spark, sf_dir):
    df = simhash_variants.linked(table(spark, sf_dir, "documents"), width=3)
    return df.select("doc_id", simhash_variants.as_hex("fingerprint").alias("fingerprint"), "component_id")


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
        CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
)
def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = four_russians.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``documents`` with every tenth text, by a hash of doc_id, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, g = words(F.col("text")), F.floor(h / 10)
    n = F.size(w)
    first = g % n
    period = 1 + F.floor((n - first) / (3 + g % 8))
    times = F.ceil((n - first) / period)
    tail = F.flatten(F.array_repeat(F.slice(w, (first + 1).cast("int"), period.cast("int")), times.cast("int")))
    planted = F.concat(F.slice(w, F.lit(1), first.cast("int")), F.slice(tail, F.lit(1), (n - first).cast("int")))
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark, sf_dir):
    done = periodic_runs.collapse(with_planted_periods(table(spark, sf_dir, "documents")))
    best = periodic_runs.longest(F.col("runs"))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(F.transform("runs", line), ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
