"""Line deduplication: hash normalised lines, count documents per hash, drop the common ones, put the rest together.

Only hashes travel: one 128-bit hash per distinct line of a document is counted (partial sums first, so a line that
every document has is no hot key), and each document learns which of its line keys to drop; keys that very many documents
share are sent to the lines instead.  The text itself is shuffled once, by document, when the kept lines are joined in
their old order.

Cases: a NULL or empty text is one empty line; keys shorter than ``min_chars`` are never dropped; of the documents
that hold a key the smallest doc_id keeps all its lines with it; a row with a NULL doc_id counts for nothing and
keeps nothing but drops what others share; rows repeated under one doc_id are one document; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from halospark.operators.lineage import cut_lineage

from .common import check_prefix, fold, free_prefix, stripped

#: Keys that are so common that they are kept out of the shuffle by hash: fewer than this, twenty-four bytes each.
MOST_HOT = 1000


def line_key(line: Column) -> Column:
    return fold(stripped(line))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def common_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> tuple[DataFrame, DataFrame]:
    """Line hashes by document (doc_id, version, pos, h1, h2), and the common hashes (h1, h2, n_docs, keeper).

    ``version`` tells rows of one doc_id with different texts apart.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    hashed = keyed.select(
        "doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )
    held = hashed.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("keeper"))
    return hashed, held.where(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs", "keeper")


def lost_lines(hashed: DataFrame, common: DataFrame) -> DataFrame:
    """The line hashes that a document other than the keeper has in common with others.

    The common hashes are written with the sum of their documents.  Those with more than a share of 1 / MOST_HOT of it, of
    which there are fewer than MOST_HOT, go to all tasks, and the lines that have them are not shuffled by their hash.
    """
    seen = Observation()
    written = cut_lineage(common.observe(seen, F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")))
    often = F.col("n_docs") > seen.get["n"] / MOST_HOT
    hot = written.where(often).select(F.col("h1").alias("hot1"), F.col("h2").alias("hot2"), F.col("keeper").alias("hot_keeper"))
    marked = hashed.join(F.broadcast(hot), (F.col("h1") == F.col("hot1")) & (F.col("h2") == F.col("hot2")), "left")
    # lines with a hot key meet nothing more: they are dealt by document and place
    is_hot = F.col("hot1").isNotNull()
    placed = marked.withColumns({"h1": F.when(is_hot, F.xxhash64("doc_id", "pos")).otherwise(F.col("h1")), "cold": ~is_hot})
    others = written.where(~often).select("h1", "h2", F.lit(True).alias("cold"), "keeper", F.lit(True).alias("met"))
    met = placed.join(others, ["h1", "h2", "cold"], "left").where(~F.col("cold") | F.col("met"))
    keeper = F.when(F.col("cold"), F.col("keeper")).otherwise(F.col("hot_keeper"))
    return met.where(~F.col("doc_id").eqNullSafe(keeper))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, into: str = "_lines") -> DataFrame:
    """``docs`` with columns ``into_text`` (kept lines), ``into_n`` (lines before) and ``into_dropped`` (lines lost)."""
    check_prefix(docs, into)
    lost = lost_lines(*common_lines(docs, min_chars, min_docs))
    drop = lost.groupBy(F.col("doc_id").alias(f"{into}_id"), F.col("version").alias(f"{into}_version")).agg(
        F.collect_list("pos").alias(f"{into}_pos")
    )
    df = docs.join(
        drop,
        F.col("doc_id").eqNullSafe(F.col(f"{into}_id")) & (F.xxhash64("text") == F.col(f"{into}_version")),
        "left",
    )
    parts, none = f"{into}_parts", F.array().cast("array<int>")
    df = df.withColumn(parts, lines_of(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce(F.col(f"{into}_pos"), none))
    df = df.withColumn(f"{into}_kept", kept)
    return df.select(
        *[docs[c] for c in docs.columns],
        F.array_join(F.transform(f"{into}_kept", lambda i: F.get(F.col(parts), i)), "\n").alias(f"{into}_text"),
        F.size(parts).cast("long").alias(f"{into}_n"),
        (F.size(parts) - F.size(f"{into}_kept")).cast("long").alias(f"{into}_dropped"),
    )


def replace_text(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept lines as text; a NULL text stays NULL.  n_chars, where present, follows the text."""
    into = free_prefix(docs, "_lines")
    df = dedup_lines(docs, **options, into=into)
    text = F.when(F.col("text").isNotNull(), F.col(f"{into}_text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(f"{into}_dropped") == 0, F.col("n_chars")).otherwise(F.length(f"{into}_text")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
