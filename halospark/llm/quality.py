"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every document is judged in its own row: no shuffle, no user function.  Metrics are counted once, in a few stacked
projections (so that no array is built twice), and each rule is a ratio of metrics with a lowest and a highest value.

Cases: a NULL text counts as empty and fails the length rule; empty and very short texts fail; ratios with nothing
below the line are 0; repeated rows are judged alike; other columns of the input, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, check_prefix, free_prefix, stripped, words

WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is that for it with as was on be by this are from at or an a
de la le les et des en un une du que qui dans pour est au sur par avec
der die und das den von zu mit ist im dem nicht ein eine auf für sich
el los las y del se con por su al lo como
""".split()

SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"


@dataclass(frozen=True)
class Rule:
    """``above / below`` must lie in [lowest, highest]; a missing ``below`` means the metric itself."""

    name: str
    above: str
    below: str | None = None
    lowest: float | None = None
    highest: float | None = None


#: The thresholds in production.  Ratios per word, per line or per character, see :func:`metrics`.
RULES = (
    Rule("length", "n_words", lowest=20),
    Rule("word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", highest=0.25),
    Rule("shouting", "n_shouts", "n_words", highest=0.5),
    Rule("stop words", "n_stop_words", "n_words", lowest=0.02),
    Rule("repeated lines", "n_dup_lines", "n_lines", highest=0.5),
    Rule("repeated words", "n_repeat_words", "n_words", highest=0.3),
)


def ratio(above: Column, below: Column | None) -> Column:
    return above.cast("double") if below is None else F.coalesce(above / F.nullif(below, F.lit(0)), F.lit(0.0))


def verdict(metric: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules in one boolean expression."""
    keep = F.lit(True)
    for rule in rules:
        value = ratio(metric[rule.above], metric[rule.below] if rule.below else None)
        if rule.lowest is not None:
            keep = keep & (value >= rule.lowest)
        if rule.highest is not None:
            keep = keep & (value <= rule.highest)
    return keep


def _count_without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


METRICS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def metrics(docs: DataFrame, text: str = "text", into: str = "_quality") -> DataFrame:
    """``docs`` with one more column ``into``, a struct of :data:`METRICS` (all long).

    n_repeat_words counts the words inside windows of eight words that occur twice or more in the text: equal windows
    are found by sorting the hashes of the row's own windows, so a very long text costs n log n in its own task.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    w, lines, hashes, wins, ranked, starts = (f"{into}_{x}" for x in ("w", "lines", "h", "win", "ranked", "starts"))
    none = F.array().cast("array<int>")
    df = docs.withColumns(
        {
            w: words(F.col(text)),
            lines: F.filter(F.split(own, "\n", -1), lambda x: stripped(x) != ""),
        }
    )
    df = df.withColumn(hashes, F.transform(w, lambda x: F.xxhash64(x)))
    window = lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)])
    some = F.size(hashes) >= WINDOW
    df = df.withColumn(
        wins,
        F.when(some, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    ordered = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(
        ranked, F.when(F.size(F.array_distinct(wins)) < F.size(wins), ordered).otherwise(F.slice(ordered, 1, 0))
    )
    same = lambda x, k: F.coalesce(F.get(F.col(ranked), k)["h"] == x["h"], F.lit(False))
    again = F.filter(ranked, lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn(starts, F.coalesce(F.array_sort(F.transform(again, lambda x: x["i"])), none))
    reach = lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(starts), k + 1) - p, F.lit(WINDOW)))
    covered = F.aggregate(F.transform(starts, reach), F.lit(0), lambda a, x: a + x)
    stop = F.size(F.filter(w, lambda x: F.lower(F.trim(x, F.lit(".,;:!?"))).isin(STOP_WORDS)))
    value = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(own, SPACES, "")),
        "n_symbols": _count_without(own, SYMBOLS),
        "n_shouts": _count_without(own, SHOUTS),
        "n_stop_words": stop,
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
    }
    # as a generator's output the metrics are worked out once: a filter on them is not pushed into the projections
    one = F.array(F.struct(*[value[m].cast("long").alias(m) for m in METRICS]))
    return df.select(*[F.col(c) for c in docs.columns], F.explode(one).alias(into))


def base_failed(metric: dict[str, Column]) -> Column:
    return (metric["n_words"] < 20) | (100 * metric["n_repeat_words"] > 30 * metric["n_words"])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "_quality") -> DataFrame:
    """``docs`` with ``into`` (the metrics) and ``into_failed``, ``into_kept``."""
    check_prefix(docs, into)
    df = metrics(docs, into=into)
    m = {name: F.col(into)[name] for name in METRICS}
    df = df.withColumn(f"{into}_failed", base_failed(m))
    return df.withColumn(f"{into}_kept", ~F.col(f"{into}_failed") & verdict(m, rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    into = free_prefix(docs, "_quality")
    return judged(docs, rules, into=into).where(F.col(f"{into}_kept")).select(*docs.columns)
