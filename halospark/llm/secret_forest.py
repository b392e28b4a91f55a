"""Secret scan: find long opaque strings, then let a random forest remove the false positives.

A candidate is a run of at least MIN_CHARS key characters, a value of 8 or more characters behind a name that tells of a
secret, a token of dotted parts, an armoured private key, or the user:password of a URL.  Documents are scanned once by a
regular expression; those with candidates are cut at them, so the words before and after are at hand.  A forest,
trained on labelled findings, scores each candidate by its length, its character transitions, how much of it dictionary
words cover, the path it was found under, and the words around it.  Only built-in functions and Spark's own forest run.
Candidates fall into FOLDS by a hash of their text; each is scored by a forest that was fitted on the other folds and so
has not seen it, nor a copy of it.

The dictionary is counted over all documents: every word that a share of MIN_SHARE of them holds.  A forest is fitted on at most about
TRAIN_ROWS labelled findings of each class (drawn by a hash of the candidate, the rate worked out from all counts);
everything else covers all documents.

Cases: a NULL or empty text has no candidates; a NULL path is a path of its own; a candidate at the very start or end
of a text has an empty neighbour; the same candidate found again is scored each time; rows repeated are scanned alike;
a bare run that touches a letter outside ASCII is part of a word and no candidate unless it has a known format; a value
behind a name may hold any; names and values have no longest length, of the words before and after at most
NEIGHBOUR_CHARS characters count; where the other folds lack labelled findings of one kind there is nothing to learn
from and the label itself is the score; a NULL candidate among ``labels`` meets none, a NULL label is no label, any
label but 0 counts as 1; an empty table has no findings; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halospark.operators.lineage import cut_lineage

MIN_CHARS = 16
KEY_CHARS = r"A-Za-z0-9_+/=\-"
#: What follows :// where a URL has user and password.
LOGIN = r"""[^\s/:@"'<>]++:[^\s/@"'<>]{3,}+@"""
LONG_RUN = rf"(?<![\p{{L}}\p{{N}}_+/=\-])(?!//{LOGIN})[{KEY_CHARS}]{{{MIN_CHARS},}}+(?!\p{{L}})"
TRAIN_ROWS, PATHS, NEIGHBOUR_CHARS = 10_000, 16, 64
MIN_SHARE, MIN_DOCS = 0.001, 2
TREES, DEPTH, SEED, FOLDS = 20, 6, 7, 2

#: Words that stand next to or inside a secret's assignment.
HINTS = "(?i)(pass|pwd|secret|token|key|auth|bearer|credential|aws|private)"

#: Names whose value is a secret, and what joins a name to its value.
NAMES = (
    r"(?:pass|passw(?:or)?d|passphrase|pwd|secret|token|pat|credentials?|auth|authorization|bearer"
    r"|(?:api|access|secret|private|auth|account|encryption|signing|client|master|storage)[_.\- ]?(?:key|token|secret)(?:[_.\-]?id)?"
    r"|passwort|kennwort|geheimnis|zugangsdaten|mot[_\- ]?de[_\- ]?passe|mdp|jeton|contrase[ñÑn]a|clave|secreto|credencial(?:es)?)"
)
JOINED = r"""["'`]?\s{0,3}(?::=|=>|->|==|[=:>])\s{0,3}["'`]?(?:(?:Bearer|Basic|Token)\s+)?"""
PLACEHOLDER = r"(?:[$%{<\[(]|[x*.#]{6}|0{6}|your|change_?me|placeholder|redacted|dummy|none|null|undefined|process\.env|os\.environ|getenv)"

#: Known formats that need no company, wherever they stand in a candidate.
KNOWN_FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9\-]{10,}",
    r"AIza[A-Za-z0-9_\-]{35}",
    r"ya29\.[A-Za-z0-9_\-]{20,}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"sk-(?:[a-z]+-)*(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_]{20,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_\-]{50,}",
    r"do[opr]_v1_[0-9a-f]{64}",
    r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    r"SK[0-9a-f]{32}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
)
FORMAT = r"(?<![A-Za-z0-9])(?:" + "|".join(KNOWN_FORMATS) + r")(?![A-Za-z0-9])|PRIVATE KEY(?: BLOCK)?-----|^[^\s/:@]+:[^\s/@]+@$"

#: A value behind the name of a secret: any behind a bare =, else one with a digit or with letters of both cases.
ASSIGNED = (
    rf"(?i:{NAMES}(?:=(?!{PLACEHOLDER})|{JOINED}(?!{PLACEHOLDER})(?=\S*[0-9]|\S*(?-i:[a-z]\S*[A-Z]))))"
    r"""[^\s"'`<>]{8,}|(?i:"""
    + NAMES
    + r""")["'`]?\s{0,3}[=:]\s{0,3}["'](?=[^"']*[0-9])[^"']{8,}["']"""
)
#: Opaque strings that are a secret only in company: a name of a secret just before them, and no word for a digest.
OPAQUE = r"^(?=[^0-9]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}$"
NAMED = rf"(?i){NAMES}[^\p{{L}}\p{{N}}]*(?:is|was)?[^\p{{L}}\p{{N}}]*$"
DIGEST = r"(?i)(?:commit|\bsha|sha-?[0-9]|md5|checksum|digest|hash(?!i)|\brev|revision|etag|integrity|blob|\btree\b|\bparent\b|merge|fingerprint|uuid|guid|public|cache)"

#: A name that tells of a secret, a separator, and a value of 8 or more characters, quoted (spaces included) or bare.
#: A bare value ends at the next parameter (&name=, ;name=); the name is tried only where a separator follows it.
_NAME_END = r"""["'`]?\s{0,3}(?::=|=>|->|==|[=:>])\s{0,3}"""
BY_NAME = (
    rf"(?<![\p{{L}}\p{{N}}_+/.\-])-{{0,2}}(?=[\p{{L}}\p{{N}}_./\-]++{_NAME_END}\S)"
    r"(?=[\p{L}\p{N}_./\-]*?(?i:pass|pwd|pw\b|secret|token|key|auth|bearer|cred|private|api|\bpat\b|_pat\b|session|cookie|signature|\bpin\b"
    r"|kennwort|geheim|schl(?:[üÜ]|ue)ssel|zugang|\bmdp\b|jeton|contrase[ñÑn]a|clave))"
    rf"[\p{{L}}\p{{N}}_./\-]++{_NAME_END}"
    r"""(?:"[^"\r\n]{8,}+"|'[^'\r\n]{8,}+'|["'`]?(?:(?i:Bearer|Basic|Token)\s{1,3})?(?=[^\s"'`<>]{8})"""
    r"""[^\s"'`<>&;]++(?:[&;]++(?![\w.\-]{1,64}=)[^\s"'`<>&;]*+)*+)"""
)
#: Tokens of three parts (JWTs among them), private keys in armour, and user:password in front of a host.
DOTTED = r"(?<![\p{L}\p{N}_+/=.\-])(?:eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]*+)?|[A-Za-z0-9_\-]{2,}+\.[A-Za-z0-9_\-]{6,}+\.[A-Za-z0-9_\-]{16,}+)(?!\p{L})"
ARMOUR = r"-----BEGIN [A-Z ]{0,32}?PRIVATE KEY(?: BLOCK)?-----[^\-]*+"
IN_URL = rf"(?<=://){LOGIN}"
#: Known formats also where a letter outside ASCII touches them.
KNOWN = r"(?<![A-Za-z0-9])(?:" + "|".join(KNOWN_FORMATS) + r")(?![A-Za-z0-9])"
CANDIDATE = "|".join((ARMOUR, IN_URL, DOTTED, BY_NAME, LONG_RUN, KNOWN))
#: Closing marks that a bare value may bring along.
CLOSING = ".,;:)]}"

FEATURES = ("length", "runs", "digits", "uppers", "vowel_turns", "different", "coverage", "path", "hint_before", "hint_inside", "quoted", "words_around", "symbols")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, nth, path, candidate, before, after): every candidate of every text, in order, with its neighbours."""
    found = docs.select(
        "doc_id", F.col(path).cast("string").alias("path"), "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found")
    ).where(F.size("found") > 0)
    cut = found.withColumn("gaps", F.split("text", CANDIDATE, -1)).drop("text")
    around = F.transform(
        "found",
        lambda c, i: F.struct(
            F.rtrim(c, F.lit(CLOSING)).alias("candidate"),
            F.right(F.get(F.col("gaps"), i), F.lit(NEIGHBOUR_CHARS)).alias("left"),
            F.left(F.get(F.col("gaps"), i + 1), F.lit(NEIGHBOUR_CHARS)).alias("right"),
        ),
    )
    each = cut.select("doc_id", "path", F.posexplode(around).alias("nth", "f"))
    return each.select(
        "doc_id",
        F.col("nth").cast("long"),
        "path",
        "f.candidate",
        F.regexp_extract("f.left", r"(\S*\s*\S*)$", 1).alias("before"),
        F.regexp_extract("f.right", r"^(\S*\s*\S*)", 1).alias("after"),
    )


def dictionary(df: DataFrame) -> list[str]:
    """The words of 3 to 12 letters in at least MIN_SHARE of all documents (and in MIN_DOCS), by partial aggregates.

    The share bounds their number, whatever the size of the corpus.  ``df`` holds texts, or findings: then the words
    before and after each are its document.
    """
    text = F.col("text") if "text" in df.columns else F.concat_ws(" ", "before", "after")
    once = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))
    in_docs = df.select(F.explode(once).alias("w")).where(F.length("w").between(3, 12)).groupBy("w").count()
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * df.count()))
    return sorted(r.w for r in in_docs.where(F.col("count") >= least).collect())


def _trie(words: list[str]) -> str:
    """A pattern for the longest of many words at a place, in one step for each letter."""
    root: dict = {}
    for w in words:
        at = root
        for letter in w:
            at = at.setdefault(letter, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        rest = [letter + pattern(below) for letter, below in sorted(at.items()) if letter]
        if not rest:
            return ""
        return f"(?:{'|'.join(rest)})" + ("?" if "" in at else "")

    return pattern(root)


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate")
    small = F.lower(c)
    runs = F.length(F.regexp_replace(c, r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x"))
    turns = F.length(F.regexp_replace(F.regexp_replace(small, r"[^a-z]+", ""), r"[aeiou]+|[^aeiou]+", "x"))
    covered = _length_without(small, _trie(words)) if words else F.lit(0)
    value = {
        "length": n,
        "runs": runs / n,
        "digits": _length_without(c, "[0-9]+") / n,
        "uppers": _length_without(c, "[A-Z]+") / n,
        "vowel_turns": turns / n,
        "different": F.size(F.array_distinct(F.split(c, ""))) / n,
        "coverage": covered / n,
        "path": F.pmod(F.xxhash64("path"), F.lit(PATHS)),
        "hint_before": F.regexp_like("before", F.lit(HINTS)).cast("int"),
        "hint_inside": F.regexp_like(c, F.lit(HINTS)).cast("int"),
        "quoted": F.regexp_like("before", F.lit("[\"'`]$")).cast("int"),
        "words_around": F.size(F.filter(F.split(F.lower(F.concat_ws(" ", "before", "after")), r"[^\p{L}]+"), lambda w: w.isin(words))) if words else F.lit(0),
        "symbols": _length_without(c, r"[^A-Za-z0-9]+") / n,
    }
    return found.withColumns({name: value[name].cast("double") for name in FEATURES})


def known_format(candidate: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """1.0 where a candidate with its neighbouring words has the form of a secret, else 0.0: labels for findings that
    nobody has reviewed.

    A known format counts anywhere in the candidate; a value behind the name of a secret, and an opaque string behind
    such a name, count unless a word for a digest (commit, checksum, ...) stands with them.
    """
    around = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (before, after) if c is not None])
    name = F.regexp_extract(candidate, r"^([\w./\-]*)[\"'`]?\s{0,3}[=:>]", 1)
    named = F.regexp_like(F.coalesce(before, F.lit("")), F.lit(NAMED)) if before is not None else F.lit(False)
    in_company = F.regexp_like(candidate, F.lit(ASSIGNED)) | (F.regexp_like(candidate, F.lit(OPAQUE)) & named)
    digest = F.regexp_like(F.concat_ws(" ", name, around), F.lit(DIGEST))
    return (F.regexp_like(candidate, F.lit(FORMAT)) | (in_company & ~digest)).cast("double")


def fit(labelled: DataFrame):
    """A forest over FEATURES from findings with a ``label`` of 0.0 or 1.0; None unless both occur."""
    count = {r.label: r.n for r in labelled.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not count.get(0.0) or not count.get(1.0):
        return None
    draw = F.pmod(F.xxhash64(F.lit("draw"), "candidate", "doc_id", "nth"), F.lit(1 << 30)) / (1 << 30)
    rate = F.when(F.col("label") == 1.0, TRAIN_ROWS / count[1.0]).otherwise(TRAIN_ROWS / count[0.0])
    drawn = labelled.where("label is not null").where(draw < rate)
    # one sorted partition of bounded size: the same rows in the same order in every run
    sample = cut_lineage(drawn.select("doc_id", "nth", "candidate", "label", *FEATURES).coalesce(1).sortWithinPartitions("doc_id", "nth", "candidate"))
    # on labels of 0 and 1 the mean of the trees' leaves is the share of secrets; unlike a classifier's, this model
    # holds no summary that ties it to the session
    forest = RandomForestRegressor(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", predictionCol="score")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(sample)


def scan(docs: DataFrame, path: str = "source", labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every finding: doc_id, nth, candidate, label, score, is_secret.

    ``labels``: reviewed findings (candidate, label); by default findings are labelled by :func:`known_format`.
    """
    found = cut_lineage(candidates(docs, path))
    featured = with_features(found, dictionary(docs))
    if labels is None:
        labelled = featured.withColumn("label", known_format(F.col("candidate"), F.col("before"), F.col("after")))
    else:
        reviewed = labels.groupBy("candidate").agg(F.max((F.col("label") != 0).cast("double")).alias("label"))
        labelled = featured.join(reviewed, "candidate", "left")
    labelled = cut_lineage(labelled.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "candidate"), F.lit(FOLDS))))
    forests = [fit(labelled.where(F.col("fold") != f)) for f in range(FOLDS)]
    columns = ("doc_id", "nth", "candidate", "label", "score")
    scored = None
    for f, forest in enumerate(forests):
        own = labelled.where(F.col("fold") == f)
        part = (forest.transform(own) if forest else own.withColumn("score", F.coalesce("label", F.lit(0.0)))).select(*columns)
        scored = part if scored is None else scored.unionByName(part)
    return scored.select("doc_id", "nth", "candidate", "label", "score", (F.col("score") >= threshold).alias("is_secret"))
