"""Secret scans with a random forest that removes false positives. DataFrame functions only, no Python on the executors.

Candidates are whitespace-separated tokens with letters and digits. Each is described by its length, the transitions
between character kinds, how much of it is dictionary words, path marks and the words beside it; a forest trained on
labelled findings tells secrets from addresses, names of files, identifiers and the like.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.llm.frames import fresh, remainder
from clipworks.sources.tables import materialize

#: Bound of the training set, shortest token looked at, and occurrences that make a run of letters a dictionary word.
MAX_FINDINGS, MIN_LENGTH, MIN_COUNT = 20_000, 12, 20
TREES, DEPTH = 40, 8
CREDENTIAL_WORDS = "(?i)(pass(word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential|private)"
FEATURES = ["length", "transitions", "transition_share", "digit_share", "upper_share", "symbol_share", "distinct_share", "coverage", "path_marks", "in_path", "in_address", "assigned", "before_credential", "before_sign", "before_words", "after_words"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, no, token, value, before, after): candidate tokens, their place among the tokens, and two words to either side.

    ``value`` is what follows the last = or : of the token, without quotes and closing marks.
    """
    tokens = F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+")
    base = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    spots = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("no"))),
                     lambda x: (F.length(x["token"]) >= MIN_LENGTH) & x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]"))
    side = lambda lo: F.concat_ws(" ", *[F.coalesce(F.get("tokens", F.col("s.no") + k), F.lit("")) for k in lo])
    rows = base.select("id", "tokens", F.explode(spots).alias("s"))
    value = F.regexp_extract("s.token", r"""([^=:"']*?)[^A-Za-z0-9/+=_-]*$""", 1)
    return rows.select("id", F.col("s.no").alias("no"), F.col("s.token").alias("token"), value.alias("value"), side((-2, -1)).alias("before"), side((1, 2)).alias("after"))


def dictionary(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word): runs of three or more letters a-z that stand alone at least ``min_count`` times in the texts."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D.,;:!?()]+")).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]{3,}$")).groupBy("word").count().where(F.col("count") >= min_count).select("word")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the ``FEATURES``. Coverage is the share of a value's characters in runs of letters that are words."""
    values = found.select("value").distinct()
    parts = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = parts.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "[^0Aa]", "_"), "", "")
    size = F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda mark: (F.length(F.col("kinds")) - F.length(F.replace(F.col("kinds"), F.lit(mark), F.lit("")))) / size
    turns = (F.length(F.regexp_replace("kinds", r"(.)\1+", "$1")) - 1).cast("double")
    flag = lambda c: c.cast("double")
    known = found.join(covered, "value", "left").withColumn("kinds", kinds)
    count = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w.rlike("^[A-Za-z]+[.,]?$"))).cast("double")
    return known.select(
        *found.columns, F.length("value").cast("double").alias("length"), turns.alias("transitions"), (turns / size).alias("transition_share"),
        share("0").alias("digit_share"), share("A").alias("upper_share"), share("_").alias("symbol_share"), (F.size(F.array_distinct(F.split("value", ""))) / size).alias("distinct_share"),
        (F.coalesce("covered", F.lit(0)) / size).alias("coverage"), F.length(F.regexp_replace("token", r"[^/\\.]", "")).cast("double").alias("path_marks"),
        flag(F.col("token").rlike(r"://|^[./~]|[\w-]+/[\w-]+")).alias("in_path"), flag(F.contains("token", F.lit("@"))).alias("in_address"),
        flag(F.col("token").rlike("=[^=]") | F.col("before").rlike(r"[=:]\s*$")).alias("assigned"), flag(F.concat_ws(" ", "before", F.regexp_extract("token", "^(.*?)[=:]", 1)).rlike(CREDENTIAL_WORDS)).alias("before_credential"),
        flag(F.col("before").rlike(r"[=:]\s*$")).alias("before_sign"), count(F.col("before")).alias("before_words"), count(F.col("after")).alias("after_words"))


def known_formats(value: Column, token: Column, before: Column) -> Column:
    """Labels of findings that their form settles: 1 for issued key formats and assigned credentials, 0 for addresses, paths and versions; else null."""
    key = value.rlike("^AKIA[0-9A-Z]{16}$") | value.rlike("^(ghp|gho|ghs)_[A-Za-z0-9]{36}$") | value.rlike("^AIza[0-9A-Za-z_-]{35}$")
    named = F.concat_ws(" ", before, F.regexp_extract(token, "^(.*?)[=:]", 1)).rlike(CREDENTIAL_WORDS) & value.rlike("(?i)^[0-9a-f]{16,}$")
    other = token.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}\W*$") | token.rlike(r"^\W?https?://") | token.rlike(r"^[\d.,:/-]+[A-Za-z]{1,3}\W*$") | token.rlike(r"^\W*([a-z]+[-_.])+[a-z0-9]{1,4}\W*$")
    return F.when(key | named, 1).when(other, 0)


def train(findings: DataFrame, max_findings: int = MAX_FINDINGS, seed: int = 3):
    """A forest over ``findings`` (features and label 0/1): the ``max_findings`` with the smallest hashed values. None when a class is missing."""
    kept = findings.select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64("token", "before", "after").alias("order"))
    kept = materialize(kept.orderBy("order", *FEATURES).limit(max_findings).drop("order"))
    if kept.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(kept.coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, no, token, value, before, after, score, is_secret), one row per candidate of every row of ``docs``.

    ``findings`` (id, no, label) are labelled candidates; without them the forms in ``known_formats`` label the rows
    outside the held-out fold. Null and empty texts have no candidates; rows that repeat an id are scanned one by one,
    a null id is an id like others. Equal tokens in equal places score alike. Without both classes nothing is removed:
    every candidate scores 1. Other columns are not read.
    """
    found = materialize(described(candidates(docs, id_col, text_col), dictionary(docs, text_col)))
    if findings is None:
        labelled = found.withColumn("label", known_formats(F.col("value"), F.col("token"), F.col("before"))).where(~held_out("id"))
    else:
        labelled = found.join(findings.select("id", "no", "label").dropDuplicates(["id", "no"]), ["id", "no"])
    forest = train(labelled.where("label IS NOT NULL"))
    plain = ["id", "no", "token", "value", "before", "after"]
    if forest is None:
        out = found.select(*plain, F.lit(1.0).alias("score"))
    else:
        out = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol=fresh(found, "features")).transform(found))
        out = out.select(*plain, vector_to_array("probability")[1].alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 5) == 0
