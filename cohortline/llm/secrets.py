"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

Native: DataFrame functions and Spark's own forest only; the fitted trees become a column expression, so that documents
are judged where they are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import pack_row

#: Runs of so many characters of keys, hashes and encodings are candidates.
CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Labelled findings that the forest is fitted on, those of the least hashes.
LABELLED_ROWS = 4000
TREES, DEPTH, SEED = 20, 5, 11
#: Corpus words, by frequency in all documents, that make up the dictionary; each has 3 to 12 letters.
DICTIONARY_WORDS = 1000
THRESHOLD = 0.5
MASK = "<secret>"

# formats that issuers publish
ISSUED = ("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|"
          "xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})$")
NAMED = "(?i)(secret|token|passw|pwd|api[_-]?key|access[_-]?key|credential|auth)"
TEST_PATH = "(?i)(test|example|sample|fixture|mock|dummy)"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def candidates(text: Column, path: Column) -> Column:
    """Each candidate with the text before it in its word, the two words before, the word after, and the document's path."""

    def of_word(words: Column, w: Column, i: Column) -> Column:
        found = F.transform(F.regexp_extract_all(w, F.lit(CANDIDATE), 0), lambda c: F.struct(
            c.alias("secret"), i.alias("at"),
            F.split_part(w, c, F.lit(1)).alias("before"),
            F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1)).alias("left"),
            F.coalesce(F.get(words, i + 1), F.lit("")).alias("right"),
            F.coalesce(path, F.lit("")).alias("path")))
        return F.when((F.length(w) >= 16) & w.rlike(CANDIDATE), found)

    words = F.split(F.coalesce(text, F.lit("")), "\\s+", -1)
    return _let(words, lambda ws: F.flatten(F.array_compact(F.transform(ws, lambda w, i: of_word(ws, w, i)))))


def _share(c: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{kind}]", "")) / F.length(c)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def features(x: Column, dictionary: list[str]) -> Column:
    """Numbers of one candidate: length, characters and transitions between their kinds, dictionary, path, neighbours."""
    c = x["secret"]
    kinds = c
    for pattern, mark in (("[0-9]", "#"), ("[a-z]", "l"), ("[A-Z]", "U"), ("[^#lU]", "-")):
        kinds = F.regexp_replace(kinds, pattern, mark)
    runs = F.length(F.regexp_replace(kinds, "(.)\\1+", "$1"))
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    uncovered = F.length(F.regexp_replace(F.lower(c), words, "")) if words else F.length(c)
    near = F.concat_ws(" ", x["left"], x["before"])
    return F.array(
        F.length(c).cast("double"),
        _share(c, "0-9"), _share(c, "A-Z"), _share(c, "a-z"),
        (runs - 1) / F.length(c),
        F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        _flag(c.rlike("^[0-9a-fA-F]+$")),
        1 - uncovered / F.length(c),
        _share(c, "/_-"),
        _flag(x["path"].rlike(TEST_PATH)),
        _flag(near.rlike(NAMED)),
        _flag(near.rlike("[=:][\"']?\\s*[\"']?$")),
        _flag(x["before"].rlike("[\"'`]$")),
        _flag(x["right"].rlike("^[a-z]+[.,]?$")),
    )


def label(x: Column) -> Column:
    """What is certain about a candidate: 1 for issuers' formats and values assigned to a name that says secret,
    0 for words without a digit and for UUIDs, else null."""
    c = x["secret"]
    near = F.concat_ws(" ", x["left"], x["before"])
    assigned = near.rlike(NAMED + "[\\w\"' -]*[=:]\\s*[\"']?$") & c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    return F.when(c.rlike(ISSUED) | (assigned & ~x["path"].rlike(TEST_PATH)), 1.0).when(~c.rlike("[0-9]") | c.rlike(UUID), 0.0)


def frequent_words(docs: DataFrame, text: str, count: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of all documents, a fixed number of them."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(docs[text]), F.lit("\\b[a-z]{3,12}\\b"), 0)).alias("_w"))
    top = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_w").limit(count)
    return sorted(r[0] for r in top.collect())


def weak_labels(docs: DataFrame, text: str, path: str) -> DataFrame:
    """Findings of the corpus itself with the label that is certain; each different candidate and context once."""
    found = docs.select(F.explode(candidates(docs[text], docs[path])).alias("x"))
    return found.withColumn("label", label(F.col("x"))).filter("label IS NOT NULL").distinct()


def fit_forest(findings: DataFrame, dictionary: list[str], rows: int = LABELLED_ROWS):
    """A probability as a function of the array of features, from findings ``x`` and their ``label``.

    Half of the rows are taken from either label as far as it has them. Without both labels the probability is that of
    the only one, or 0 without any.
    """
    order = F.xxhash64("x")
    parts = [findings.filter(F.col("label") == v).orderBy(order, "x").limit(rows // 2) for v in (0.0, 1.0)]
    taught = parts[0].union(parts[1]).select("label", array_to_vector(features(F.col("x"), dictionary)).alias("features")).coalesce(1).cache()
    seen = {r[0] for r in taught.groupBy("label").count().collect()}
    if len(seen) < 2:
        taught.unpersist()
        only = next(iter(seen), 0.0)
        return lambda f: F.lit(float(only))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(taught)
    taught.unpersist()
    roots = [tree.rootNode() for tree in model._java_obj.trees()]

    def grown(node, f: Column) -> Column:
        if node.subtreeDepth() == 0:
            counts = list(node.impurityStats().stats())
            return F.lit(float(counts[1]) / max(sum(counts), 1e-9))
        split = node.split()
        return F.when(F.get(f, F.lit(split.featureIndex())) <= float(split.threshold()), grown(node.leftChild(), f)).otherwise(grown(node.rightChild(), f))

    def probability(f: Column) -> Column:
        total = grown(roots[0], f)
        for root in roots[1:]:
            total = total + grown(root, f)
        return total / len(roots)

    return probability


def scan_secrets(docs: DataFrame, text: str = "text", path: str = "source", findings: DataFrame | None = None) -> DataFrame:
    """Of every row: ``row``, all columns with the secrets in ``text`` masked, ``n_candidates``, and ``secrets``, an array of
    (secret, at, probability), ``at`` being the number of the word it is in, from 0.

    ``findings`` (``x`` as from candidates(), ``label``) teach the forest; without them, those of the corpus that are certain.
    Null texts have no candidate and stay null; null paths are empty; repeated rows are judged alike. Whole texts are scanned, and
    every occurrence of a secret in its text is masked. Nothing is shuffled but counts and the labelled sample.
    """
    dictionary = frequent_words(docs, text)
    probability = fit_forest(weak_labels(docs, text, path) if findings is None else findings, dictionary)
    packed = pack_row(docs, text=docs[text], found=candidates(docs[text], docs[path]))

    def judged(x: Column) -> Column:
        return _let(features(x, dictionary), lambda f: F.struct(x["secret"].alias("secret"), x["at"].alias("at"), probability(f).alias("probability")))

    scored = packed.select("_row", "_text", F.size("_found").alias("n_candidates"),
                           F.filter(F.transform("_found", judged), lambda y: y["probability"] >= THRESHOLD).alias("secrets"))
    # longer ones first: one may be a part of another
    named = F.array_sort(F.array_distinct(F.transform("secrets", lambda y: y["secret"])), lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(named, F.col("_text"), lambda t, s: F.replace(t, s, F.lit(MASK)))
    return scored.select(
        F.struct(*[(masked if n == text else F.col("_row").getField(n)).alias(n) for n in docs.columns]).alias("row"),
        "n_candidates", "secrets")
