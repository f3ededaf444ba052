"""Quality classifier: a sparse rule ensemble.

Trees are fitted to statistics of labelled texts; every path from a root to an inner node or leaf becomes a conjunctive
rule. A lasso logistic regression over the rules, 0 or 1 each, keeps few of them, and the rest are compiled into one Spark
column expression over the statistics, so that scoring is one projection over the documents without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import materialize

#: Labelled rows that the rules are fitted to, at most: drawn by the hash of the id.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; all are 0 for null and empty texts, those of words for texts without one too."""
    t = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))
    words = F.split(F.when(plain != "", plain), " ")
    lines = F.split(t, "\n")
    n = F.length(t)
    share = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0)).cast("double")
    without = lambda chars: n - F.length(F.translate(t, chars, ""))
    return {
        "chars": n.cast("double"),
        "words": F.coalesce(F.size(words), F.lit(0)).cast("double"),
        "word_length": F.coalesce(F.try_divide(n, F.size(words)), F.lit(0.0)).cast("double"),
        "distinct_words": F.coalesce(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), F.lit(0.0)).cast("double"),
        "distinct_lines": F.when(n > 0, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0).cast("double"),
        "upper": share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÚ")),
        "digits": share(without("0123456789")),
        "symbols": share(without("#$%&*+=<>@\\^_~{}[]/")),
        "bars": share(without("|")),
        "stops": share(without(".,;:")),
        "marks": share(without("!?")),
        "lines": share(F.size(lines)),
    }


NAMES = ("chars", "words", "word_length", "distinct_words", "distinct_lines", "upper", "digits", "symbols", "bars", "stops", "marks", "lines")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column __stats."""
    return docs.withColumn("__stats", F.struct(*(c.alias(k) for k, c in statistics(F.col(text_col)).items())))


#: A rule: (statistic, "<=" or ">", threshold) conditions that all hold.
Rule = tuple[tuple[str, str, float], ...]


def tree_rules(debug: str, names: tuple[str, ...] = NAMES) -> list[Rule]:
    """The paths of a fitted tree or forest, from its printed form."""
    found, path = set(), []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
        found.add(simplified(tuple(c for _, c in path)))
    return sorted(found)


def simplified(rule: Rule) -> Rule:
    """Of several conditions on one side of a statistic, the tightest."""
    tight: dict[tuple[str, str], float] = {}
    for name, op, t in rule:
        tight[name, op] = (min if op == "<=" else max)(tight.get((name, op), t), t)
    return tuple((name, op, t) for (name, op), t in sorted(tight.items()))


def holds(rule: Rule, stats: Column) -> Column:
    """The rule as a condition over a struct of statistics."""
    out = F.lit(True)
    for name, op, t in rule:
        out = out & (stats[name] <= t if op == "<=" else stats[name] > t)
    return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as one column expression."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(holds(rule, stats), w).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleEnsemble:
    """Fit the ensemble to the texts of ``docs`` whose ids have label 0 or 1; other labels are left out.

    Of the labels the at most ``rows`` with the least hashes of their ids are used. Without labels, or with one label
    only, the ensemble has no rules and its score is that label's share, (n1 + 1) / (n + 2). Null ids are left out; an id that
    comes more than once, in labels or texts, counts as often as its pairs.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")  # at most ``rows`` labels
    own = with_statistics(own, "text").select("label", "__stats.*")
    data = materialize(own, "quality-fit")
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        p = (ones + 1) / (n + 2)
        return RuleEnsemble((), (), math.log(p / (1 - p)))
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="x").transform(data).select("label", "x").cache()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(vectors)
    rules = tree_rules(forest.toDebugString)
    vectors.unpersist()
    if not rules:
        return RuleEnsemble((), (), math.log(ones / (n - ones)))
    stats = F.struct(*NAMES)
    marked = data.select("label", F.array(*(holds(r, stats).cast("double") for r in rules)).alias("on"))
    on = marked.select("label", array_to_vector("on").alias("x")).coalesce(4).cache()
    lasso_fit = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(on)
    on.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lasso_fit.coefficients.toArray()) if w]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lasso_fit.intercept))


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """``docs`` with __stats and score (0 to 1), which replace columns of those names. Null texts are scored as empty ones."""
    return with_statistics(docs, text_col).withColumn("score", model.score(F.col("__stats")))
