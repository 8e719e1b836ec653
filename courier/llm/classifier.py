"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

A random forest of shallow trees is grown on statistics of whole texts. Every path from a root to a
node becomes a conjunctive rule, lasso-penalised logistic regression weighs the rules and drops most
of them, and what is left is one column expression over the statistics.

The fit takes a bounded sample: labelled rows whose hashed id falls under ``sample_rows`` / labelled
rows, so about ``sample_rows`` whatever the corpus size. Scores are computed for every row.

Defined results: a null or empty text has statistics of zero and a score like any other; repeated
rows are scored alike; ids without a label are only scored; several labels of one id count as their
mean, rounded; without labels of both classes the score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare_name, stored
from .quality_rules import document_stats


def _ratio(a, b) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """Feature name → column over the statistics; all are finite for every text."""
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols": _ratio("n_symbols", "n_words"),
        "marked_words": _ratio("n_marked_words", "n_words"),
        "repeat_words": _ratio("n_repeat_words", "n_words"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"),
        "line_ends": _ratio("n_end_lines", "n_lines"),
        "words_per_line": _ratio("n_words", "n_lines"),
        "capitals": _ratio("n_upper", "n_alpha"),
        "letters": _ratio("n_alpha", "word_chars"),
        "digits": _ratio("n_digits", "word_chars"),
        "distinct_words": _ratio("n_distinct_words", "n_words"),
        "top_word": _ratio("n_top_word", "n_words"),
        "longest_run": F.col("longest_run").cast("double"),
    }


def with_features(stats: DataFrame) -> tuple[DataFrame, list[str]]:
    """``stats`` with a column ``f_<name>`` per feature."""
    new = {f"f_{k}": v for k, v in features().items()}
    return stats.withColumns(new), list(new)


def tree_paths(debug_string: str) -> list[tuple]:
    """Conditions (feature index, "<=" or ">", threshold) from the root to every node below it."""
    paths, stack = [], []
    for line in debug_string.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (int(m[2]), m[3], float(m[4]))))
        paths.append(tuple(sorted({c for _, c in stack})))
    return paths


def simplified(path: tuple) -> tuple:
    """At most one bound of each kind per feature."""
    best: dict[tuple, float] = {}
    for f, op, t in path:
        best[f, op] = t if (f, op) not in best else (min if op == "<=" else max)(best[f, op], t)
    return tuple(sorted((f, op, t) for (f, op), t in best.items()))


def rule_column(rule: tuple, names: list[str]) -> Column:
    out = F.lit(True)
    for f, op, t in rule:
        out = out & (F.col(names[f]) <= t if op == "<=" else F.col(names[f]) > t)
    return out


def fit(sample: DataFrame, label_col: str, *, trees: int = 20, depth: int = 3, penalty: float = 0.002,
        seed: int = 7) -> dict:
    """Rules and weights from statistics with a 0/1 label: {"rules": [(rule, weight)], "intercept"}."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows, names = with_features(sample)
    rows = rows.select(*names, F.col(label_col).cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, every = counts.get(1.0, 0), sum(counts.values())
    base = (ones + 1) / (every + 2)
    if ones in (0, every):
        return {"rules": [], "intercept": math.log(base / (1 - base))}
    # few tasks: the sample is bounded and every iteration is a job
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).coalesce(4).persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed).fit(data)
    rules = sorted({simplified(p) for t in forest.trees for p in tree_paths(t.toDebugString)})
    cells = [rule_column(r, names).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    ruled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        data.select(*cells, "label")).select("features", "label").persist()
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(ruled)
    weights = [float(w) for w in model.coefficients.toArray()]
    data.unpersist()
    ruled.unpersist()
    return {"rules": [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-6], "intercept": float(model.intercept)}


def score(model: dict, names: list[str]) -> Column:
    """The compiled ensemble: a column over the feature columns, between 0 and 1."""
    logit = F.lit(model["intercept"])
    for rule, weight in model["rules"]:
        logit = logit + F.when(rule_column(rule, names), weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_stats(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """Statistics and label of about ``sample_rows`` labelled documents that are not held out."""
    usable = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("label")))
    n = usable.count()
    share = min(1.0, sample_rows / max(n, 1))
    taken = usable.where(F.pmod(F.xxhash64(id_col, F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    label = spare_name([id_col, text_col], "sample_label")
    taken = taken.withColumnRenamed("label", label)
    # about sample_rows ids and labels: a proven bound, whatever the corpus size
    rows = docs.select(id_col, text_col).join(F.broadcast(taken), id_col)
    return stored(document_stats(rows, [label], text_col), "training").withColumnRenamed(label, "label")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", *, sample_rows: int = 20_000, threshold: float = 0.7, **options) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``."""
    model = fit(training_stats(docs, labels, id_col, text_col, label_col, sample_rows), "label", **options)
    rows, names = with_features(document_stats(docs, [id_col], text_col))
    out = rows.select(id_col, held_out(id_col).alias("held_out"), score(model, names).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
