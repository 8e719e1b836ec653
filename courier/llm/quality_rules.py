"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

No rule decides alone. Each votes +1 (good), -1 (bad) or 0 (abstains) on the statistics of a whole
text. The votes of all documents are counted by vote pattern (at most 3 ** rules patterns, whatever
the corpus size), and expectation-maximisation over these counts estimates each rule's accuracy and
the share of good documents, without any label. The posterior probability of "good" then replaces
"all rules must pass".

Defined results: a null or empty text has no words and fails the base rule; repeated rows and null
ids are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, chunks_of_words, code_points, map_text

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_lines long, n_end_lines long, n_upper long, n_alpha long, n_digits long, "
         "n_distinct_words long, n_top_word long, n_marked_words long, longest_run long")

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT = bytes(range(48, 58))
_MARKED = re.compile(rb"[^\x20\x09-\x0D]*[!#$%&*|<>]{2,}(?=[\x20\x09-\x0D]|\Z)")


def _repeated(ids: np.ndarray, n_distinct: int) -> int:
    """Positions inside 3-word windows that occur twice or more."""
    if len(ids) < 4 or n_distinct == len(ids):
        return 0
    if n_distinct < 2_000_000:
        keys = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:  # three ids do not fit one 64-bit key: number the pairs first
        _, pairs = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)
        keys = pairs[:-1] * n_distinct + ids[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= hit
    return int(covered.sum())


def text_stats(b: bytes | None) -> tuple:
    """The statistics ``STATS`` of one whole text."""
    b = b or b""
    seen: dict[bytes, int] = {}
    parts = []
    for words in chunks_of_words(b):
        parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.int64))
    ids = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int64)
    n = len(ids)
    blanks = len(b) - len(b.translate(None, BLANKS))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    top = int(np.bincount(ids).max()) if n else 0
    if n:
        edges = np.flatnonzero(np.diff(ids, prepend=-1, append=-1))
        run = int(np.diff(edges).max())
    else:
        run = 0
    count = lambda drop: len(b) - len(b.translate(None, drop))
    return (n, code_points(b) - blanks, count(_SYMBOLS), len(lines) - len(set(lines)),
            _repeated(ids, len(seen)), len(lines), sum(x.rstrip()[-1:] in b".!?:\"" for x in lines),
            count(_UPPER), count(_LETTER), count(_DIGIT), len(seen), top,
            len(_MARKED.findall(b)), run)


def stats_of(texts: list) -> list:
    rows = [text_stats(b) for b in texts]
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in STATS.split(",")]


def document_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus the statistics of every whole text."""
    return map_text(docs, keep, text_col, STATS, stats_of)


def _ratio(a: str, b: str):
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def default_rules() -> dict:
    """Rule name → vote column. The thresholds are ordinary web-text heuristics, set before any data.

    Passing a check for junk is no evidence of quality: such rules vote -1 or abstain. Two rules
    that look for running prose vote +1 or abstain.
    """
    per_word = lambda c: _ratio(c, "n_words")
    letters, capitals = _ratio("n_alpha", "word_chars"), _ratio("n_upper", "n_alpha")
    some, many = F.col("n_words") >= 10, F.col("n_words") >= 40
    bad = lambda c: F.when(c, -1).otherwise(0)
    good = lambda c: F.when(c, 1).otherwise(0)
    return {
        "symbols": bad(some & (per_word("n_symbols") > 0.2)),
        "marked_words": bad(some & (per_word("n_marked_words") > 0.2)),
        "letters": bad(some & (letters < 0.85)),
        "capitals": bad(some & (capitals > 0.4)),
        "word_length": bad(some & ~per_word("word_chars").between(2, 14)),
        "repeats": bad(some & (per_word("n_repeat_words") > 0.3)),
        "top_word": bad(some & (per_word("n_top_word") > 0.25)),
        "stutter": bad(F.col("longest_run") >= 6),
        "few_words": bad(many & (per_word("n_distinct_words") < 0.25) & (F.col("n_words") < 2000)),
        "dup_lines": bad((F.col("n_lines") >= 4) & (_ratio("n_dup_lines", "n_lines") > 0.3)),
        "prose": good(some & (letters > 0.92) & (capitals < 0.2) & (per_word("n_symbols") < 0.05)
                      & per_word("word_chars").between(3, 10)),
        "variety": good(some & (per_word("n_top_word") < 0.15) & (per_word("n_repeat_words") < 0.1)
                        & (F.col("longest_run") <= 3)),
    }


def base_failed():
    """Too short, or more than half of its words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def estimate(patterns: Counter, n_rules: int, *, believed: float = 0.85, believed_good: float = 0.7,
             belief: float = 0.05, belief_good: float = 0.05, rounds: int = 200, tol: float = 1e-9):
    """Accuracy of every rule (how often its votes are right) and the share of good documents.

    ``patterns``: tuple of votes → documents. Given the class, rules vote independently; abstaining
    says nothing. The estimates have priors and no bounds: a rule is held to be right in ``believed``
    of its votes with the strength of ``belief`` times the votes it gave, and ``believed_good`` of
    the documents to be good with that of ``belief_good`` times all documents. The strengths are
    relative, so that a corpus of any size with the same shares gives the same estimates. Without
    priors the likelihood is highest when every document is good and the rules that find junk are
    wrong; with a belief of 2 a rule stays better than a coin even if no other rule ever agrees with
    it. A rule that never votes keeps ``believed``.
    """
    accuracy, prior = np.full(n_rules, believed), believed_good
    if patterns:
        keys = sorted(patterns)
        v = np.array(keys, float).reshape(len(keys), n_rules)
        w = np.array([patterns[k] for k in keys], float)
        voted = w @ (v != 0)
        for _ in range(rounds):
            logit = math.log(prior / (1 - prior)) + v @ np.log(accuracy / (1 - accuracy))
            good = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            right = (w * good) @ (v > 0) + (w * (1 - good)) @ (v < 0)
            share = np.divide(right, voted, out=np.full(n_rules, believed), where=voted > 0)
            new = (share + belief * believed) / (1 + belief)
            new_prior = float((w @ good / w.sum() + belief_good * believed_good) / (1 + belief_good))
            moved = max(np.abs(new - accuracy).max(), abs(new_prior - prior))
            accuracy, prior = new, new_prior
            if moved < tol:
                break
    return [float(x) for x in accuracy], prior


def fit_rules(stats: DataFrame, rules: dict | None = None, *, belief: float = 2.0, belief_good: float = 1.0) -> dict:
    """Count the vote patterns of all documents, then run expectation-maximisation on the counts.

    Junk comes in kinds that different rules find, so that rules are not independent given the class;
    beliefs stronger than those of ``estimate`` keep the rules of a rare kind from being outvoted.
    """
    rules = rules or default_rules()
    votes = stats.select(F.array(*[c.cast("int") for c in rules.values()]).alias("votes"))
    counted = votes.groupBy("votes").count().collect()  # at most 3 ** len(rules) rows
    patterns = Counter({tuple(r["votes"]): r["count"] for r in counted})
    acc, prior = estimate(patterns, len(rules), belief=belief, belief_good=belief_good)
    return {"prior": prior, "accuracy": dict(zip(rules, acc))}


def posterior(model: dict, rules: dict | None = None):
    """Probability that a document is good, as a column over the statistics."""
    rules = rules or default_rules()
    logit = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, vote in rules.items():
        a = model["accuracy"][name]
        logit = logit + vote * F.lit(math.log(a / (1 - a)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def quality_rules(docs: DataFrame, keep: list[str], text_col: str = "text", *, threshold: float = 0.5,
                  rules: dict | None = None, materialise=None) -> DataFrame:
    """``keep`` columns, the statistics, ``base_failed``, ``p_good`` and ``kept`` of every row.

    ``materialise``: DataFrame → DataFrame that stores the statistics, so that the texts are read
    once instead of once for the votes and once for the verdict.
    """
    rules = rules or default_rules()
    stats = document_stats(docs, keep, text_col)
    stats = materialise(stats) if materialise else stats
    model = fit_rules(stats if materialise else document_stats(docs, [], text_col), rules)
    out = stats.withColumns({"base_failed": base_failed(), "p_good": posterior(model, rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
