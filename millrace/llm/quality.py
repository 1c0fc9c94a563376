"""A sparse rule ensemble for text quality.

Boosted trees over statistics of a text give rules, the conjunctions of conditions along their paths. A logistic
regression with an L1 penalty weighs the rules and most drop out; the rest compile into one Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

STATISTICS = (
    "log_chars", "log_words", "word_length", "letter_share", "upper_share", "digit_share", "mark_share", "symbol_share", "shout_share",
    "space_share", "distinct_word_share", "top_word_share", "repeat_share", "distinct_line_share", "line_length", "closed_line_share",
)
#: Labelled documents that a model is fitted on, about; chosen by a hash of their ids.
SAMPLE = 16_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 30, 3, 32, 0.3, 20
#: The L1 penalty a row, and the steps that the weights take.
PENALTY, STEPS = 0.0008, 300


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    kinds = np.zeros(int(seen.max(initial=0)) + 1, np.int64)
    for c in seen.tolist():
        ch = chr(c)
        kinds[c] = (2 if ch.isupper() else 1) if ch.isalpha() else 3 if ch.isdigit() else 4 if ch in ".,;:'\"-()?" else 5 if ch.isspace() else 7 if ch == "!" else 6
    by = np.bincount(doc * 8 + kinds[codes], minlength=8 * len(texts)).reshape(-1, 8).astype(float)
    n = np.maximum(sizes, 1)
    letters = by[:, 1] + by[:, 2]
    out = np.zeros((len(texts), len(STATISTICS)))
    out[:, 0] = np.log1p(sizes)
    out[:, 3:10] = np.stack([letters / n, by[:, 2] / np.maximum(letters, 1), by[:, 3] / n, by[:, 4] / n, by[:, 6] / n, by[:, 7] / n, by[:, 5] / n], axis=1)
    for i, text in enumerate(texts):
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        if not words:
            continue
        counts = Counter(words)
        out[i, 1] = np.log1p(len(words))
        out[i, 2] = sum(map(len, words)) / len(words)
        out[i, 10] = len(counts) / len(words)
        out[i, 11] = max(counts.values()) / len(words)
        out[i, 12] = sum(map(str.__eq__, words, words[1:])) / len(words)
        out[i, 13] = len(set(lines)) / len(lines)
        out[i, 14] = np.log1p(len(text) / len(lines))
        out[i, 15] = sum(x.rstrip()[-1] in ".?!:;\"')" for x in lines) / len(lines)
    return out


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and the statistics of every whole text; a null text counts as empty."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, len(keep), 500_000):
            found = statistics(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], [*(f"_k{i}" for i in range(len(keep))), *STATISTICS])

    schema = ", ".join(f"_k{i} {kinds[n]}" for i, n in enumerate(keep)) + "".join(f", {s} double" for s in STATISTICS)
    return docs.select(*keep, text_col).mapInArrow(run, schema)


Condition = tuple[int, bool, float]  # statistic, above?, limit


@dataclass
class RuleEnsemble:
    """Rules with weights; score is the probability of the good class."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression over the STATISTICS columns."""
        terms = [f"{self.bias!r}D"]
        for rule, w in zip(self.rules, self.weights, strict=True):
            terms.append(f"CASE WHEN {' AND '.join(f'{STATISTICS[k]} {'>' if above else '<='} {limit!r}D' for k, above, limit in rule)} THEN {w!r}D ELSE 0D END")
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, limit in rule:
        out &= (x[:, k] > limit) == above
    return out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """Paths to all nodes of trees that are boosted on the logistic loss; each rule once."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)]  # bin b: above the first b cuts
    rules: dict[tuple[Condition, ...], None] = {}
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, path: tuple[Condition, ...], g: np.ndarray = g, h: np.ndarray = h) -> None:
            best = (1e-6, 0, 0)
            if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
                G, H = g[rows].sum(), h[rows].sum()
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[k][rows]
                    n, gs, hs = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (None, g[rows], h[rows]))
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                    gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = 0
                    if gain.max() > best[0]:
                        best = (float(gain.max()), k, int(gain.argmax()))
            if best[0] <= 1e-6:
                z[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
                return
            _, k, at = best
            below = binned[k][rows] <= at
            for above, own in ((False, rows[below]), (True, rows[~below])):
                condition = (k, above, float(cuts[k][at]))
                rules.setdefault((*path, condition))
                grow(own, (*path, condition))

        grow(np.arange(len(y)), ())
    return list(rules)


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """A rule ensemble for labels y (0 or 1). Without rows the score is 0.5; with one class alone it is near that class."""
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    rules = tree_rules(x, y.astype(float))
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32)
    a, at = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows
    rules = [rules[i] for i in at]
    w, b = np.zeros(len(rules), np.float32), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    u = np.ones(len(rules) + 1, np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        s = a @ u[:-1] + u[-1]
        u = np.append(a.T @ s, s.sum()).astype(np.float32)
        top = np.linalg.norm(u)
        u /= top
    rate = 4 * len(y) / top
    for _ in range(STEPS):
        r = (1 / (1 + np.exp(-(a @ v + vb))) - y).astype(np.float32)
        new = v - rate * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        nb = vb - rate * float(r.mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = (new + (t - 1) / nt * (new - w)).astype(np.float32), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble([rules[k] for k in kept], [float(w[k]) for k in kept], float(b))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    """An ensemble fitted on about `sample` labelled documents, chosen by a hash of their ids.

    Labels are joined by id; an id with several labels counts by their mean, 1 if that is 0.5 or more. Null ids and null
    labels teach nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("y"))
    n = known.count()
    chosen = known if n <= sample else known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_id", "y", text_col)  # its size is bounded by `sample`
    found = with_statistics(rows, ("_id", "y"), text_col).toArrow()
    order = np.argsort(found["_k0"].to_numpy(), kind="stable")
    x = np.stack([found[s].to_numpy() for s in STATISTICS], axis=1)[order]
    return fit_rules(x, (found["_k1"].to_numpy()[order] >= 0.5).astype(float))


def score(docs: DataFrame, model: RuleEnsemble, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The kept columns, score and predicted (1 if score >= threshold) of every whole text; empty texts are scored too."""
    found = with_statistics(docs, keep, text_col).withColumn("score", model.column())
    return found.select(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(keep)), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
