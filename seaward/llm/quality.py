"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a score quantile.

Each text has a few shape measures (lengths, signs, capitals, digits, repetition, lines).  All labelled texts are learnt from:
in groups dealt by a hash each document of label 1 is preferred to documents of label 0 drawn for it, until every row of both
is in a pair; the score is linear in the measures' quantile bins, and its weights maximise the logistic likelihood of all
preferences, which depends on feature differences only (Newton steps; tasks add up gradients).  The cut is a quantile of the
scores of rows kept apart from learning: as large a share of the scores lies under it as label 0 has among the labels (each
class weighted by its share).  Scores are moved so that the cut is at 0.7 and squeezed to (0, 1).

Rows of one label that share their smallest word-triple hash count once.  Texts of any length are measured whole.
Ties in a measure share a bin.  Other columns are not looked at, whatever their names.  An empty table gives no rows.

Null and empty texts have measures like any other.  Rows with equal texts score equally.  If the labels lack
one of the classes, every text has the same score, above the cut unless all labels are 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import _shapes, fold, map_columns, materialize, read_table, text_or_empty

#: Rows of the rarer label in a group, about; pairs for each row of label 1, at least; pairs whose features are at hand at once.
GROUP_ROWS, PAIRS, PAIRS_AT_ONCE = 2000, 3, 4096
#: Scores are counted in steps of this size to find the cut.
STEP = 1e-3
BINS, CUT, RIDGE = 12, 0.7, 3.0
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_PLAIN = _LETTERS + _DIGITS + b" \n\t\r.,;:'\"-()?"
_HIGH_UPPER = re.compile("[À-ÖØ-Þ]")

MEASURES = (
    "log_bytes word_length signs marks capitals digits distinct repeats pair_repeats lines_repeat line_length sign_tokens "
    "capital_words worst_window_repeats worst_line_signs longest_word mark_variety"
).split()


def measures(text: str) -> list[float]:
    """Shape measures of one text, in the order of ``MEASURES``."""
    data = text.encode()
    n = max(len(data), 1)
    words = text.split()
    m = max(len(words), 1)
    same = list(map(eq, words, words[1:]))
    odd = data.translate(None, _PLAIN)
    lines = [x for x in text.split("\n") if x.strip()]
    parts = [len(x.encode().translate(None, _PLAIN)) / len(x) for x in lines]
    capitals = n - len(data.translate(None, _UPPER)) + len(_HIGH_UPPER.findall(text))
    pairs = set(zip(words, words[1:], strict=False))
    shorter = [words[i : i + 64] for i in range(0, len(words), 64)]
    worst = max((1 - len(set(w)) / len(w) for w in shorter if len(w) >= 24), default=0.0)
    alone = sum(1 for w in words if len(w) <= 2 and not w.isalnum())
    return [
        float(np.log1p(len(data))),
        len(text) / m,
        len(odd) / n,
        (n - len(data.translate(None, b"!?.,;:"))) / m,
        capitals / n,
        (n - len(data.translate(None, _DIGITS))) / n,
        len(set(words)) / m**0.8,
        sum(same) / m,
        1 - len(pairs) / max(m - 1, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        float(np.log1p(len(text) / max(len(lines), 1))),
        alone / m,
        sum(map(str.isupper, words)) / m,
        worst,
        max(parts, default=0.0),
        float(max(map(len, words), default=0)),
        float(len(set(odd))),
    ]


@dataclass
class Model:
    """Bin edges of each measure, the weight of each bin, and the raw score at the cut."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """One column for each measure and bin: 1 where the measure lies in the bin."""
        out = np.zeros((len(x), self.edges.shape[0], BINS), dtype=np.float32)
        for j, e in enumerate(self.edges):
            out[np.arange(len(x)), j, np.searchsorted(e, x[:, j], side="left")] = 1
        return out.reshape(len(x), -1)

    def codes(self, x) -> bytes:
        """The bin of each measure, a byte each."""
        return bytes(int(np.searchsorted(e, v, side="left")) for e, v in zip(self.edges, x, strict=True))

    def of_codes(self, codes: list[bytes]) -> np.ndarray:
        """``design`` from ``codes``."""
        at = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(self.edges))
        out = np.zeros((len(at), self.edges.size // (BINS - 1), BINS))
        out[np.arange(len(at))[:, None], np.arange(at.shape[1]), at] = 1
        return out.reshape(len(at), -1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.design(x) @ self.weights - self.cut
        return 1 / (1 + np.exp(-(raw + np.log(CUT / (1 - CUT)))))

    def score_texts(self, texts: list[str]) -> list[float]:
        return self.score(np.array([measures(t) for t in texts]).reshape(-1, len(MEASURES))).tolist()


def _newton(sums, width: int) -> np.ndarray:
    """Weights that maximise the likelihood of all preferences (Newton steps, ridge); ``sums`` gives gradient and Hessian."""
    w = np.zeros(width)
    for _ in range(25):
        gradient, hessian = sums(w)
        step = np.linalg.solve(hessian + RIDGE * np.eye(width), gradient - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sums(differences: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
    return differences.T @ p, differences.T @ (differences * (p * (1 - p))[:, None])


def _learn_pairs(differences: np.ndarray) -> np.ndarray:
    return _newton(lambda w: _sums(differences, w), differences.shape[1])


def _measured(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """label, shape, x, apart of all labelled rows, near copies once; texts stay where they are, only measures move."""
    kind = f"key {dict(docs.dtypes)[key]}, x array<double>, shape long"

    def run(rows):
        return {"key": rows["key"], "x": [measures(t) for t in rows["text"]], "shape": [_shapes(t)[0] for t in rows["text"]]}

    seen = map_columns(docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")), run, kind)
    marked = labels.filter(F.col(key).isNotNull() & F.col("label").isin(0, 1)).select(F.col(key).alias("key"), F.col("label").cast("int").alias("label")).distinct()
    once = seen.join(marked, "key").groupBy("label", "shape").agg(F.min("x").alias("x"))
    # A quarter of the shapes is kept apart for the cut.
    return materialize(once.withColumn("apart", F.pmod(F.xxhash64("shape"), F.lit(4)) == 0), "quality-measures")


def _pairs(rows: DataFrame, model: Model, groups: int) -> DataFrame:
    """good, bad: the measures of each pair.  Every row of a group is in a pair, those of label 1 in ``PAIRS`` at least."""
    import pandas as pd

    def draw(pdf):
        rng = np.random.default_rng(5)
        pdf = pdf.sort_values("shape", kind="stable")
        good, bad = (list(pdf["x"][pdf["label"] == v]) for v in (1, 0))
        n = max(PAIRS * len(good), len(bad)) if good and bad else 0
        at = [np.concatenate([rng.permutation(len(c)) for _ in range(-(-n // len(c)))])[:n] for c in (good, bad)] if n else [[], []]
        return pd.DataFrame({"good": [model.codes(good[i]) for i in at[0]], "bad": [model.codes(bad[i]) for i in at[1]]}, columns=["good", "bad"])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("shape", F.lit(11)), F.lit(groups)))
    return materialize(dealt.groupBy("part").applyInPandas(draw, "good binary, bad binary"), "quality-pairs")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Model from all labelled rows (``label`` 0 or 1)."""
    rows = _measured(docs, labels, key, text)
    shares = labels.filter(F.col("label").isin(0, 1)).groupBy("label").count().collect()  # two rows
    share = {r["label"]: r["count"] for r in shares}
    number = {(r["label"], r["apart"]): r["count"] for r in rows.groupBy("label", "apart").count().collect()}  # four rows
    width = len(MEASURES) * BINS
    if len({v for v, _ in number}) < 2:
        return Model(np.zeros((len(MEASURES), BINS - 1)), np.zeros(width), 1.0 if any(v == 0 for v, _ in number) else -1.0)
    # Too few rows to keep some apart: all serve for both.
    learnt, held = (rows.filter("NOT apart"), rows.filter("apart")) if len(number) == 4 else (rows, rows)
    # Quantiles of each class on its own, so that a rare class has bins of its own too.
    q = np.linspace(0, 1, BINS // 2 + 1)[1:-1].tolist()
    wanted = [F.percentile_approx(F.col("x")[j], [*q, 1.0], 10_000).alias(m) for j, m in enumerate(MEASURES)]
    found = {r["label"]: np.array(r[1:]) for r in learnt.groupBy("label").agg(*wanted).collect()}  # two rows
    model = Model(np.sort(np.concatenate([found[1], found[0][:, :-1]], axis=1), axis=1), np.zeros(width), 0.0)
    rarer = min(sum(n for (v, apart), n in number.items() if v == y and not (apart and len(number) == 4)) for y in (0, 1))
    # Groups hold some rows of the rarer label each, and are bounded unless that label is very rare.
    groups = max(rarer // GROUP_ROWS, sum(number.values()) // (10 * GROUP_ROWS))
    pairs = _pairs(learnt, model, max(1, min(groups, rarer // 20)))

    def sums(w):
        def run(batches):
            import pyarrow as pa

            total = np.zeros((width + 1, width))
            for batch in batches:
                for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                    good, bad = (model.of_codes(batch.column(i).slice(at, PAIRS_AT_ONCE).to_pylist()) for i in range(2))
                    g, h = _sums(good - bad, w)
                    total[0] += g
                    total[1:] += h
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        total = sum(np.frombuffer(r.total).reshape(width + 1, width) for r in pairs.mapInArrow(run, "total binary").toLocalIterator())  # a row of 0.3 MB for each task
        return total[0], total[1:]

    model.weights = _newton(sums, width)

    def steps(rows):
        raw = model.design(np.array(rows["x"])) @ model.weights
        return {"label": rows["label"], "step": np.rint(raw / STEP).astype(int).tolist()}

    counts = map_columns(held.select("label", "x"), steps, "label int, step long").groupBy("label", "step").count().orderBy("step", "label").collect()  # bounded by the range of scores
    label, n = np.array([r["label"] for r in counts]), np.array([r["count"] for r in counts], dtype=float)
    weight = n * np.where(label == 1, share.get(1, 1) / n[label == 1].sum(), share.get(0, 1) / n[label == 0].sum())
    model.cut = quantile_cut(np.array([r["step"] * STEP for r in counts]), weight, share.get(0, 1) / max(share.get(0, 1) + share.get(1, 1), 1))
    return model


def quantile_cut(raw: np.ndarray, weight: np.ndarray, under: float) -> float:
    """The score that the share ``under`` of the weight lies below, in the middle between the two scores around it."""
    order = np.argsort(raw, kind="stable")
    r, reached = raw[order], np.cumsum(weight[order]) / weight.sum()
    k = int(np.searchsorted(reached, under - 1e-9)) + 1
    return float((r[k - 1] + r[k]) / 2) if k < len(r) else float(r[-1] + 1)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality score of each row's whole text."""
    run = lambda rows: {key: rows[key], "score": model.score_texts(rows["__text"])}
    source = docs.select(F.col(key), text_or_empty(text).alias("__text"))
    return map_columns(source, run, f"`{key}` {dict(docs.dtypes)[key]}, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = CUT) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, all columns unchanged."""
    import pandas as pd

    good = F.pandas_udf(lambda s: pd.Series([v >= threshold for v in model.score_texts(s.tolist())], dtype=bool), "boolean")
    return docs.filter(good(text_or_empty(text)))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from: those outside the held-out quarter."""
    rows = read_table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    return rows.select("doc_id", F.col("quality").alias("label"))


def op5_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op5_quality_pairs": op5_quality_pairs}
SQL: dict[str, str] = {}
