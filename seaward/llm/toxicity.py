"""Toxic passages: every maximal scoring segment over token log-odds, calibrated by extreme-value statistics.

Learning.  In a bounded sample of labelled texts the documents with each unit (a word, or a word's first 4, 5 or 6
letters) are counted by label; near copies count once.  A unit's score is its log-odds with an informative Dirichlet
prior (pseudo-counts in proportion to the unit's share of all units); units of doubtful score (under ``MIN_Z`` standard
errors) have none.  A token scores as its best unit, any other token costs ``DRIFT``.

Scoring.  One pass over the tokens finds all maximal scoring segments (linear time; runs of unscored tokens count as one
item).  Segment scores are held against the extreme-value law of clean texts, P(S >= x) = 1 - exp(-K n exp(-lambda x));
lambda solves the moment equation on the clean sample's token scores, K fits the segments seen there.  A document's
statistic adds what its significant segments exceed chance by; a logistic curve, fitted on sample documents that the
units were not learnt from, turns it into a score from 0 to 1.

Sample rows of one label that share their smallest word-triple hash count once (near copies, mostly; unlike texts with one
common phrase can share it too).  Texts of any length are scored whole, in one pass.  Ties between units go to the unit that
sorts first.  Other columns are not looked at, whatever their names.  An empty table gives no rows.

Null and empty texts have no segment and score as any text without one.  Rows with equal texts score equally.  If the
labelled sample lacks one of the classes, no unit has a score and every text scores as the classes' shares say.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import arrow_schema, fold, labelled_sample, map_columns, once_by, read_table, text_or_empty

#: Labelled rows taken of each class at most (those with the smallest hash of the id).
SAMPLE = 10_000
#: Units with a score at most (those with the most standard errors); a bound on the model's size.
UNITS = 50_000
PRIOR_SHARE, MIN_Z, TOP_SCORE, DRIFT = 0.01, 3.5, 8.0, 0.5
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
_COUNTS_AT_ONCE, _CACHE = 300_000, 400_000


def units(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) > n)]


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """(score, first token, last token) of all maximal scoring segments, for tokens that score or else cost ``drift``.

    Candidates are kept with the cumulative score before (low) and after (high) them; a new item joins the nearest
    earlier candidate that starts lower and does not end higher.  Each item is looked at a bounded number of times.
    """
    kept: list[list] = []  # low, high, first, last, link to the nearest earlier candidate with a smaller low
    total, before = 0.0, -1
    for at, score in hits:
        total -= drift * (at - before - 1)
        low, total, before = total, total + score, at
        new = [low, total, at, at, None]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0]:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= new[1]:
                new[4] = j
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(high - low, first, last) for low, high, first, last, _ in kept]


@dataclass
class Model:
    """What scoring needs: unit scores, the extreme-value law's parameters and the logistic curve's."""

    score_of: dict[str, float]
    rate: float = 1.0
    scale: float = 0.1
    slope: float = 0.0
    offset: float = 0.0
    _cache: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"_cache": None}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        if self._cache is None or len(self._cache) > _CACHE:
            self._cache = {}
        cache, get = self._cache, self.score_of.get
        for w in set(words):
            if w not in cache:
                cache[w] = max(get(u, 0.0) for u in units(w))
        return [(i, s) for i, s in enumerate(map(cache.__getitem__, words)) if s]

    def segments(self, words: list[str]) -> list[tuple[float, int, int]]:
        """(excess, first, last) of each significant segment; excess is -log of its expected number by chance."""
        edge = np.log(max(self.scale * max(len(words), 1), 1e-9))
        found = ((self.rate * s - edge, a, b) for s, a, b in maximal_segments(self.hits(words)))
        return [x for x in found if x[0] > 0]

    def statistic(self, words: list[str]) -> float:
        return float(np.log1p(sum(x[0] for x in self.segments(words))))

    def probability(self, statistic: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * statistic + self.offset))))

    def score(self, text: str) -> float:
        return self.probability(self.statistic(_WORD.findall(text.lower())))


def _count_units(sample: DataFrame) -> DataFrame:
    """Documents of each label that hold each unit (partial sums, then one shuffle of counts)."""
    kind, arrow = arrow_schema("unit string, clean long, toxic long")

    def run(batches):
        import pyarrow as pa

        counts: dict[str, list[int]] = {}

        def flush():
            rows = [(u, c[0], c[1]) for u, c in counts.items()]
            counts.clear()
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for u in {u for w in set(_WORD.findall(text.lower())) for u in units(w)}:
                    counts.setdefault(u, [0, 0])[label] += 1
                if len(counts) > _COUNTS_AT_ONCE:
                    yield flush()
        yield flush()

    parts = sample.select("text", F.col("label").cast("int")).mapInArrow(run, kind)
    return parts.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _log_odds(counts: DataFrame) -> dict[str, float]:
    total = counts.agg(F.sum("clean").alias("n0"), F.sum("toxic").alias("n1")).first()
    n0, n1 = float(total.n0 or 0), float(total.n1 or 0)
    if not n0 or not n1:
        return {}
    prior = PRIOR_SHARE * (n0 + n1)
    a = F.lit(prior / (n0 + n1)) * (F.col("clean") + F.col("toxic"))
    one, zero = F.col("toxic") + a, F.col("clean") + a
    delta = F.log(one / (n1 + prior - one)) - F.log(zero / (n0 + prior - zero))
    z = delta / F.sqrt(1 / one + 1 / zero)
    rows = counts.filter(F.col("toxic") > 2).select("unit", delta.alias("delta"), z.alias("z")).filter(F.col("z") >= MIN_Z)
    best = rows.orderBy(F.desc("z"), "unit").limit(UNITS).collect()  # at most UNITS rows
    return {r.unit: min(float(r.delta), TOP_SCORE) for r in best}


def _calibrate(model: Model, clean: list[list[tuple[int, float]]], lengths: list[int]) -> None:
    """lambda and K of the clean sample's segments; half a hit is added, so that clean texts without hits do too."""
    scores = [s for hits in clean for _, s in hits] + [float(np.mean(list(model.score_of.values())))]
    tokens = sum(lengths) + 1.0
    weights = np.append(np.ones(len(scores) - 1), 0.5) / tokens
    s, rest = np.array(scores), 1 - weights.sum()
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if weights @ np.exp(mid * s) + rest * np.exp(-mid * DRIFT) < 1 else (low, mid)
    model.rate = low
    found = sum(low * x[0] >= 2 for hits in clean for x in maximal_segments(hits))
    model.scale = float(np.clip((found + 0.5) * np.exp(2) / tokens, 1e-6, 1.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a light ridge."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-6]), design.T @ (y - p) - [1e-3 * w[0], 0])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Model from labelled rows (``label`` 0 or 1); three quarters of the sample give units, one quarter the curve."""
    sample = labelled_sample(docs, labels, key, text, SAMPLE, "toxicity-sample")
    part = F.pmod(F.xxhash64("shape"), F.lit(4))
    # Near copies mostly share the smallest hash of their word triples, and one of two such hashes nearly always.
    learn = once_by(once_by(sample.filter(part != 0), "shape"), "shape2")
    model = Model(_log_odds(_count_units(learn)))

    def hits(rows):
        words = [_WORD.findall(t.lower()) for t in rows["text"]]
        found = [model.hits(w) for w in words]
        return {"label": rows["label"], "n": [len(w) for w in words], "at": [[i for i, _ in h] for h in found], "s": [[s for _, s in h] for h in found]}

    held = map_columns(sample.filter(part == 0).select("text", "label"), hits, "label int, n int, at array<int>, s array<double>").collect()
    pairs = [list(zip(r.at, r.s, strict=True)) for r in held]  # at most the sample's rows, hits only
    if not model.score_of or len({r.label for r in held}) < 2:
        seen = [r.label for r in held] or [0]
        model.offset = float(np.log((sum(seen) + 0.5) / (len(seen) - sum(seen) + 1.5)))
        return model
    _calibrate(model, [h for h, r in zip(pairs, held, strict=True) if not r.label], [r.n for r in held if not r.label])
    stats = []
    for h, r in zip(pairs, held, strict=True):
        edge = np.log(max(model.scale * max(r.n, 1), 1e-9))
        stats.append(np.log1p(sum(max(model.rate * s - edge, 0) for s, _, _ in maximal_segments(h))))
    model.slope, model.offset = _logistic(np.array(stats), np.array([float(r.label) for r in held]))
    return model


def passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant passage: key, start and end (code points, end exclusive), excess over chance, and its text."""

    def run(rows):
        out = {key: [], "start": [], "end": [], "excess": [], "passage": []}
        for k, value in zip(rows[key], rows["__text"], strict=True):
            spans = [(m.start(), m.end()) for m in _WORD.finditer(value)]
            for excess, a, b in model.segments([value[i:j].lower() for i, j in spans]):
                for n, v in zip(out, (k, spans[a][0], spans[b][1], excess, value[spans[a][0] : spans[b][1]]), strict=True):
                    out[n].append(v)
        return out

    schema = f"`{key}` {dict(docs.dtypes)[key]}, start int, end int, excess double, passage string"
    return map_columns(docs.select(F.col(key), text_or_empty(text).alias("__text")), run, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity score of each row's whole text."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, score double"
    run = lambda rows: {key: rows[key], "score": [model.score(t) for t in rows["__text"]]}
    return map_columns(docs.select(F.col(key), text_or_empty(text).alias("__text")), run, schema)


def reject_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores under ``threshold``, all columns unchanged."""
    safe = F.pandas_udf(lambda s: s.map(lambda t: model.score(t) < threshold).astype(bool), "boolean")
    return docs.filter(safe(text_or_empty(text)))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from: those outside the held-out fifth."""
    rows = read_table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    return rows.select("doc_id", F.col("toxic").alias("label"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
