"""Periodic runs in texts: string synchronising sets at dyadic scales propose periods, runs of smaller periods are left out.

A run is a stretch of words with smallest period q that holds q at least four times and that no neighbouring word extends.
At each scale t = 1, 2, 4, ... a position is chosen (``synchronising``) if the smallest hash among the stretches of t words that
begin at it and at the t positions after it is that of the first or the last of them.  Whether a position is chosen depends on
the 2t words from it alone, so the copies inside a run are chosen alike, and of every t positions in a row one is chosen, unless
the text there has a period of at most t / 4.  Stretches of such a period are left out of the choice: they lie in runs that
smaller scales have found already.  Two chosen positions with equal next 2t words and none such between them, t to 2t - 1 apart,
propose their distance as a period: every run with a period from t to 2t - 1 gets a proposal, and no multiple of a smallest
period is proposed.  Proposals that touch are joined, grown word by word to both sides, and compared word for word.

Words are runs of characters other than space and U+0009 to U+000D.  Many texts are worked on at once, longest first, so that a
scale reads the texts that are long enough for it only; a separator that occurs once stands between them.  Rows need no shuffle,
and a task holds about ``AT_ONCE`` words, or one text.

Null texts are empty; texts without words have no runs.  Texts of any length are taken whole.  Rows that repeat ids or texts are
looked at one by one.  Of runs that begin together the one with the smaller period comes first.  Columns besides id and text
are not looked at.  An empty table gives no rows.  Null ids are texts like any other, and are never planted with a period.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import arrow_schema, read_table, text_or_empty

#: Words that are worked on at once.
AT_ONCE = 200_000
#: Words that a grown stretch is compared by at once.
GROW = 64
#: How often a run holds its period at least, and the fewest words of a run that is reported.
TIMES, LEAST = 4, 6
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _window_min(v: np.ndarray, t: int) -> np.ndarray:
    """Smallest of each value and the ``t`` after it (``t`` a power of two)."""
    m, span = v, 1
    while span < t:
        m, span = np.minimum(m[:-span], m[span:]), 2 * span
    return np.minimum(m[:-1], v[t:])


def synchronising(v: np.ndarray, t: int) -> np.ndarray:
    """Chosen positions by the hashes ``v`` of the stretches of ``t`` words (the largest value: left out)."""
    m = _window_min(v, t)
    return np.flatnonzero((m != _LAST) & ((m == v[: len(m)]) | (m == v[t:])))


def _grown(w: np.ndarray, at: np.ndarray, period: np.ndarray, side: int) -> np.ndarray:
    """How many words in a row, from ``at`` to the side (-1 or 1), equal the word a period after them."""
    out, open_ = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
    steps = np.arange(GROW)
    while len(open_):
        p = period[open_]
        place = (at[open_] + side * out[open_])[:, None] + side * steps
        place = np.clip(place, 0, (len(w) - 1 - p)[:, None])  # both ends are separators, which equal no other word
        equal = w[place] == w[place + p[:, None]]
        whole = equal.all(1)
        out[open_] += np.where(whole, GROW, equal.argmin(1))
        open_ = open_[whole]
    return out


def find_runs(w: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all stretches that hold their smallest period four times and cannot be extended.

    ``w`` are word numbers; texts are in falling order of their ``lengths``, text i ends before position ``ends[i]``, where its
    separator is; a separator comes first too.  Separators are numbers that occur once.
    """
    found: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)]
    hashes, t = _mix(w.astype(np.uint64) * _A + _B), 1
    while len(lengths) and TIMES * t <= lengths[0]:
        texts = int(np.searchsorted(-lengths, -TIMES * t, side="right"))
        w = w[: ends[texts - 1] + 1]
        hashes = hashes[: len(w) - t + 1]
        runs = np.concatenate(found)
        inner = runs[(runs[:, 2] * TIMES <= t) & (runs[:, 1] >= t) & (runs[:, 0] + runs[:, 1] <= len(w))]
        v = hashes
        if len(inner):
            change = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(change, inner[:, 0], 1)
            np.add.at(change, inner[:, 0] + inner[:, 1] - t + 1, -1)
            v = np.where(np.cumsum(change[:-1]) > 0, _LAST, hashes)
        after = _mix(hashes[:-t] * _A + (hashes[t:] ^ (hashes[t:] >> np.uint64(32))))
        chosen = synchronising(v, t)
        context = after[chosen]
        order = np.argsort(context, kind="stable")
        place, context = chosen[order], context[order]
        apart = np.diff(place)
        proposed = (context[1:] == context[:-1]) & (apart >= t) & (apart < 2 * t)
        if proposed.any():
            found.append(_exact(w, place[:-1][proposed], apart[proposed], t))
        hashes, t = after, 2 * t
    return np.concatenate(found)


def _exact(w: np.ndarray, place: np.ndarray, period: np.ndarray, t: int) -> np.ndarray:
    """The runs behind proposals, each once."""
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.r_[True, (np.diff(period) != 0) | (place[1:] > place[:-1] + 2 * t)]
    first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(place)] - 1
    a, b, p = place[first], place[last] + 2 * t, period[first]
    a, b = a - _grown(w, a - 1, p, -1), b + _grown(w, b, p, 1)
    runs = np.unique(np.stack([a, b - a + p, p], 1)[b - a + p >= TIMES * p], axis=0)
    same = [np.array_equal(w[s : s + n - q], w[s + q : s + n]) for s, n, q in runs.tolist()]
    return runs[np.array(same, dtype=bool)]


def runs_of_texts(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The reported runs (start, length, period) of each list of words, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts[i] for i in order)), dtype=np.int64)
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    w = np.zeros(len(ids) + len(texts) + 1, dtype=np.int64)
    gap = np.zeros(len(w), dtype=bool)
    gap[np.r_[0, ends]] = True
    w[gap], w[~gap] = np.arange(len(texts) + 1) + len(numbers), ids
    found = find_runs(w, ends, lengths)
    found = found[found[:, 1] >= LEAST]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = ends - lengths
    for n, (s, length, q) in zip(np.searchsorted(starts, found[:, 0], side="right") - 1, found.tolist(), strict=True):
        out[order[n]].append((s - int(starts[n]), length, q))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def plant(doc_id: int | None, words: list) -> list:
    """One text in ten, by its id, has its end replaced by repetitions of its middle."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((len(words) - a) // len(tail) + 1))[: len(words) - a]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None) -> DataFrame:
    """id, n_words, ``runs`` (array of start, length, period in words) and ``collapsed``: the text without repeated periods.

    ``change`` is a function of id and words that is applied to each text's words first.
    """
    kind, arrow = arrow_schema("id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

    def some(ids: list, texts: list[list]):
        runs = runs_of_texts(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, arrow.field(0).type),
                pa.array([len(x) for x in texts], arrow.field(1).type),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], arrow.field(2).type),
                pa.array([b" ".join(collapsed(x, r)) for x, r in zip(texts, runs, strict=True)], pa.binary()).cast(arrow.field(3).type),
            ],
            schema=arrow,
        )

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = t.split()  # of bytes: by space and 9 to 13 only
                    words = words if change is None else change(i, words)
                    ids.append(i)
                    texts.append(words)
                    held += len(words) + 1
                    if held >= AT_ONCE:
                        yield some(ids, texts)
                        ids, texts, held = [], [], 0
        if ids:
            yield some(ids, texts)

    return docs.select(F.col(key).cast("bigint"), text_or_empty(text).cast("binary")).mapInArrow(run, kind)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(read_table(spark, sf_dir, "documents"), change=plant)
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL: dict[str, str] = {}
