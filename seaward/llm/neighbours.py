"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Largest inner product becomes nearest Euclidean distance by one more dimension (sqrt(M^2 - |x|^2), M the largest norm; 0
for queries).  Each table has ``k`` functions floor(a.x / w + b) with Gaussian a and w the deviation of a.x over all rows, so that
tables fit dense and wide data alike; every row is indexed in each table.  A query visits the buckets that success is likeliest in, in the order of the squared distances from its projections to the
buckets' sides, in rounds of growing size.  After a round the distance of its ``top``-th best candidate gives the
probability that a neighbour so near lies in a bucket visited: differences of projections are normal with that distance as
their deviation.  A query is done when the tables together reach the target.  The estimate is on the safe side, as the best
candidates so far are never nearer than the true ones.  Nothing is fitted on a sample, so all sizes are treated alike.

A query that is not done after the last round (an outlier whose buckets are empty, or data without near neighbours) visits
the blocks of a last table, which holds all rows dealt by their id: the exact way for the rest.  So each query gets its
``top`` rows wherever there are so many candidates.

Buckets are dealt to shards of about one block of rows, and a query goes to a shard once, with the list of its buckets
there.  A shard's rows (a hot bucket, say) and its visitors are each dealt to blocks of bounded bytes, and all pairs of
blocks meet, so hot buckets become many tasks and none is capped.  A task returns the best ``top`` of each query, and from
the second round on only those that beat what the query has: its own bound, which loses nothing.  The score is the inner
product of the original vectors in double precision, summed in one fixed way, so that equal vectors tie exactly.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids.  Vectors of
different lengths never meet.  Rows that repeat an id are one candidate (their best score counts); as queries they are one
query, with its best scores.  Ties go to the smaller id.  Other columns are not looked at, whatever their names.  An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seaward.llm.common import map_columns, materialize, read_table

#: Tables; the probability that a row as near as the last neighbour is in a bucket visited; buckets of a table visited
#: at most after each round, likeliest first.
TABLES, TARGET, ROUNDS = 2, 0.9, (4, 16, 64, 256)
#: Rows of a bucket on average; rows of a block at most, and their bytes (about).
BUCKET_ROWS, BLOCK, BLOCK_BYTES = 800, 8192, 1 << 25
_SLOTS, _STEPS = 4.0, 5


@lru_cache(maxsize=64)
def directions(length: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (tables x k x (length + 1)) and shifts (tables x k) for vectors of one length."""
    rng = np.random.default_rng([seed, length])
    return rng.normal(size=(TABLES, k, length + 1)), rng.uniform(size=(TABLES, k))


def functions_for(rows: int) -> int:
    """How many functions a table of so many rows has: its buckets then hold ``BUCKET_ROWS`` rows or so."""
    return max(0, round(math.log(max(rows, 1) / BUCKET_ROWS) / math.log(_SLOTS)))


def project(x: np.ndarray, k: int, largest: float, query: bool) -> np.ndarray:
    """Rows x tables x k: projections."""
    a, _ = directions(x.shape[1], k)
    norm = np.sqrt((x * x).sum(1))
    if query:
        wide = np.concatenate([x / norm[:, None], np.zeros((len(x), 1))], 1)
    else:
        rest = np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))
        wide = np.concatenate([x / largest, rest[:, None]], 1)
    return np.einsum("nd,tkd->ntk", wide, a)


def slots(x: np.ndarray, k: int, largest: float, widths: np.ndarray, query: bool) -> np.ndarray:
    """Rows x tables x k: projections in units of the bucket widths (tables x k), shifted."""
    return project(x, k, largest, query) / widths[None] + directions(x.shape[1], k)[1][None]


def bucket_ids(cells: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each row of whole numbers (a fixed polynomial hash; no functions: 0)."""
    out = np.zeros(cells.shape[:-1], dtype=np.int64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[-1]):
            out = out * np.int64(1_000_003) + cells[..., j].astype(np.int64) + np.int64(7)
    return out


def probe_steps(f: np.ndarray, count: int) -> np.ndarray:
    """Steps from the own cell of the projections ``f`` (one table) to the ``count`` likeliest cells, likeliest first."""
    k = len(f)
    side = f - np.floor(f)
    steps = [sorted([(0.0, 0)] + [(float(d - u) ** 2, d) for d in range(1, _STEPS + 1)] + [(float(u + d - 1) ** 2, -d) for d in range(1, _STEPS + 1)]) for u in side]
    out, heap = [], [(0.0, (0,) * k, 0)]
    while heap and len(out) < count:
        cost, at, last = heapq.heappop(heap)
        out.append([steps[j][at[j]][1] for j in range(k)])
        for j in range(last, k):  # each set of steps is reached once: from the one with its last step taken back
            if at[j] + 1 < len(steps[j]):
                heapq.heappush(heap, (cost - steps[j][at[j]][0] + steps[j][at[j] + 1][0], (*at[:j], at[j] + 1, *at[j + 1 :]), j))
    return np.array(out, dtype=np.int64).reshape(len(out), k)


def reached(fs: np.ndarray, steps: list[np.ndarray], distance: float, widths: np.ndarray) -> np.ndarray:
    """Probability that a row at this distance is in one of the first 1, 2, ... cells of any table."""
    missed = np.ones(len(steps[0]))
    if not fs.shape[1]:  # without functions the one bucket holds all
        return np.ones(1)
    for f, s, w in zip(fs, steps, widths, strict=True):
        edges = (np.arange(-_STEPS, _STEPS + 2)[None, :] - (f - np.floor(f))[:, None]) * w[:, None] / (max(distance, 1e-9) * math.sqrt(2))
        chance = np.diff(np.array([[math.erf(e) for e in row] for row in edges]), axis=1) / 2
        missed *= 1 - np.minimum(1, np.cumsum(np.prod(chance[np.arange(len(f))[None, :], s + _STEPS], axis=1)))
    return 1 - missed


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in the same order."""
    return (x * q).sum(axis=1)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id, v (doubles), n (length) of the rows that take part."""
    rows = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"), F.size(column).alias("n"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & (F.col("n") > 0) & finite & F.exists("v", lambda x: x != 0))


def _by_shape(batch: dict):
    """Positions of a run of rows by vector length, with the vectors and the functions, largest norm and widths of that length."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(batch["n"]):
        by_length.setdefault(n, []).append(i)
    for n, at in by_length.items():
        k = functions_for(batch["rows"][at[0]])
        widths = np.array(batch["widths"][at[0]]).reshape(TABLES, k) if "widths" in batch else None
        yield n, at, np.array([batch["v"][i] for i in at]), k, batch["largest"][at[0]], widths


def _spreads(batch: dict) -> dict:
    """Sums that the deviation of each projection follows from."""
    out = {"n": [], "j": [], "c": [], "s": [], "ss": []}
    for n, at, x, k, largest, _ in _by_shape(batch):
        p = project(x, k, largest, False).reshape(len(at), -1)
        for name, value in (("n", [n] * p.shape[1]), ("j", range(p.shape[1])), ("c", [len(at)] * p.shape[1]), ("s", p.sum(0)), ("ss", (p * p).sum(0))):
            out[name] += list(value)
    return out


def _index(batch: dict) -> dict:
    out = {"tab": [], "bucket": [], "id": [], "v": []}
    for n, at, x, k, largest, widths in _by_shape(batch):
        cells = bucket_ids(np.floor(slots(x, k, largest, widths, False)))
        for i, v, row in zip(at, x, cells, strict=True):
            for t in range(TABLES if k else 1):  # without functions one bucket holds all
                for name, value in (("tab", n * (TABLES + 1) + t), ("bucket", int(row[t])), ("id", batch["id"][i]), ("v", v.tobytes())):
                    out[name].append(value)
    return out


def _visits(rounds: tuple[int, ...], step: int):
    """Visits of one round: for each open query its next buckets, up to the target; nothing for those that are done."""
    first, last = rounds[step - 1] if step else 0, rounds[step]

    def run(batch: dict) -> dict:
        out = {"tab": [], "buckets": [], "id": [], "v": [], "least": []}
        for n, at, x, k, largest, widths in _by_shape(batch):
            norms = np.sqrt((x * x).sum(1))
            for i, v, norm, fs in zip(at, x, norms, slots(x, k, largest, widths, True), strict=True):
                least = batch["least"][i]
                fs = fs[: TABLES if k else 1]
                steps, upto = [probe_steps(f, last) for f in fs], last
                if least is not None:  # as many as are asked for have been found: go on to the target only
                    enough = np.flatnonzero(reached(fs, steps, math.sqrt(max(0.0, 2 - 2 * least / (norm * largest))), widths) >= TARGET)
                    upto = int(enough[0]) + 1 if len(enough) else last
                for t, (f, s) in enumerate(zip(fs, steps, strict=True)):
                    if len(ids := bucket_ids(np.floor(f)[None] + s[first:upto])):
                        for name, value in (("tab", n * (TABLES + 1) + t), ("buckets", ids.tolist()), ("id", batch["id"][i]), ("v", v.tobytes()), ("least", least)):
                            out[name].append(value)
        return out

    return run


def _unfinished(most: int):
    """Queries that the last round, with so many buckets of each table, left below the target."""

    def run(batch: dict) -> dict:
        keep = []
        for _, at, x, k, largest, widths in _by_shape(batch):
            norms = np.sqrt((x * x).sum(1))
            for i, norm, fs in zip(at, norms, slots(x, k, largest, widths, True), strict=True):
                least = batch["least"][i]
                fs = fs[: TABLES if k else 1]
                if k and (least is None or reached(fs, [probe_steps(f, most) for f in fs], math.sqrt(max(0.0, 2 - 2 * least / (norm * largest))), widths)[-1] < TARGET):
                    keep.append(i)
        return {c: [batch[c][i] for i in keep] for c in ("id", "v", "n", "rows", "largest", "widths", "least")}

    return run


def _best(at: np.ndarray, to: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int, once: bool):
    """The ``top`` best of each query position; of rows that repeat an id (unless each is there once) the best counts."""
    if not once:
        order = np.lexsort((-score, ids[to], at))
        at, to, score = at[order], to[order], score[order]
        first = np.append(True, (at[1:] != at[:-1]) | (ids[to][1:] != ids[to][:-1]))[: len(at)]
        at, to, score = at[first], to[first], score[first]
    order = np.lexsort((ids[to], -score, at))
    at, to, score = at[order], to[order], score[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < top
    return at[best], to[best], score[best]


def _compare(top: int):
    """The best candidates of each visitor among a block's rows, in the buckets that it visits."""

    def run(xs, qs):
        import pandas as pd

        out = {"query_id": [], "id": [], "score": []}
        if len(xs) and len(qs):
            xs = xs.sort_values("bucket", kind="stable")
            x, q = (np.frombuffer(b"".join(d["v"]), dtype=np.float64).reshape(len(d), -1) for d in (xs, qs))
            ids, own, least = xs["id"].to_numpy(), qs["id"].to_numpy(), qs["least"].fillna(-np.inf).to_numpy()
            once = len(np.unique(ids)) == len(ids)
            held, starts = np.unique(xs["bucket"].to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(xs))
            asked = np.repeat(np.arange(len(qs)), [len(b) for b in qs["buckets"]])
            wanted = np.concatenate([np.asarray(b, dtype=np.int64) for b in qs["buckets"]])
            order = np.lexsort((asked, wanted))
            asked, wanted = asked[order], wanted[order]
            found = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
            for b, s, e in zip(held, starts, ends, strict=True):
                visitors = asked[np.searchsorted(wanted, b) : np.searchsorted(wanted, b, "right")]
                for cut in range(0, len(visitors), 256):
                    some = visitors[cut : cut + 256]
                    near, low = q[some] @ x[s:e].T, least[some]
                    if once and e - s > top:  # of these rows no more than the best can count
                        low = np.maximum(low, np.partition(near, e - s - top - 1, axis=1)[:, e - s - top - 1])
                    at, to = np.nonzero(near >= (low - 1e-9 * np.maximum(1, np.abs(low)))[:, None])
                    at, to = some[at], to + s
                    other = ids[to] != own[at]
                    at, to = at[other], to[other]
                    score = np.concatenate([exact_scores(x[to[i : i + 65_536]], q[at[i : i + 65_536]]) for i in range(0, len(at), 65_536)] or [np.zeros(0)])
                    found = [np.concatenate(p) for p in zip(found, _best(at, to, score, ids, top, once), strict=True)]
            at, to, score = _best(*found, ids, top, once)
            out = {"query_id": own[at], "id": ids[to], "score": score}
        return pd.DataFrame(out)

    return run


def _block_rows(tab):
    """Rows of a block for the vectors of one table (its number tells their length)."""
    return F.greatest(F.lit(256), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES / 8) / F.floor(tab / F.lit(TABLES + 1)))))


def _meet(index: DataFrame, visits: DataFrame, kind: str, top: int, label: str) -> DataFrame:
    """query_id, id, score found by the visits (tab, buckets, id, v, least) in the index (tab, bucket, shard, id, v).

    A shard is a whole number that a bucket determines; ``visits`` are exploded to the shards of their buckets here.
    """
    shards = index.select("tab", "shard", "shards").groupBy("tab").agg(F.max("shards").alias("shards"))  # a row for each table
    each = visits.join(F.broadcast(shards), "tab").select("tab", "id", "v", "least", "shards", F.explode("buckets").alias("b"))
    each = each.withColumn("shard", F.pmod(F.xxhash64("b"), F.col("shards"))).groupBy("tab", "shard", "id").agg(F.collect_list("b").alias("buckets"))
    n_rows = index.groupBy("tab", "shard").agg(F.ceil(F.count(F.lit(1)) / _block_rows(F.col("tab"))).cast("int").alias("xs"))
    n_visits = each.groupBy("tab", "shard").agg(F.ceil(F.count(F.lit(1)) / _block_rows(F.col("tab"))).cast("int").alias("qs"))
    met = materialize(n_rows.join(n_visits, ["tab", "shard"]), f"{label}-blocks")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    keys = ["tab", "shard", "x", "q"]
    left = index.join(met, ["tab", "shard"]).withColumn("x", mine("xs", 1)).withColumn("q", upto("qs")).select(*keys, "bucket", "id", "v")
    vectors = visits.select("tab", "id", "v", "least").distinct()
    right = each.join(met, ["tab", "shard"]).withColumn("q", mine("qs", 2)).withColumn("x", upto("xs")).join(vectors, ["tab", "id"]).select(*keys, "buckets", "id", "v", "least")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return parts.applyInPandas(_compare(top), f"query_id {kind}, id {kind}, score double")


def search(vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding", top: int = 20, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """query_id, rank, ``key``, score of the ``top`` best candidates found for each row that ``is_query`` holds for."""
    kind = dict(vectors.dtypes)[key]
    marked = vectors.withColumn(mark := "_" + max(vectors.columns, key=len), is_query)
    rows = usable(marked, key, column)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # One row for each length that vectors have, so at most as many as the longest has components.
    sizes = F.broadcast(rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.max(F.sqrt(norm2)).alias("largest")))
    sums = map_columns(rows.join(sizes, "n"), _spreads, "n int, j int, c long, s double, ss double")
    mean = F.sum("s") / F.sum("c")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("ss") / F.sum("c") - mean * mean))
    each = sums.groupBy("n", "j").agg(F.when(spread > 1e-6, spread).otherwise(1.0).alias("w")).groupBy("n").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("w"))
    widths = each.select("n", F.col("w.w").alias("widths"))
    shape = sizes.join(widths, "n", "left").withColumn("widths", F.coalesce("widths", F.array().cast("array<double>")))
    sizes = F.broadcast(materialize(shape, "lsh-shapes"))
    rows = rows.join(sizes, "n")
    queries = materialize(usable(marked.filter(mark), key, column).join(sizes, "n"), "lsh-queries")
    row_kind = f"tab long, bucket long, id {kind}, v binary"
    state_kind = f"id {kind}, v array<double>, n int, rows long, largest double, widths array<double>, least double"
    placed = materialize(map_columns(rows, _index, row_kind), "lsh-rows")
    shards = placed.groupBy("tab").agg(F.ceil(2 * F.count(F.lit(1)) / _block_rows(F.col("tab"))).alias("shards"))  # a row for each table
    index = placed.join(F.broadcast(shards), "tab").withColumn("shard", F.pmod(F.xxhash64("bucket"), F.col("shards")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))

    def merged(old, new, name):
        both = new if old is None else old.drop("rank").unionByName(new)
        once = both.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return materialize(once.withColumn("rank", order).filter(F.col("rank") <= top), name)

    def with_bounds(best):
        if best is None:
            return queries.withColumn("least", F.lit(None).cast("double"))
        known = best.filter(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        return queries.join(known, "id", "left")

    best = None
    for step in range(len(rounds)):
        visits = materialize(map_columns(with_bounds(best), _visits(rounds, step), f"tab long, buckets array<long>, id {kind}, v binary, least double"), f"lsh-visits-{step}")
        if step and not visits.limit(1).count():
            break
        best = merged(best, _meet(index, visits, kind, top, f"lsh-{step}"), f"lsh-best-{step}")
    left = materialize(map_columns(with_bounds(best), _unfinished(rounds[-1]), state_kind), "lsh-left")
    if left.limit(1).count():
        # All rows, dealt to blocks by their id: first one block, which bounds what the others need to return.
        tab = (F.col("n") * (TABLES + 1) + TABLES).cast("long")
        blocks = lambda c: F.ceil(c / _block_rows(tab))
        packed = map_columns(rows.drop("widths").join(left.select("n").distinct(), "n", "left_semi"), lambda b: b | {"v": [np.array(v).tobytes() for v in b["v"]]}, f"n int, id {kind}, v binary, rows long, largest double")
        every = packed.select(tab.alias("tab"), F.pmod(F.xxhash64("id", F.lit(3)), blocks(F.col("rows"))).alias("bucket"), "id", "v")
        every = every.join(F.broadcast(packed.groupBy(tab.alias("tab")).agg(F.max(blocks(F.col("rows"))).alias("shards"))), "tab").withColumn("shard", F.pmod(F.xxhash64("bucket"), F.col("shards")))
        for name, pick in (("one", lambda b: F.array(F.lit(0).cast("long"))), ("all", lambda b: F.sequence(F.lit(1).cast("long"), b - 1))):
            now = left.drop("least").join(with_bounds(best).select("id", "least"), "id") if name == "all" else left
            now = now.filter(blocks(F.col("rows")) > 1) if name == "all" else now
            asked = map_columns(now.drop("widths"), lambda b: b | {"v": [np.array(v).tobytes() for v in b["v"]]}, f"id {kind}, v binary, n int, rows long, largest double, least double")
            visits = materialize(asked.select(tab.alias("tab"), pick(blocks(F.col("rows"))).alias("buckets"), "id", "v", "least"), f"lsh-{name}")
            best = merged(best, _meet(every, visits, kind, top, f"lsh-{name}"), f"lsh-best-{name}")
    return best.select("query_id", "rank", F.col("id").alias(key), "score")


def op8_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op8_multiprobe_lsh": op8_multiprobe_lsh}
SQL: dict[str, str] = {}
