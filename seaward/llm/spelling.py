"""Spelling variants: blocked Gram matrices of letter counts propose pairs one edit apart, comparison of letters verifies them.

Words are runs of letters, counted over all texts.  One edit changes the counts of letters by 1 in one place (a letter put in or
left out) or in two (a letter replaced), so the squared distance of two words' letter counts is 1 or 2 then.  Words are blocked
by how many of their letters fall in each of a few groups of the alphabet; blocks of one word length differ in these numbers
only, and a neighbour is in the same block, in one with a letter moved to another group, or in one of the next length with a
letter less.  A word visits those blocks (a pair meets once, in the block of its shorter word or, of equal lengths, in the one
that a letter was moved to, to a later group).  In a block one matrix product of letter counts, extended by the squared
lengths, gives all squared distances between its words and its visitors; pairs at 1 or 2 are compared letter by letter.

The number of groups grows with the logarithm of the vocabulary and the results do not depend on it.  A block of more than
``TILE`` words is cut in tiles by hash; each pair of tiles is one unit of work, so that a unit holds a bounded number of
words whatever block is hot.  What leaves a unit is one row for each word: how many neighbours, and the most frequent.

Null texts are empty.  Texts and words of any length are taken whole.  Rows that repeat ids or texts all count.  Words as
frequent as another are ordered by code points.  Columns besides id and text are not looked at.  An empty table, or one without
words, gives no rows.  Null ids are texts like any other, whose words are never changed by ``misspelt``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import arrow_schema, materialize, read_table, text_or_empty
from seaward.operators import small

#: Letters of words; runs of them, as long as possible, are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a block (of up to ``USUAL`` letters; of longer ones fewer) that one unit holds, visitors that one matrix product
#: takes, and letters that are compared at once.
TILE, USUAL, VISITORS, CELLS = 1024, 64, 4096, 1 << 22
#: Different words that a task counts before it hands them on.
HELD = 200_000
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def misspelt(doc_id: int | None, word: str) -> str:
    """One word in 31 of a text loses a letter, by a hash of id and word."""
    h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 7, change=None) -> DataFrame:
    """word and n: how often each word of at least ``shortest`` letters occurs, A to Z in lower case.

    ``change`` is a function of id and word that gives the word to count instead.
    """
    kind, arrow = arrow_schema("word string, n bigint")
    words = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def told(counts: dict):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), arrow.field(0).type), pa.array(counts.values(), arrow.field(1).type)], schema=arrow)

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own: Counter = Counter()
                    for w, n in Counter(words.findall(t)).items():
                        own[w.lower() if w.isascii() else w.translate(_UPPER)] += n
                    for w, n in own.items():
                        if change is not None:
                            w = change(i, w)
                            if len(w) < shortest:
                                continue
                        counts[w] = counts.get(w, 0) + n
                if len(counts) >= HELD:
                    yield told(counts)
                    counts = {}
        if counts:
            yield told(counts)

    parts = docs.select(F.col(key).cast("bigint"), text_or_empty(text)).mapInArrow(run, kind)
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, n_words: int) -> list[str]:
    """The letters in groups of about equal use.  Letters are those of the alphabet: a list of bounded length."""
    used = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    n = max(2, min(12, 3 + round(math.log10(max(n_words, 10) / 1e4))))
    groups = ["" for _ in range(n)]
    for i, r in enumerate(used):
        groups[i % n if i // n % 2 == 0 else n - 1 - i % n] += r.c
    return groups


def block_of(counts: list[Column], less: int | None = None, more: int | None = None) -> Column:
    """A block's name: the counts of the groups, with one letter less in one group and one more in another."""
    return F.concat_ws(",", *((c - 1 if i == less else c + 1 if i == more else c).cast("string") for i, c in enumerate(counts)))


def units(words: DataFrame, groups: list[str]) -> DataFrame:
    """The words in their units of work: block, x, y (its tiles), side (left: words of tile x; right: what they meet), word, n."""
    size = len(groups)
    counted = words.withColumns({f"c{i}": F.length("word") - F.length(F.translate("word", g, "")) for i, g in enumerate(groups)})
    c = [F.col(f"c{i}") for i in range(size)]
    place = lambda block, own, *given: F.when(given[0] > 0, F.struct(block.alias("block"), F.lit(own).alias("own"))) if given else F.struct(block.alias("block"), F.lit(own).alias("own"))
    places = [place(block_of(c), True), *(place(block_of(c, i), False, c[i]) for i in range(size)), *(place(block_of(c, i, j), False, c[i]) for i in range(size) for j in range(i + 1, size))]
    blocks = counted.groupBy(block_of(c).alias("block")).agg((F.count(F.lit(1)) * F.greatest(F.lit(1.0), F.max(F.length("word")) / USUAL)).alias("held"))
    met = counted.select("word", "n", F.explode(F.array_compact(F.array(*places))).alias("p")).select("word", "n", "p.*").join(small(blocks), "block")
    tiles = F.ceil(F.col("held") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    unit = lambda x, y, left: F.struct(x.alias("x"), y.alias("y"), F.lit(left).alias("is_left"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    own = F.concat(F.transform(every, lambda y: unit(F.col("tile"), y, True)), F.transform(F.filter(every, lambda x: x < F.col("tile")), lambda x: unit(x, F.col("tile"), False)))
    visits = F.transform(every, lambda x: unit(x, F.col("tile"), False))
    placed = met.withColumn("tiles", tiles).withColumn("tile", tile).withColumn("u", F.explode(F.when(F.col("own"), own).otherwise(visits)))
    return placed.select("block", "u.x", "u.y", "u.is_left", "word", "n")


def letter_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter counts (a row for each word), the letters themselves (padded by 0), and the words' lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    seen = np.bincount(codes) > 0
    number, n = np.cumsum(seen) - 1, int(seen.sum())
    counts = np.bincount(row * n + number[codes], minlength=len(words) * n).reshape(-1, n)
    letters = np.zeros((len(words), int(lengths.max()) + 1), dtype=np.uint8 if len(seen) <= 256 else np.uint32)
    letters[row, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = codes
    return counts, letters, lengths


def one_edit(letters: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by one letter put in, left out or replaced."""
    a, b = np.where(lengths[a] >= lengths[b], a, b), np.where(lengths[a] >= lengths[b], b, a)
    equal = letters[a] == letters[b]
    same_length = lengths[a] == lengths[b]
    first = equal.argmin(1)  # equal words have no false; they are no pairs here
    shifted = letters[a][:, 1:] == letters[b][:, :-1]
    after = np.arange(shifted.shape[1]) >= first[:, None]
    left_out = (lengths[a] == lengths[b] + 1) & (shifted | ~after).all(1)
    return np.where(same_length, (~equal).sum(1) == 1, left_out)


def near_pairs(left: int, words: list[str], within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart of the first ``left`` words with the others, and (``within``) among themselves."""
    counts, letters, lengths = letter_matrix(words)
    squares = (counts**2).sum(1)
    kind = np.float32 if squares.max() < 2**20 else np.float64
    ones = np.ones(len(words))
    rows = np.column_stack([2 * counts[:left], -squares[:left], -ones[:left]]).astype(kind)
    columns = np.column_stack([counts, ones, squares]).astype(kind)
    found = []
    for at in range(0 if within else left, len(words), VISITORS):
        product = rows @ columns[at : at + VISITORS].T  # minus the squared distances
        a, b = np.nonzero(product > -2.5)
        apart = product[a, b] < -0.5
        a, b = a[apart], b[apart] + at
        if within:
            a, b = a[(b >= left) | (a < b)], b[(b >= left) | (a < b)]
        step = max(1, CELLS // letters.shape[1])
        for part in range(0, len(a), step):
            x, y = a[part : part + step], b[part : part + step]
            good = one_edit(letters, lengths, x, y)
            found.append((x[good], y[good]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def neighbours(words: DataFrame, groups: list[str]) -> DataFrame:
    """word, n_near and the most frequent neighbour (near_n, near) of each word that has neighbours."""
    _, arrow = arrow_schema("word string, n_near bigint, near_n bigint, near string")

    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("is_left").to_numpy()
        order = np.argsort(~is_left, kind="stable")
        table = table.take(pa.array(order))
        left, names, n = int(is_left.sum()), table.column("word").to_pylist(), table.column("n").to_numpy()
        if not left or len(names) < 2:
            return arrow.empty_table()
        a, b = near_pairs(left, names, table.column("x")[0].as_py() == table.column("y")[0].as_py())
        if not len(a):
            return arrow.empty_table()
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        used = sorted(np.unique(a).tolist(), key=lambda i: (-n[i], names[i]))
        rank = np.full(len(names), len(used))
        rank[used] = np.arange(len(used))
        best = np.full(len(names), len(used))
        np.minimum.at(best, a, rank[b])
        counts = np.bincount(a, minlength=len(names))
        near = [used[best[i]] for i in used]
        return pa.table([[names[i] for i in used], counts[used], n[near], [names[i] for i in near]], schema=arrow)

    found = units(words, groups).groupBy("block", "x", "y").applyInArrow(run, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.w").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms from each word (``links``: word, form).

    Each round doubles the steps.  Along a chain the counts grow by the ratio, so there are few rounds.
    """
    held = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = small(held.select(F.col("word").alias("root"), F.col("root").alias("further")))
        jumped = held.join(next_, "root", "left")
        if jumped.filter("further IS NOT NULL").limit(1).count() == 0:  # one row
            return held
        held = materialize(jumped.select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def variants(counts: DataFrame, least: int = 2, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words (word, n) that occur at least ``least`` times.

    A word's form is its most frequent neighbour, if that occurs at least ``ratio`` times as often.
    """
    words = materialize(counts.filter(F.col("n") >= least), "spelling-words")
    groups = letter_groups(words, words.count())
    found = words.join(neighbours(words, groups), "word", "left")
    good = F.col("near_n") >= F.col("n") * ratio
    formed = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(word_counts(read_table(spark, sf_dir, "documents"), change=misspelt))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
SQL: dict[str, str] = {}
