"""Lexical retrieval packing: documents that share rare tokens are put in the same training sequences.

1. Documents are tokenised once; the same tasks count in how many documents each token is.  Counts and mean length are those
   of all documents.
2. Documents are ordered by their strongest tokens (BM25 weights of the whole table), wherever their rows lie, and cut in
   two steps: in at most ``RANGES`` ranges at documents of a bounded sample, the only ones that the driver sees, and each range,
   sorted in its task, in shards of bounded size as its rows pass by.  Documents with the same strong tokens come to the same
   shard.  An id hash is last in the order, so that no group of equal or similar texts can gather in one task.
3. A shard has an inverted index over token ids; all tokens of a seed document query it, and the best unused neighbours
   fill the seed's window of 4096 tokens greedily, down the ranking until it is full or none shares a token.

The document that no longer fits whole is cut, and its rest is the seed of the next window, so windows have no padding.
What is left at a shard's end is cut into sequences whose lengths are powers of two, which need none.  Neither files nor
splits change the result.

Null and empty texts hold only the end id.  Rows with equal ids or equal texts are packed once each.  Texts of any length are
tokenised whole and cut over as many windows as they need.  Ties: neighbours of equal score go in the shard's order (hash of
id and text, then ids).  Other columns are not looked at, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import arrow_schema, give_back, map_columns, materialize, read_table, text_or_empty

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1_500_000
#: Strongest tokens that order documents; documents sampled for each cut between ranges, at least, and at most.
KEY_TERMS, SAMPLED, LEAST_SAMPLE, MOST_SAMPLE = 3, 40, 8192, 1 << 18
#: Most ranges: their cuts are sent to all tasks (some 100 bytes each), and a range is sorted, not held, in one task.
RANGES = 1 << 14
K1, B = 1.2, 0.75
#: Share of the documents in a shard's index that are unused when the used ones leave it.
KEPT = 0.8
#: Chunks whose ids a worker keeps; beyond it the store starts anew (a bound on memory, not on results).
CACHE = 1_000_000
#: Text that is tokenised at once (the more, the fewer words are looked up twice).
SLICE_BYTES = 2 << 20
#: Bytes of texts, about, that Spark sends to a tokenising worker at once: both sides hold as much.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Ids whose documents' distinct tokens are counted at once.
TOKENS_AT_ONCE = 500_000
#: Signs that may stand behind a word, one at most; those of which several may, where the file splits runs of signs from letters.
SIGNS, RUNS = ".,;:!?", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MOST_SIGNS = 8
#: Bytes of a word that the store of words takes; the few longer ones go with other chunks.
WORD_BYTES = 16
#: Words of letters below U+0130: these do not compose with each other, and every splitting rule that keeps letters
#: together takes them as one word.
LATIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"
#: New words that are encoded in one line.
WORDS_AT_ONCE = 64
#: White space on which splitting rules differ; a text with such signs is encoded in one call.
_UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Tokens:
    """Ids of a tokenizer that drops white space, so that each stretch between white space is encoded by itself."""

    _made: dict = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.store, self.ids = Words(), {}  # of lower-case words; of other parts
        # Stretches between white space have ids by themselves only where the file says that white space is dropped, and
        # words share the ids of their lower-case form only where it says that texts are lower-cased.
        steps = json.loads(self.model.to_str())
        cuts, forms = _steps(steps.get("pre_tokenizer")), {s.get("type") for s in _steps(steps.get("normalizer"))}
        bytewise = [s for s in cuts if s.get("type") == "ByteLevel"]
        self.splits = bool(cuts) and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert", False)
        self.splits &= not any(s.get("add_prefix_space") or s.get("use_regex") for s in bytewise) and "Metaspace" not in {s.get("type") for s in cuts}
        self.lowers = self.splits and "Lowercase" in forms
        suffix = steps["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.model.get_vocab_size(), dtype=bool) if self.splits and suffix else None
        if self.last is not None:
            self.last[[i for token, i in self.model.get_vocab().items() if token.endswith(suffix)]] = True
        self.words = self._of_words(steps, cuts) if self.lowers and self.last is not None else self.model
        # Letters and runs of signs are pieces of their own by such a rule alone; its only other signs are apostrophes.
        rule = cuts[0]["pattern"].get("Regex", "").split("|") if self.lowers and isinstance(cuts[0].get("pattern"), dict) else []
        letters = {"[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"}
        runs = letters <= set(rule) and all(r.startswith("'") for r in set(rule) - letters - {"[\\p{N}]"})
        self.signs, self.most_signs = (RUNS, MOST_SIGNS) if runs else (SIGNS, 1)

    def _of_words(self, steps: dict, cuts: list[dict]):
        """The same model without the steps that leave lines of lower-case Latin words as they are, where the file has such only."""
        from tokenizers import Tokenizer

        rules = [s for s in cuts if s.get("type") == "Split" and "[\\p{L}]+" in s["pattern"].get("Regex", "").split("|")]
        kept = [s for s in cuts if s.get("type") == "ByteLevel"]
        norms = _steps(steps["normalizer"])
        idle = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in norms)
        if not idle or len(rules) != 1 or len(rules) + len(kept) != len(cuts):
            return self.model
        return Tokenizer.from_str(json.dumps(steps | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *kept]}}))

    @classmethod
    def get(cls, path: str) -> Tokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def drop(cls) -> None:
        """Drops stores and models: a worker that has encoded may go on with tasks that need the room."""
        if cls._made:
            cls._made.clear()
            give_back()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers: distinct chunks are looked up, then put in their places."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = [not self.splits or _UNUSUAL.search(t) is not None for t in texts]
        chunks = pc.ascii_split_whitespace(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()))
        coded = chunks.values.dictionary_encode()
        ids, ends = gather(*self._look_up(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        at = np.append(0, ends)[chunks.offsets.to_numpy()].tolist()
        return [array("I", self.model.encode(t, add_special_tokens=False).ids).tobytes() if w else ids[a:b].tobytes() for t, w, a, b in zip(texts, whole, at[:-1], at[1:], strict=True)]

    def _look_up(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks (an Arrow array), end to end, and where each ends.

        Latin words with signs behind them are cut in Arrow, and the words looked up in numpy; all else is encoded chunk by chunk.
        """
        import pyarrow.compute as pc

        bare = pc.ascii_rtrim(chunks, self.signs)
        signs = pc.subtract(pc.binary_length(chunks), pc.binary_length(bare)).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(bare)
        short = pc.less_equal(pc.binary_length(lower), WORD_BYTES).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(bare, LATIN).to_numpy(zero_copy_only=False) & short & (signs <= self.most_signs) & self.lowers
        rows = self._rows(lower.filter(_arrow(plain)))
        # The other parts: nothing, chunks that are no such words, and the signs behind words.
        others = ["", *chunks.filter(_arrow(~plain)).to_numpy(zero_copy_only=False).tolist()]
        codes, words = np.zeros((len(chunks), 2), dtype=np.int64), len(self.store.ends)
        codes[plain, 0], codes[~plain, 0], codes[:, 1] = rows, np.arange(1, len(others)) + words, words
        for n in np.unique(signs[plain & (signs > 0)]).tolist():
            ended = plain & (signs == n)
            behind = pc.utf8_slice_codeunits(chunks.filter(_arrow(ended)), -n).dictionary_encode()
            codes[ended, 1] = behind.indices.to_numpy(zero_copy_only=False) + words + len(others)
            others += behind.dictionary.to_pylist()
        flat, ends = end_to_end(self._known(others))
        flat, ends = gather(np.append(self.store.flat, flat), np.append(self.store.ends, ends + len(self.store.flat)), codes.ravel())
        for c in [c for c in others if len(c) > 64]:  # long chunks hardly come again
            self.ids.pop(c, None)
        return flat, ends[1::2]

    def _rows(self, words) -> np.ndarray:
        """The rows of the words (an Arrow array) in the store; those not seen before are encoded together and added."""
        keys = word_keys(words)
        rows = self.store.find(keys)
        new = words.filter(_arrow(rows < 0)).dictionary_encode()
        if len(self.store.ends) + len(new.dictionary) > CACHE:
            self.store = Words()
            rows[:], new = -1, words.dictionary_encode()
        if len(new):
            found = self._encode_words(new.dictionary.to_numpy(zero_copy_only=False).tolist())
            rows[rows < 0] = new.indices.to_numpy(zero_copy_only=False) + len(self.store.ends)
            self.store.add(word_keys(new.dictionary), *end_to_end(found))
        return rows

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of these parts; those that the store lacks are encoded together."""
        new = set(parts).difference(self.ids)
        if len(self.ids) + len(new) > CACHE:
            self.ids.clear()
            new = set(parts)
        new = list(new)
        self.ids.update(zip(new, self._encode_parts(new), strict=True))
        return [self.ids[p] for p in parts]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words.  They go in lines of many where the file marks each word's last id."""
        if self.last is None:
            return self._encode_parts(words)
        lines, out = [words[at : at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)], []
        for line, e in zip(lines, self.words.encode_batch_fast([" ".join(w) for w in lines], add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(line) and ends[-1] == len(found):
                raw, at = found.tobytes(), (ends * 4).tolist()
                out += [raw[a:b] for a, b in zip([0, *at], at, strict=False)]
            else:
                out += self._encode_parts(line)
        return out


class Words:
    """Words seen before, as numbers (``word_keys``) and not as Python strings, with their ids end to end and where each ends."""

    def __init__(self):
        self.keys = np.zeros((0, WORD_BYTES // 8), dtype=np.uint64)
        self.flat, self.ends = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.hashes, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # in order of the hashes

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ h >> np.uint64(32) ^ keys[:, 1]) * np.uint64(0xC2B2AE3D27D4EB4F)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each word, or -1.  Rows are compared whole: of two words with one hash the second is not found, only."""
        if not len(self.row):
            return np.full(len(keys), -1, dtype=np.int64)
        h = self._hash(keys)
        order = np.argsort(h)
        at = np.empty(len(h), dtype=np.int64)
        at[order] = np.searchsorted(self.hashes, h[order])
        rows = self.row[np.minimum(at, len(self.row) - 1)].astype(np.int64)
        return np.where((self.keys[rows] == keys).all(axis=1), rows, -1)

    def add(self, keys: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        h = self._hash(keys)
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes = np.insert(self.hashes, at, h[order])
        self.row = np.insert(self.row, at, (order + len(self.ends)).astype(np.int32))
        self.keys = np.concatenate([self.keys, keys])
        self.ends, self.flat = np.append(self.ends, ends + len(self.flat)), np.append(self.flat, flat)


def word_keys(words) -> np.ndarray:
    """Each word (an Arrow array, no word over ``WORD_BYTES``) as that many bytes, zeros behind it, read as two numbers."""
    import pyarrow as pa
    import pyarrow.compute as pc

    padded = pc.ascii_rpad(words.cast(pa.large_string()), WORD_BYTES, "\0")
    return np.frombuffer(padded.buffers()[2] or b"", np.uint64, len(words) * WORD_BYTES // 8).reshape(-1, WORD_BYTES // 8)


def end_to_end(known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all entries in one array, and where each ends."""
    return np.frombuffer(b"".join(known), "<u4"), np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) >> 2)


def gather(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of ``flat`` (each ends at its bound) that ``codes`` name, end to end, and where each ends."""
    if not len(codes):
        return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
    count = np.diff(bounds, prepend=0)[codes]
    ends = np.cumsum(count)
    return flat[np.repeat(bounds[codes] - ends, count) + np.arange(ends[-1])], ends


def _arrow(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def _steps(step: dict | None) -> list[dict]:
    """A normaliser or splitter as a flat list of its steps."""
    if not step:
        return []
    inner = step.get("normalizers") or step.get("pretokenizers") or []
    return [x for s in inner for x in _steps(s)] if inner else [step]


class Statistics:
    """What BM25 needs to know of the whole table: number of documents, mean length, documents of each token."""

    def __init__(self, documents: int, mean: float, df: np.ndarray):
        self.mean = mean
        self.df = df
        self.idf = np.log(1 + (documents - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        held = [np.unique(d) for d in docs]
        return cls(len(docs), sum(map(len, docs)) / len(docs), np.bincount(np.concatenate(held).astype(np.int64)))

    def keys(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of documents end to end in ``ids`` the strongest tokens among those that others have too, -1 for missing ones."""
        doc, terms, tf = distinct(ids, lengths)
        weight = self.idf[terms] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / self.mean))[doc])
        weight[self.df[terms] < 2] = 0
        starts, out = np.searchsorted(doc, np.arange(len(lengths))), np.full((len(lengths), KEY_TERMS), -1)
        for i in range(KEY_TERMS):
            best = np.maximum.reduceat(weight, starts)
            at = np.flatnonzero(weight == best[doc])
            at = at[np.append(True, np.diff(doc[at]) > 0)]  # ties: the smallest token
            out[:, i] = np.where(best > 0, terms[at], -1)
            weight[at] = -1
        return out


def distinct(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents end to end in ``ids`` (none empty) each document's distinct tokens: document, token, how often; in order."""
    bits, kind = (16, np.uint32) if ids.dtype.itemsize == 2 and len(lengths) <= 1 << 16 else (32, np.uint64)
    pair = np.repeat(np.arange(len(lengths), dtype=kind) << kind(bits), lengths) | ids
    pair.sort()
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    found = pair[first]
    return (found >> kind(bits)).astype(np.int64), (found & kind((1 << bits) - 1)).astype(np.int64), np.diff(first, append=len(pair))


def ids_of(raw: bytes, n: int) -> np.ndarray:
    """A document's ``n`` ids, which are stored in 16 or in 32 bits each."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def documents_at_once(raw: list[bytes], n: list[int]):
    """Runs of documents of about ``TOKENS_AT_ONCE`` ids: the ids end to end, and the number of each document's."""
    at = held = 0
    for i, size in enumerate(n, 1):
        held += size
        if held >= TOKENS_AT_ONCE or i == len(n):
            yield np.concatenate([ids_of(r, m) for r, m in zip(raw[at:i], n[at:i], strict=True)]), np.array(n[at:i])
            at, held = i, 0


class Bm25:
    """Inverted index of one shard: term -> documents and their BM25 weights, by the statistics of the whole table."""

    def __init__(self, docs: list[np.ndarray], known: Statistics | None = None):
        known = known or Statistics.of(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        key = np.concatenate(docs).astype(np.int64) << 32 | np.repeat(np.arange(len(docs)), lengths)
        key, tf = np.unique(key, return_counts=True)
        terms, self.docs = key >> 32, (key & 0xFFFFFFFF).astype(np.int64)
        self.terms, first, held = np.unique(terms, return_index=True, return_counts=True)
        self.slices = np.append(first, len(terms))
        norm = K1 * (1 - B + B * lengths / known.mean)
        self.weight = known.idf[terms] * tf * (K1 + 1) / (tf + norm[self.docs])
        order = np.argsort(self.docs, kind="stable")
        self.doc_terms, self.doc_at = np.repeat(np.arange(len(self.terms)), held)[order], np.searchsorted(self.docs[order], np.arange(len(docs) + 1))

    def keep(self, free: np.ndarray) -> None:
        """Leaves used documents out of the postings, which no longer find them anyway."""
        kept = free[self.docs]
        self.slices = np.append(0, np.cumsum(kept))[self.slices]
        self.docs, self.weight = self.docs[kept], self.weight[kept]

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """All unused documents that share a token, by falling score (ties: the earlier one)."""
        terms = self.doc_terms[self.doc_at[seed] : self.doc_at[seed + 1]]
        held = self.slices[terms + 1] - self.slices[terms]
        ends = np.cumsum(held)
        postings = np.repeat(self.slices[terms] - ends + held, held) + np.arange(ends[-1] if len(ends) else 0)
        score = np.bincount(self.docs[postings], self.weight[postings], len(free))
        score[~free] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def packing_order(docs: list[np.ndarray], window: int = WINDOW, known: Statistics | None = None) -> list[int]:
    """The order in which a shard's documents fill its windows."""
    index, free = Bm25(docs, known), np.ones(len(docs), dtype=bool)
    seeds = iter(np.argsort([-len(d) for d in docs], kind="stable"))
    order: list[int] = []
    filled, seed, kept = 0, None, len(docs)
    while len(order) < len(docs):
        if len(docs) - len(order) <= KEPT * kept:
            index.keep(free)
            kept = len(docs) - len(order)
        if seed is None:
            seed = next(s for s in seeds if free[s])
            free[seed] = False
            order.append(int(seed))
            filled += len(docs[seed])
        room = -filled % window
        current, seed = seed, None
        for d in index.neighbours(current, free) if room else ():
            free[d] = False
            order.append(int(d))
            filled += len(docs[d])
            room -= len(docs[d])
            if room <= 0:
                seed = int(d) if room < 0 else None  # the rest of a cut document seeds the next window
                break
    return order


def lay_out(lengths: list[int], window: int = WINDOW):
    """(document, start, length, sequence, offset) of each piece, for documents laid end to end."""
    total = sum(lengths)
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if total % window >> b & 1]
    sequence = offset = 0
    for d, n in enumerate(lengths):
        start = 0
        while start < n:
            take = min(n - start, sizes[sequence] - offset)
            yield d, start, take, sequence, offset
            start, offset = start + take, offset + take
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0


def text_slices(batch, column: int):
    """Runs of a batch's rows of about ``SLICE_BYTES`` of text, one row at least."""
    import pyarrow.compute as pc

    run = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """key, ids (little-endian, 32 bits each), their number n and a hash of key and text.

    With ``short`` ids take 16 bits where the vocabulary allows it, and each task adds a row without ids (n is 0) that holds in
    ``counts`` in how many of its documents each token is (64 bits each), so that nothing is read again to be counted.
    """
    kind, arrow = arrow_schema(f"`{key}` {dict(docs.dtypes)[key]}, ids binary, n long, h long" + ", counts binary" * short)

    def run(batches):
        import pyarrow as pa

        tokens, end = Tokens.get(path), END_ID.to_bytes(4, "little")
        width = 2 if short and tokens.model.get_vocab_size() <= 1 << 16 else 4
        counts = np.zeros(max(tokens.model.get_vocab_size(), END_ID + 1), dtype="<i8")
        for batch in batches:
            for part in text_slices(batch, 1):
                ids = [raw + end for raw in tokens.encode(part.column(1).to_pylist())]
                n = [len(i) >> 2 for i in ids]
                if short:
                    for some, lengths in documents_at_once(ids, n):
                        counts += np.bincount(distinct(some.astype(f"<u{width}"), lengths)[1], minlength=len(counts))
                    ids = [np.frombuffer(i, "<u4").astype(f"<u{width}").tobytes() for i in ids]
                columns = [part.column(0).cast(arrow[0].type), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), part.column(2)]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(ids), pa.binary())] * short, schema=arrow)
            give_back()  # else the worker keeps it, also while it has nothing to do
        if short and counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, b"", 0, 0, counts.tobytes()), arrow, strict=True)], schema=arrow)

    body = text_or_empty(text)
    rows = docs.select(F.col(key), body.alias("__text"), F.xxhash64(F.col(key).cast("string"), body).alias("__h")).mapInArrow(run, kind)
    conf = docs.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        return materialize(rows, "tokens")
    finally:
        conf.set(BATCH_SETTING, before)


def statistics(tokens: DataFrame) -> tuple[Statistics, int, int]:
    """Statistics of all documents, their number and their tokens; the driver gets one row for each token id."""
    counted = "counts" in tokens.columns

    def count(batches):
        import pyarrow as pa

        df = np.zeros(0, dtype=np.int64)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            found = [np.frombuffer(r, "<i8") for r in raw] if counted else [np.bincount(distinct(*d)[1]) for d in documents_at_once(raw, batch.column(1).to_pylist())]
            for x in found:
                df = np.append(df, np.zeros(max(0, len(x) - len(df)), dtype=np.int64))
                df[: len(x)] += x
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], names=["term", "df"])

    total = tokens.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    source = tokens.filter("n = 0").select("counts") if counted else tokens.select("ids", "n")
    rows = source.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(1 + max([END_ID, *(r.term for r in rows)]), dtype=np.int64)
    for r in rows:
        df[r.term] = r.df
    return Statistics(total.docs, total.n / max(total.docs, 1), df), total.docs, total.n


def range_cuts(tokens: DataFrame, known: Statistics, documents: int, total: int) -> list[tuple]:
    """Places (key, hash) in the order of all documents at which ranges begin, from documents sampled by their hash.

    As long as they are few, ranges are as large as shards.  The sample is bounded by ``MOST_SAMPLE``, whatever the table.
    """
    ranges = min(RANGES, -(-total // SHARD_TOKENS))
    if ranges < 2:
        return []
    share = min(1.0, min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLED * ranges)) / documents)
    fields = [f"k{i}" for i in range(KEY_TERMS)]

    def keys(rows):
        found = np.concatenate([known.keys(*d) for d in documents_at_once(rows["ids"], rows["n"])])
        return {f: found[:, i].tolist() for i, f in enumerate(fields)} | {"h": rows["h"], "n": rows["n"]}

    # Other bits of the hash than those that order documents.
    few = tokens.filter("n > 0").filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    sample = map_columns(few.select("ids", "h", "n"), keys, ", ".join(f"{f} long" for f in [*fields, "h", "n"])).collect()
    sample = sorted(tuple(r) for r in sample)
    if not sample:
        return []
    filled = np.cumsum([r[-1] for r in sample])
    at = np.searchsorted(filled, filled[-1] * np.arange(1, ranges) / ranges)
    return sorted({sample[i][:-1] for i in at})


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents; with ``keep_ids`` each piece's ids are a column too."""
    id_type = dict(docs.dtypes)[key]
    schema = f"`{key}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids array<long>" * keep_ids
    kind, arrow = arrow_schema(schema)
    tokens = tokenised(docs, path, key, text, short=True)
    known, documents, total = statistics(tokens)
    cuts = range_cuts(tokens, known, documents, total)
    most = SHARD_TOKENS * 4 // 3  # a range may be somewhat larger than a shard and still be one
    fields = [f"__k{i}" for i in range(KEY_TERMS)]
    placed_kind, placed_arrow = arrow_schema(f"`{key}` {id_type}, ids binary, __h long, __range long, __n long, {', '.join(f'{f} long' for f in fields)}")

    def place(batches):
        import pyarrow as pa

        Tokens.drop()
        for batch in (b for b in batches if b.num_rows):
            ids, hashes, n = batch.column(1), batch.column(2), batch.column(3)
            keys = np.concatenate([known.keys(*d) for d in documents_at_once(ids.to_pylist(), n.to_pylist())])
            part = [bisect_right(cuts, (*k, h)) if cuts else 0 for k, h in zip(keys.tolist(), hashes.to_pylist(), strict=True)]
            columns = [pa.array(keys[:, i]) for i in range(KEY_TERMS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, hashes, pa.array(part, pa.int64()), n, *columns], schema=placed_arrow)

    def run(batches):
        import pyarrow as pa

        Tokens.drop()
        shard, held, now, filled = [], 0, None, 0  # filled: the range's sequences so far

        def flush():
            nonlocal shard, held, filled
            shard.sort(key=lambda x: x[:2])
            docs_ = [ids_of(raw, n) for _, raw, _, n in shard]
            order = packing_order(docs_, window, known)
            rows = []
            for d, start, take, sequence, offset in lay_out([len(docs_[i]) for i in order], window):
                ids = docs_[order[d]]
                part = ids[start : start + take].astype("<u4")
                row = (shard[order[d]][2], start, take, zlib.crc32(part.tobytes()), len(ids), (now << 32) + filled + sequence, offset)
                rows.append((*row, part.tolist()) if keep_ids else row)
            filled += rows[-1][5] - (now << 32) - filled + 1
            shard, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for name, raw, h, number, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard and (number != now or held >= most):
                    yield flush()
                if number != now:
                    now, filled = number, 0
                shard.append((h, raw, name, n))
                held += n
        if shard:
            yield flush()

    placed = tokens.filter("n > 0").select(key, "ids", "h", "n").mapInArrow(place, placed_kind)
    return placed.repartition("__range").sortWithinPartitions("__range", *fields, "__h", "ids").select(*(c for c in placed.columns if c not in fields)).mapInArrow(run, kind)


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_retrieval_packing": op3_retrieval_packing}
SQL: dict[str, str] = {}
