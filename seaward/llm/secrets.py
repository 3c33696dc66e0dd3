"""Secret scans: a trigram inverted index picks the candidates of each rule, regular expressions verify them.

From each rule's expression a Boolean trigram query is derived (``trigrams``).  The index has a posting (trigram, row id)
for each text that holds a trigram some rule asks for.  Intersecting postings is one grouped aggregate: the bits of an
alternative's trigrams are or-ed for each id and must all be set.  Candidates are then verified by the rule's expression
on the whole text; a rule without mandatory trigrams runs on every text.  The candidates (an id and the bits of its rules) are
written, and go to the texts by broadcast while there are at most ``FEW`` of them, so that no text moves.  Beyond that, texts
without any posting stay where they are and the others meet their bits in a shuffle.  All of it is DataFrame functions, no
Python runs on the executors.

Null texts are empty and have no spans.  Rows with equal ids are scanned one by one: candidates of one only cause a
needless check of the other.  Null ids are matched like any other.  Texts of any length are searched whole.  Spans that start
together are in the order of the rules.  Other columns are kept as they are, whatever their names (``redact``), or not looked
at.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import free_names, materialize, read_table, text_or_empty
from seaward.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; one is kept if the length of ``group`` is at least ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: The base kinds, in the order that breaks ties; a run is written with its least length, which finds the same spans.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


#: Candidates that are sent to all tasks: some 100 bytes each.
FEW = 500_000


def _asked_trigrams(rules) -> list[str]:
    return sorted({t for r in rules for q in trigram_query(r.pattern) or [] for t in q})


def postings(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index, for the trigrams that the rules ask for: (trigram, key)."""
    wanted = _asked_trigrams(rules)
    rows = docs.select(F.col(key), F.lower(text_or_empty(text)).alias("__low"))
    held = F.array_compact(F.array(*(F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in wanted)))
    return rows.select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """key and the bits of the rules whose query the postings satisfy."""
    spark = index.sparkSession
    asked = [
        (t, n * 1000 + m, 1 << i, (1 << len(q)) - 1, 1 << n)
        for n, r in enumerate(rules)
        for m, q in enumerate(trigram_query(r.pattern) or [])
        for i, t in enumerate(sorted(q))
    ]
    clauses = F.broadcast(spark.createDataFrame(asked, "trigram string, clause int, bit long, full long, rule long"))  # as long as the rules
    hits = index.join(clauses, "trigram").groupBy(key, "clause").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full"), F.first("rule").alias("rule"))
    return hits.filter("bits = full").groupBy(key).agg(F.bit_or("rule").alias("__rules"))


def _flagged(docs: DataFrame, rules, key: str, text: str, name: str = "__rules") -> DataFrame:
    """``docs`` with a column ``name``: the bits of the rules to verify on each row."""
    always = sum(1 << n for n, r in enumerate(rules) if trigram_query(r.pattern) is None)
    (other,) = free_names(docs, "__key")
    index = candidates(postings(docs, rules, key, text), rules, key).select(F.col(key).alias(other), F.col("__rules").alias(name))
    found = materialize(index, "secret-candidates")
    with_bits = lambda rows, side: rows.join(side, rows[key].eqNullSafe(side[other]), "left").drop(other).withColumn(name, F.coalesce(F.col(name), F.lit(0)).bitwiseOR(F.lit(always)))
    if found.limit(FEW + 1).count() <= FEW:
        return with_bits(docs, F.broadcast(found))
    low = F.lower(text_or_empty(text))
    posted = F.lit(False)
    for t in _asked_trigrams(rules):
        posted = posted | F.contains(low, F.lit(t))
    return with_bits(docs.filter(posted), found.hint("shuffle_hash")).unionByName(docs.filter(~posted).withColumn(name, F.lit(always).cast("long")))


def _asked(n: int, rule: Rule, text: Column, name: str = "__rules") -> Column:
    return (F.col(name).bitwiseAND(F.lit(1 << n)) != 0) & text.rlike(rule.java)


def _kept(rule: Rule, text: Column) -> Column:
    """(code points before the match since the last one, its length, whether it counts) of each match in order."""
    whole, group = (F.regexp_extract_all(text, F.lit(rule.java), F.lit(g)) for g in (0, rule.group))
    return F.arrays_zip(F.split(text, rule.java, -1).alias("gap"), whole.alias("whole"), group.alias("group"))


def rule_spans(n: int, rule: Rule, text: Column) -> Column:
    """Array of (start, number of the rule, end), in code points, for the rows that ask for the rule."""
    kind = "array<struct<start:int,kind:int,end:int>>"
    empty = F.array().cast(kind)

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        good = x["whole"].isNotNull() & (F.length(x["group"]) >= F.lit(rule.least))
        one = F.array(F.struct(start.alias("start"), F.lit(n).alias("kind"), end.alias("end"))).cast(kind)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(_asked(n, rule, text), F.aggregate(_kept(rule, text), first, step, lambda acc: acc["out"])).otherwise(empty)


def _joined(spans: Column, rules) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, more=MORE) -> DataFrame:
    """key, the number of kept matches of each base kind, the digest of the base spans, and all spans."""
    rules = (*base, *more)
    rows = _flagged(docs.select(F.col(key), text_or_empty(text).alias("__text")), rules, key, "__text")
    found = rows.select(key, *(rule_spans(n, r, F.col("__text")).alias(f"__{n}") for n, r in enumerate(rules)))
    own = [F.col(f"__{n}") for n in range(len(rules))]
    return found.select(
        key,
        *(F.size(own[n]).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(base)),
        F.sha2(_joined(F.concat(*own[: len(base)]), rules), 256).alias("base_sha256"),
        _joined(F.concat(*own), rules).alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with each secret replaced by its kind in angle brackets; other rows and columns unchanged."""
    own, flags = free_names(docs, "__text", "__rules")
    value = F.col(own)
    rows = _flagged(docs.withColumn(own, text_or_empty(text)), rules, key, own, flags)
    for n, r in enumerate(rules):

        def part(x):
            put = F.when(F.length(x["group"]) >= F.lit(r.least), F.lit(f"<{r.kind}>")).otherwise(F.coalesce(x["whole"], F.lit("")))
            return F.concat(x["gap"], put)

        rows = rows.withColumn(own, F.when(_asked(n, r, value, flags), F.array_join(F.transform(_kept(r, value), part), "")).otherwise(value))
    same = value == text_or_empty(text)
    changed = {text: F.when(same, F.col(text)).otherwise(value)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(value).cast("long"))
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def op9_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    def spans(n: int, r: Rule) -> str:
        pattern = r.java.replace("'", "''")
        return f"""
 SELECT doc_id, {n} AS k, '{r.kind}' AS kind, s AS start, s + length(ms[i]) AS stop FROM (
  SELECT doc_id, ms, gs, i, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {r.group}) AS gs FROM d WHERE regexp_matches(t, '{pattern}')) a,
   LATERAL (SELECT unnest(generate_series(1, len(ms))) AS i) b)
 WHERE length(gs[i]) >= {r.least}"""

    joined = "string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start, k)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(spans(n, r) for n, r in enumerate(RULES))}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE k = {n}) AS n_{r.kind}" for n, r in enumerate(BASE))},
 {joined} FILTER (WHERE k < {len(BASE)}) AS b, {joined} AS a FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
 sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op9_secret_trigrams": op9_secret_trigrams}
SQL = {"op9_secret_trigrams": _sql()}
