"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, cuts at exact budgets.

Each row gets a key from a hash of its id and text.  A source's rows are range-sorted by that key: its leading hexadecimal
digits name a range, about as many ranges as the square root of the source's rows, so that neither a range nor the list
of ranges grows beyond what one task sorts.  Running sums of sizes inside the ranges, and of the ranges' totals inside the
source, give each row the words before it.  A source's budget is some whole epochs and a rest; the rest ends inside one row,
which is cut there, so that a source's taken words are its budget exactly.  All of it is DataFrame functions.

Targets: sources share the words asked for by weight; none goes beyond ``most`` times its size, and what is above is shared
again by weight among the others (water-filling: the sources that stop are the first ones in the order of limit over weight).

Null texts are empty and have size 0; null sources are a source of their own; null ids are hashed as empty text.  Rows that
repeat id and text are one row with a count while they are sorted, so that copies of one row are no hot range, and take their
words one after the other.  Ties of keys can only be such rows.  Sources without words, and sources whose weight is missing,
null or not above 0, have target 0.  Texts of any length are counted whole.  Other columns are not looked at (``draw`` keeps
them).  An empty table gives no rows.  Sources are one row each in the table of targets, which one task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seaward.llm.common import free_names, materialize, read_table, text_or_empty
from seaward.operators import small

#: Words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in the order of their names, repeating.
CYCLE = (5, 2, 1)
#: Longest array that copies of one row are spread by.
SPREAD = 4096


def source_name(source: str) -> Column:
    """The source as text that is never null: ``=`` before its name, empty for null."""
    return F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def row_order(key: str, text: str, seed: int) -> Column:
    """The hash-random sort key of a row, 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(text_or_empty(text))))


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """id, name (of the source), size (words) and order of each row; written, as several steps read it."""
    rows = docs.select(
        F.col(key).alias("id"), source_name(source).alias("name"), F.size(F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))).cast("long").alias("size"), row_order(key, text, seed).alias("order")
    )
    return materialize(rows, "mix-sizes")


def cyclic_weights(sources: DataFrame, cycle=CYCLE) -> DataFrame:
    """``sources`` with weights by the order of their names (code points, null last), repeating."""
    place = F.row_number().over(Window.orderBy(F.col("name") == "", "name"))
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in cycle)), (place - 1) % len(cycle) + 1).cast("long"))


def targets(sources: DataFrame, share: float = 1.0, most: int = 3) -> DataFrame:
    """``sources`` (name, source_size, weight) with the target of each: ``share`` of all words, by weight, up to the limit."""
    total = F.floor(F.sum("source_size").over(Window.partitionBy()) * F.lit(share) + 0.5).cast("long")
    ranked = sources.withColumns({"total": total, "limit": F.col("source_size") * most, "w": F.when((F.col("weight") > 0) & (F.col("source_size") > 0), F.col("weight")).otherwise(0)})
    ratio = Window.partitionBy(F.col("w") > 0).orderBy(F.col("limit") / F.nullif(F.col("w"), F.lit(0)), "name")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumns({"left": F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)), "heavy": F.sum("w").over(Window.partitionBy(F.col("w") > 0)) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    # limit / w <= left / heavy, in whole numbers
    full = level.withColumn("full", F.col("limit").cast("decimal(20,0)") * F.col("heavy").cast("decimal(17,0)") <= F.col("w").cast("decimal(17,0)") * F.col("left").cast("decimal(20,0)"))
    every = Window.partitionBy(F.col("w") > 0)
    rest = full.withColumns({"words": F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(every), "shares": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)})
    open_ = F.try_divide((F.col("words") * F.col("w")).cast("double"), F.col("shares").cast("double"))
    target = F.when(F.col("w") == 0, 0.0).when(F.col("full"), F.col("limit").cast("double")).otherwise(open_)
    return rest.select(*sources.columns, target.alias("target"))


def plan(rows: DataFrame, weights: DataFrame | None = None, share: float = 1.0, most: int = 3) -> DataFrame:
    """The mix of ``rows`` (of ``sizes``): id, name, size, order, source_size, target, epochs, start and taken of each row.

    ``weights`` has name and weight (whole numbers); without it they are ``cyclic_weights``.  ``start`` is the number of
    words before the row in its source's order.
    """
    found = rows.groupBy("name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    weighed = cyclic_weights(found) if weights is None else found.join(weights.select("name", F.col("weight").cast("long")), "name", "left")
    aimed = targets(weighed, share, most)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    cut = aimed.withColumn("budget", budget).withColumns({"epochs": F.when(F.col("source_size") > 0, F.expr("budget DIV source_size")).otherwise(0), "rest": F.when(F.col("source_size") > 0, F.col("budget") % F.col("source_size")).otherwise(0)})
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.sqrt(F.col("n_rows").cast("double")))).cast("int"))
    held = materialize(cut.withColumn("digits", digits).select("name", "source_size", "target", "epochs", "rest", "digits"), "mix-targets")
    once = rows.groupBy("name", "order", "id", "size").agg(F.count(F.lit(1)).alias("copies"))
    placed = once.join(small(held), "name").withColumn("range", F.expr("substring(order, 1, digits)"))
    words = F.col("size") * F.col("copies")
    totals = placed.groupBy("name", "range").agg(F.sum(words).alias("in_range"))
    ranges = totals.withColumn("before", F.sum("in_range").over(Window.partitionBy("name").orderBy("range")) - F.col("in_range")).drop("in_range")
    inside = placed.withColumn("running", F.sum(words).over(Window.partitionBy("name", "range").orderBy("order", "id")) - words)
    sums = inside.join(ranges, ["name", "range"])
    chunks = sums.withColumn("hi", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) DIV {SPREAD}"))))
    each = chunks.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(SPREAD - 1), F.col("copies") - 1 - F.col("hi") * SPREAD))))
    start = F.col("before") + F.col("running") + (F.col("hi") * SPREAD + F.col("lo")) * F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return each.select("id", "name", "size", "order", "source_size", "target", "epochs", start.alias("start"), (F.col("epochs") * F.col("size") + part).alias("taken"))


def draw(docs: DataFrame, planned: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """The mixture itself: the rows of ``docs`` as often as ``planned`` takes them, in their own columns.

    Texts do not move: only the sources' epochs and the keys at which they are cut meet the rows.  A row that is cut keeps its
    first words, joined by one space.  Rows equal in id and text at a cut share what they take evenly; what does not go
    round (fewer words than there are such rows) is left out.
    """
    cuts = planned.groupBy("name").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("taken") > F.col("epochs") * F.col("size"), F.col("order"))).alias("last"))
    at = planned.join(small(cuts.select("name", F.col("last").alias("order"))), ["name", "order"]).groupBy("name").agg(F.sum(F.expr("taken - epochs * size")).alias("w"), F.count(F.lit(1)).alias("n"))
    ends = materialize(cuts.join(at, "name", "left").select("name", "epochs", "last", F.expr("w DIV n").alias("words")), "mix-cuts")
    own, order, words, times, last, epochs, piece = free_names(docs, "__name", "__order", "__words", "__times", "__last", "__epochs", "__piece")
    sent = ends.select(F.col("name").alias(own), F.col("epochs").alias(epochs), F.col("last").alias(last), F.col("words").alias(words))
    rows = docs.withColumns({own: source_name(source), order: row_order(key, text, seed)}).join(small(sent), own)
    found = F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))
    first = F.when(F.col(order) < F.col(last), F.size(found)).when(F.col(order) == F.col(last), F.col(words)).otherwise(0).cast("int")
    extra = F.when((first > 0) & (first >= F.size(found)), F.lit(-1)).otherwise(first)  # -1: the whole text once more
    many = rows.withColumn(times, F.when(F.size(found) > 0, F.concat(F.array_repeat(F.lit(-1), F.col(epochs).cast("int")), F.array(extra)))).withColumn(piece, F.explode(times)).filter(F.col(piece) != 0)
    return many.select(*(F.when(F.col(piece) == -1, F.col(text)).otherwise(F.array_join(F.slice(found, 1, F.greatest(F.col(piece), F.lit(0))), " ")).alias(c) if c == text else F.col(c) for c in docs.columns))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(sizes(read_table(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op11_mix": op11_mix}
SQL = {
    "op11_mix": f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
 md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY name),
w AS (SELECT *, CAST(list_extract([{', '.join(map(str, CYCLE))}], (row_number() OVER (ORDER BY name = '', name) - 1) % {len(CYCLE)} + 1) AS BIGINT) AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
p AS (SELECT * FROM w WHERE source_size > 0),
l AS (SELECT *, total - coalesce(sum(cap) OVER b, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS heavy FROM p
 WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(cap AS HUGEINT) * heavy <= CAST(weight AS HUGEINT) * left_ AS is_full FROM l),
r AS (SELECT *, total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0) AS words, sum(weight) FILTER (WHERE NOT is_full) OVER () AS shares FROM f),
t AS (SELECT name, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(words * weight AS DOUBLE) / CAST(shares AS DOUBLE) END AS target FROM r
 UNION ALL SELECT name, source_size, 0 FROM w WHERE source_size = 0),
x AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
  CAST(sum(size) OVER (PARTITION BY name ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM d JOIN t USING (name))
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - start)) END AS taken FROM x"""
}
