"""Every operator and stage on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seaward.llm import bpe, licences, media, neighbours, packing, quality, secrets, simhash, toxicity, warc

P = pytest.importorskip("public_tokenizers")
LONG = "lorem ipsum dolor sit amet " * 20_000
#: Names that the operators use themselves.
CLASH = "__text __rules __key fp sig id label score shard component_id trigram path payload sha v n tab bucket shape unit component".split()


def documents(spark, empty=False):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i * j) % 10] + str(j % 7) for j in range(1, 40)), "en", "s", 1) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "s", 0), (32, LONG, "en", "s", len(LONG)), (33, rows[3][1], "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    rows += [(None, "password=abcdefgh1 x", "en", None, 20), (35, " \n\t ", "en", "s", 4), (36, "idiot scum " * 8, "en", "s", 1), (37, "### $$$ %%% " * 30, "en", "s", 1)]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASH})


def labels(spark, empty=False):
    rows = [(i, i % 4 != 0, i == 36) for i in range(40)] + [(None, True, False), (5, None, None)]
    rows = [(a, None if b is None else int(b), None if c is None else int(c)) for a, b, c in rows]
    return spark.createDataFrame([] if empty else rows, "doc_id long, quality int, toxic int")


def one(labels_df, column):
    return labels_df.select("doc_id", F.col(column).alias("label"))


def runs(spark, docs, lab):
    word, ranks = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
    return {
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, one(lab, "toxic"))),
        "passages": lambda: toxicity.passages(docs, toxicity.Model({"idiot": 3.0, "scum": 3.0})),
        "media": lambda: media.text_media(docs),
        "packing": lambda: packing.pack(docs, word),
        "bpe": lambda: bpe.encode_texts(docs, ranks, P.PATTERN),
        "quality": lambda: quality.score(docs, quality.fit(docs, one(lab, "quality"))),
        "simhash": lambda: simhash.near_duplicates(docs),
        "licences": lambda: licences.licences(licences.document_files(docs), "doc_id"),
        "secrets": lambda: secrets.scan(docs),
        "warc": lambda: warc.read_archives(warc.write_archives(docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "sha", "payload", F.lit(1).alias("first")))),
    }


ROW_FOR_ROW = ["toxicity", "media", "bpe", "quality", "simhash", "licences", "secrets", "warc"]


@pytest.mark.parametrize("name", ["toxicity", "passages", "media", "packing", "bpe", "quality", "simhash", "licences", "secrets", "warc"])
def test_odd_rows(spark, name):
    docs = documents(spark)
    got = runs(spark, docs, labels(spark))[name]().collect()
    if name in ROW_FOR_ROW:
        assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["page_id"] if name == "warc" else r["doc_id"], []).append(r)
    if name in ("toxicity", "quality"):
        assert all(0 <= r.score <= 1 for r in got) and by[3][0].score == by[3][1].score == by[33][0].score
    if name == "simhash":
        assert by[33][0].component_id == 3 and {r.fingerprint for r in (*by[30], *by[31], *by[35])} == {"0" * 16}
        assert by[35][0].component_id == 30
    if name == "media":
        assert by[30][0].payload_bytes == 64 and by[30][0].n_bytes == 0 and by[32][0].n_bytes == len(LONG)
    if name == "bpe":
        assert by[30][0].n_tokens == 0
    if name == "packing":
        assert by[30][0].length == 1 and sum(r.length for r in by[3]) == 2 * by[3][0].doc_tokens
    if name == "warc":
        assert by[33][0].record_type == "revisit" and by[33][0].refers_to == 3 and {r.record_type for r in by[3]} == {"response"}
    if name == "secrets":
        assert by[None][0].n_assign == 1 and by[None][0].spans == "assign:0:18"
    if name == "passages":
        assert by[36] and all(r.passage.startswith("idiot") for r in by[36])


@pytest.mark.parametrize("name", ["toxicity", "passages", "media", "packing", "bpe", "quality", "simhash", "licences", "secrets", "warc"])
def test_empty_tables(spark, name):
    assert runs(spark, documents(spark, True), labels(spark, True))[name]().count() == 0


def test_no_labels(spark):
    docs, none = documents(spark), labels(spark, True)
    assert {r.score < 0.5 for r in runs(spark, docs, none)["toxicity"]().collect()} == {True}
    assert len({r.score for r in runs(spark, docs, none)["quality"]().collect()}) == 1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for kind in ("odd", "empty"):
        base = str(tmp_path_factory.mktemp(kind))
        documents(spark, kind == "empty").write.parquet(f"{base}/documents.parquet")
        labels(spark, kind == "empty").write.parquet(f"{base}/labels.parquet")
        out[kind] = base
    return out


@pytest.mark.parametrize("kind", ["odd", "empty"])
@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tables, kind, stage):
    base = tables[kind]
    docs = spark.read.parquet(f"{base}/documents.parquet")
    got = corpus_pipeline.STAGES[stage][1](spark, docs, base)
    rows = got.collect()
    if stage < 4:
        assert got.columns == docs.columns
        assert all(r["__text"] == "x__text" and r["__rules"] == "x__rules" for r in rows)
    assert bool(rows) == (kind == "odd")
    if kind == "odd" and stage == 2:
        ids = [r.doc_id for r in rows]
        assert 33 not in ids and ids.count(3) == 1 and ids.count(None) == 1
    if kind == "odd" and stage == 3:
        assert [r.text for r in rows if r.doc_id is None] == ["<assign> x"] and len(rows) == docs.count()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5 + 1), 1.0]) for i in range(30)]
    rows += [(40, None), (41, [0.0, 0.0]), (42, [nan, 1.0]), (43, [inf, 1.0]), (44, [None, 1.0]), (None, [1.0, 1.0]), (45, []), (60, [1.0, 2.0, 3.0]), (0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "n", "id", "score", "tab", "bucket")})
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {0, 20} and len(by[0]) == 20
    assert [v for v, _ in by[0][:6]] == [4, 9, 14, 19, 24, 29]  # ties: the smaller id
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
