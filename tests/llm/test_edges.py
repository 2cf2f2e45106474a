"""Nulls, empty texts and tables, repeated rows, ties, long texts and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loresmith.llm import chat, embeddings, licenses, packing, pieces, pitman_yor, quality, simhash, templates, webpages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("key", "n", "fp", "root", "u", "v", "_part", "bucket", "sequence_id", "offset", "kept", "d2", "mu", "_drop", "pos", "line", "doc", "component_id", "_gone", "_nth", "_dropped", "row_key", "_row_key")
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away " * 3, "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "word", "en", None, 4),
    (None, "no id here at all but some words to read on and on", "en", "b", 5),
    (1, "the quick brown fox jumps over the lazy dog and runs away " * 3, "en", "a", 1),
    (5, " \n \t\n", "de", "a", 5),
    (6, "long " * 30_000 + "é" * 5000, "fr", "b", 155_000),
    (7, "x" * 20_000, "en", "b", 20_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


OPERATORS = {
    "packing": lambda s, d: packing.pack_documents(s, d),
    "simhash": lambda s, d: simhash.near_duplicates(s, d),
    "quality": lambda s, d: quality.judge(s, d),
    "templates": lambda s, d: templates.drop_recurring(d),
    "licenses": lambda s, d: licenses.scan(s, d),
    "pieces": lambda s, d: pieces.encode(d),
    "pitman_yor": lambda s, d: pitman_yor.score(s, d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, empty, name):
    got = OPERATORS[name](spark, docs).collect()
    ids = [r["doc_id"] for r in got]
    want = [r[0] for r in ROWS]
    if name == "packing":
        ids = [r["doc_id"] for r in got if r["piece"] == 0]
    assert sorted(ids, key=str) == sorted(want, key=str)
    assert OPERATORS[name](spark, empty).collect() == []


def test_repeated_rows_get_the_same(spark, docs):
    for name in ("simhash", "quality", "templates", "licenses", "pieces", "pitman_yor"):
        same = [tuple(r) for r in OPERATORS[name](spark, docs).where("doc_id = 1").collect()]
        assert len(same) == 2 and same[0] == same[1], name


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, docs, empty, stage):
    for d in (docs, empty):
        out = stage(spark, d, "")
        rows = out.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == d.columns
            assert all(r["key"] == "clash" for r in rows)


def test_null_columns_everywhere(spark):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    for name, op in OPERATORS.items():
        assert op(spark, d).count() == 3, name
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, d, "").collect()


def test_pages(spark):
    kind = "page_id long, url string, html string, host string, path string"
    rows = [(1, None, None, "h", "p"), (2, "http://a/x", "", "h", "p"), (3, "::bad", "<p>t", "h", "p"), (None, "http://a/x", "<article>z</article>", "h", "p"), (2, "http://a/x", "", "h", "p")]
    got = webpages.extract(spark, spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert webpages.extract(spark, spark.createDataFrame([], kind)).count() == 0
    assert len(webpages.blocks_of("<div>" * 20_000 + "deep")) == 1


def test_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, marker string, body string"
    rows = [(1, 0, "user", "hi?", "m", "b"), (1, 0, "user", "hi?", "m", "b"), (1, 1, None, None, "m", "b"), (None, None, "zzz", "", "m", "b"), (2, 5, "assistant", "x" * 50_000, "m", "b")]
    got = chat.format_conversations(spark, spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 5 and all(r["role"] in chat.ROLES for r in got)
    assert chat.format_conversations(spark, spark.createDataFrame([], kind)).count() == 0


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, cid long, key int"
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0, 1, 1), (2, [2.0, 0.0], 0, 1, 1), (3, [1.0, 0.0], None, 1, 1), (4, None, 0, 1, 1), (5, [0.0, 0.0], 0, 1, 1), (6, [nan, 1.0], 0, 1, 1),
            (7, [1.0, None], 0, 1, 1), (8, [], 0, 1, 1), (9, [1.0, 0.0, 0.0], 0, 1, 1), (1, [1.0, 0.0], 0, 1, 1), (None, [1.0, 0.0], 0, 1, 1), (11, [1.0, 0.0], 1, 1, 1), (12, [float("inf"), 0.0], 0, 1, 1)]
    got = sorted((tuple(r) for r in embeddings.near_duplicates(spark, spark.createDataFrame(rows, kind)).collect()), key=str)
    linked = [r for r in got if r[1]]
    assert len(got) == len(rows) and linked == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert embeddings.near_duplicates(spark, spark.createDataFrame([], kind)).count() == 0


def test_vectors_of_one_id(spark):
    """A vec_id that stands with several vectors or labels names several vectors."""
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [0.0, 1.0], "b"), (3, [1.0, 0.0], "b"), (0, [0.01, 1.0], "b")]
    got = sorted(map(tuple, embeddings.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()))
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 1, 0, False)]


def test_lines_are_parsed_once(spark):
    """The tokens are made in one step of the plan, and lines of white space alone, whatever it is, are no lines."""
    docs = spark.createDataFrame([(1, "a\tb 1\n \t\r\x0b\x0c\n\n\u00a0\nc"), (2, None), (3, "")], "doc_id long, text string")
    lines = templates.template_lines(docs)
    assert sorted((r["doc"], r["pos"], r["n"]) for r in lines.collect()) == [(1, 0, 3), (1, 3, 1), (1, 4, 1)]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


def test_packing_workers_forget_between_tasks():
    encode = packing.WordIds(packing.vocabulary_path(packing.VOCABULARY))
    want = encode("some words here")
    encode.older, encode.known = (encode.known, encode.flat, encode.begin, encode.size), dict(encode.known)
    encode.rest()
    assert encode.older is None and encode("some words here") == want


def test_model_judges_given_roles(spark):
    """The fitted model says of every turn how likely its role is, markers hidden; the given role stays."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "why?" if t % 2 == 0 else "because of this and that " * 9) for c in range(30) for t in range(4)]
    rows[41] = (*rows[41][:2], "user", rows[41][3])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_conversations(spark, turns).collect()}
    assert all(got[c, t]["role"] == role for c, t, role, _ in rows)
    odd = {k for k, r in got.items() if r["expected"] != r["role"]}
    assert odd == {(10, 1)} and got[10, 1]["expected"] == "assistant" and got[10, 1]["p_role"] < 0.5
    untaught = chat.tag(chat.observed(turns), chat.Hmm([])).collect()
    assert {round(r["p_role"], 6) for r in untaught} == {0.333333} and all(r["p_role"] > 0.5 for k, r in got.items() if k not in odd)
