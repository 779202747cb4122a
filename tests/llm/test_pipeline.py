"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import test_decontaminate
import test_line_dedup
import test_shingle_sets


def documents(spark, sf):
    """The small table, with copies, an unknown language and odd rows added."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").limit(3)
    more = spark.createDataFrame([(9001, "!! 12", None, None, 5), (9002, None, "en", "src0", None), (9003, "", "en", None, 0), (9004, "the of", None, None, 6)], docs.schema)
    return docs.unionByName(first.selectExpr("doc_id + 8000 doc_id", "text", "lang", "source", "n_chars")).unionByName(more)


def test_stages(spark, sf, tmp_path):
    docs = documents(spark, sf)
    columns, tables = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == columns and after.dtypes == docs.dtypes, name
        tables.append((docs.collect(), after.collect()))
        docs = after
    (a, b), (c, d), (e, f), (g, h), (k, m) = tables

    assert {r["doc_id"] for r in a} - {r["doc_id"] for r in b} == {9001, 9002, 9003}
    assert all(any(map(str.isalpha, r["text"])) for r in b)

    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(r["text"],) for r in c], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    clean = {doc: (text, gone) for doc, text, _, gone in test_line_dedup.slow([(r["doc_id"], r["text"]) for r in c], hashes)}
    expected = {doc: text for doc, (text, gone) in clean.items() if not gone or text.strip()}
    assert {r["doc_id"]: r["text"] for r in d} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in d if clean[r["doc_id"]][1])
    assert len(d) < len(c)

    assert sorted(r["doc_id"] for r in f) == test_shingle_sets.slow_kept([(r["doc_id"], r["text"]) for r in e])

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in h} == {r["doc_id"] for r in g if not test_decontaminate.slow(r["text"], items)[3]}
    assert len(h) < len(g)

    sizes = {}
    for r in k:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    taken = {}
    for r in m:
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"]
        assert len(test_decontaminate.WORD.findall(r["text"])) >= 0 and r["words"] <= r["size"]
    for r in m:
        assert taken[r["source"]] == int(r["target"]) and r["target"] <= 2 * sizes[r["source"]]


def test_odd_rows_and_clashing_columns(spark, sf, tmp_path):
    """NULLs everywhere, repeated rows, a very long text, and extra columns named like what operators add."""
    block = "one line\ntwo lines\nthree lines\nfour lines"
    rows = [(1, block, "en", "a", 5), (1, block, "en", "a", 5), (2, block + "\nnew words here", None, None, None), (None, "a text without id", None, None, None), (None, None, None, None, None),
            (3, "", "en", "b", 0), (4, "!?", None, "b", 2), (5, "long words " * 30_000, "en", "b", 1), (6, "another text of some words", "en", "a", 3)]
    extra = ["removed", "n_lines", "spans", "n_words", "items", "size", "taken", "component_id", "lang_pred", "score", "key", "a.b"]
    docs = spark.createDataFrame([(*r, *[f"{c}{i}" for c in extra]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
            assert all(r[c] == f"{c}{r['removed'][7:]}" for r in docs.collect() for c in extra)
        kept.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()))
    assert kept[0] == [(False, 1), (False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
    assert kept[1] == kept[0]
    assert kept[2] == kept[3] == [(False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
    assert "new words here" in [r["text"] for r in spark.read.parquet(f"{tmp_path}/1").where("doc_id = 2").collect()]


def test_run(spark, sf):
    result = corpus_pipeline.run(spark, sf)
    assert result.count() > 0
    assert {"doc_id", "text", "lang", "source", "n_chars", "epoch", "words"} <= set(result.columns)


def test_empty_table(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() == 0
