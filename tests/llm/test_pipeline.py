"""The pipeline against plain Python versions of its stages, and the registered queries of this subpackage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import oracles, queries, store
from tests.llm import brute
from tests.llm.test_operators import edited, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    item = prose(900, 20)
    said = [prose(i, 70) for i in range(20)]
    said += [edited(said[3], 1, 1), said[5], f"{prose(50, 60)} {item} {prose(51, 60)}", prose(52, 70) + " token=abcdefgh12 " + prose(53, 9), "too short", "a b c " * 60, None]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(said)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("found", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), said, item


def test_stages_take_effect(spark, tables):
    folder, said, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for no, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = store.cut(stage(spark, docs, folder), f"test-{no}")
        if no < 4:
            assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    good, one, clean, safe, ids = seen
    assert set(good) == {i for i, t in enumerate(said) if not brute.quality_base(t)[-1]}
    groups = brute.components([(i, said[i]) for i in good])
    assert set(one) == {i for i, (_, c) in groups.items() if c == i} and 20 not in one and 21 not in one
    assert clean[22].text == said[22].replace(item, "") and clean[22].n_chars == len(clean[22].text)
    assert safe[23].text == said[23].replace("token=abcdefgh12", "[secret]") and safe[23].n_chars == len(safe[23].text)
    for i in safe:
        assert i in (22, 23) or (safe[i].text, safe[i].n_chars) == (said[i], len(said[i]))
    assert set(ids) == set(safe) and all(r.same and r.n_ids == len(r.ids) for r in ids.values())
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()} == {i: r.ids for i, r in ids.items()}


CLASHING = ("found", "blob", "l_spans", "l_doc", "component_id", "kept", "n_words", "base_failed", "path", "gone", "row", "id", "before", "ids", "decoded", "h_path", "t_lang")


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark, tmp_path):
    """In every stage: the columns of the input, each row its own text, and nothing lost but what the stage is for."""
    item, long = prose(900, 20), prose(1, 12_000)
    rows = [(0, prose(2, 80), "en", "a"), (0, prose(3, 80) + " token=abcdefgh12", "en", "a"), (1, prose(2, 80), None, "a"), (None, prose(4, 80), "en", None), (None, f"{prose(5, 60)} {item}", "en", "a")]
    rows += [(2, prose(6, 80), "en", "a"), (2, prose(6, 80), "en", "a"), (3, long, "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "token=abcdefgh12", "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASHING})
    spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, seen = docs.columns, []
    for no, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = store.cut(stage(spark, docs, str(tmp_path)), f"edge-{no}")
        assert no == 4 or (docs.columns == columns and docs.where(" or ".join(f"{c} <> 'x'" for c in CLASHING)).isEmpty())
        seen.append(sorted(([r.doc_id, r.text] for r in docs.select("doc_id", *(["text"] if no < 4 else [F.col("same").alias("text")])).collect()), key=str))
    good = [[d, t] for d, t, *_ in rows if t and len(t) > 100]
    assert seen[0] == sorted(good, key=str)
    one = [r for r in good if r[0] != 1]
    assert seen[1] == sorted(one, key=str)
    clean = [[d, t.replace(item, "")] for d, t in one]
    assert seen[2] == sorted(clean, key=str)
    assert seen[3] == sorted(([d, t.replace("token=abcdefgh12", "[secret]")] for d, t in clean), key=str)
    assert seen[4] == sorted(([d, True] for d, _ in clean), key=str)


def test_empty_tables(spark, tmp_path):
    for folder, benchmark in ((f"{tmp_path}/a", []), (f"{tmp_path}/b", [(1, prose(1, 20))])):
        spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() == 0


def test_tables_of_a_stage_are_dropped(spark, tables):
    before = list(store._kept)
    corpus_pipeline.run(spark, tables[0]).count()
    assert [t.path.split("/")[-1].rsplit("-", 1)[0] for t in store._kept[len(before) :]] == [f"pipeline-{no}" for no in range(4)]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(oracles.oracle_sql()) <= set(queries.queries())
    assert len(corpus_pipeline.STAGES) == 5
