import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import langid, secrets, simhash
from test_simhash import brute_components, brute_print


@pytest.fixture
def docs(spark, tmp_path):
    english = "the house is on the hill and the sun is over it while the {} river runs down to the sea and people walk with their dogs"
    german = "das haus ist auf dem berg und die sonne scheint nicht weil der {} fluss zum meer läuft und die leute mit hunden gehen"
    rows = []
    for i in range(60):
        words = (english if i % 2 else german).format(" ".join(f"wort{chr(97 + i % 26)}{chr(97 + (i * 7 + k) % 26)}" for k in range(30)))
        rows.append((i, words, "en" if i % 2 else "de", "s", len(words)))
    rows += [(100 + i, rows[i][1], rows[i][2], "s", rows[i][4]) for i in range(10)]
    rows += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "12345 !!", "en", None, 8), (203, english.format("token=abcdef123456"), None, "s", 0), (204, english * 800, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, docs):
    given = spark.read.parquet(f"{docs}/documents.parquet")
    rows = {r["doc_id"]: r for r in given.collect()}
    now = given
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        was = {r["doc_id"]: r for r in now.collect()}
        out = stage(spark, now, docs)
        after = out.collect()
        if name == "language":
            kept = {r["doc_id"] for r in after}
            assert kept == set(rows) - {200, 201, 202}
        elif name == "near_duplicates":
            groups = brute_components({i: brute_print(r["text"]) for i, r in was.items()})
            assert {r["doc_id"] for r in after} == set(groups.values())
        elif name == "secret_scan":
            models = secrets.train()
            assert {r["doc_id"]: r["text"] for r in after} == {i: secrets.redact(r["text"], secrets.all_spans(r["text"], models)[1]) for i, r in was.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after)
            assert "[SECRET]" in {r["doc_id"]: r["text"] for r in after}[203]
        else:
            assert {r["doc_id"] for r in after} == set(was)
            taken = {}
            for r in after:
                taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for own in taken.values():
                own.sort()
                assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist() and sum(n for _, n in own) <= 4096
        if k < 3:
            assert out.columns == given.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in given.schema]
        now = spark.createDataFrame(after, out.schema)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, docs).collect())) == sorted(map(key, after))


def test_stages_keep_extra_columns_and_nulls(spark):
    rows = [(i, "the house is on the hill and the sun is over it " * (1 + i % 3), "en", 1, [i], None) for i in range(20)] + [(None, "the river runs down to the sea", None, None, None, None), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, fp array<long>, component_id string")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = {(r["doc_id"], r["text"]) for r in out.collect()}
        assert (None, "the river runs down to the sea") in got
        assert ((3, None) in got) == (name != "language")
    assert corpus_pipeline.STAGES[3][1](spark, docs, "").count() == 22


def test_tables_between_stages_are_deleted(spark, docs):
    from quillspark.llm import store

    rows = corpus_pipeline.run(spark, docs)
    rows.collect()
    store.clear(spark)
    assert not store._written.get(spark.sparkContext.applicationId)


def test_stages_on_an_empty_table(spark, docs):
    empty = spark.read.parquet(f"{docs}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, docs)
        assert out.count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = langid.accepted(docs)
    assert kept.count() >= 0.995 * docs.count()
    assert simhash.deduplicated(kept).count() > 0.8 * docs.count()
