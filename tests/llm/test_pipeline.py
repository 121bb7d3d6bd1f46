"""Every stage of the pipeline on its own input, beside SQL or a brute-force version of it."""

import collections
import random

import duckdb
import pytest

import corpus_pipeline
from ledgerspark.llm import catalogue, decontamination, jaccard_join, mixing, training_order

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return folder, out


def sql(folder, stage, query):
    con = duckdb.connect()
    source = f"{folder}/{stage}/*.parquet" if stage is not None else f"{SF}/documents.parquet"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{source}'")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return con.sql(query).fetchall()


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_keep_columns(steps):
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(rows[0].asDict()) == columns for rows in steps[1][:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output",
    ]


def test_quality_stage_drops_short_texts_at_least(steps):
    before, after = steps[1][:2]
    long_enough = {r["doc_id"] for r in before if len((r["text"] or "").split()) >= 50}
    assert set(ids(after)) <= long_enough and len(after) > len(long_enough) / 2


def test_jaccard_stage(steps):
    folder, rows = steps
    want = sql(folder, 0, f"SELECT doc_id FROM ({jaccard_join.ORACLE}) WHERE doc_id = component_id ORDER BY 1")
    assert ids(rows[2]) == [x for (x,) in want]


def test_decontamination_stage(steps):
    folder, rows = steps
    want = sql(folder, 1, f"SELECT doc_id FROM ({decontamination.ORACLE}) WHERE NOT contaminated ORDER BY 1")
    assert ids(rows[3]) == [x for (x,) in want]


def test_mixing_stage(steps):
    folder, rows = steps
    want = sql(folder, 2, f"SELECT doc_id, copies FROM ({mixing.ORACLE})")
    assert ids(rows[4]) == sorted(x for x, n in want for _ in range(n))


def test_output_stage(steps):
    rows = steps[1]
    encoder = training_order.Encoder(open(training_order.VOCABULARY, "rb").read())
    tokens = sum(len(encoder.encode(r["text"] or "")) // 2 + 1 for r in rows[4])
    assert sum(r["n_tokens"] for r in rows[5]) == tokens
    assert sorted(r["slot"] for r in rows[5]) == list(range(len(rows[5])))


def test_run_gives_all_rows(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == len(steps[1][-1])


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in catalogue.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """Rows of which a third have no doc_id and some share one, with benchmark and labels in a folder."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = " ".join(word() for _ in range(60))
    rows = []
    for i in range(30):
        text = " ".join(word() for _ in range(80))
        name = None if i % 3 == 0 else i // 6 if i % 3 == 1 else 100 + i
        rows.append((name, text, "clean"))
        if i in (3, 4, 5):  # the same id, or none, and to be dropped
            rows += [(name, "too short", "short"), (name, item + " " + word(), "leak")]
        if i in (6, 12):  # a named copy of a row without id
            rows.append((200 + i, text + " " + word(), "copy"))
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("shared"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = [(name, text, "en", kind, len(text)) for name, text, kind in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{folder}/documents.parquet"
    )
    return folder, rows


@pytest.mark.parametrize("stage, goes", [("quality", "short"), ("decontaminate", "leak"), ("deduplicate", "copy")])
def test_rows_that_share_an_id_are_judged_one_by_one(spark, shared_ids, stage, goes):
    folder, rows = shared_ids
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = getattr(corpus_pipeline, stage)(spark, docs, folder).collect()
    want = [(name, text) for name, text, kind in rows if kind != goes]
    if stage == "deduplicate":  # the equal short texts and the near equal leaks are one each
        want = [(name, text) for name, text, kind in rows if kind == "clean"]
        kinds = collections.Counter(r["source"] for r in got)
        assert kinds["short"] == 1 and kinds["leak"] == 1 and kinds["copy"] == 0
        got = [r for r in got if r["source"] == "clean"]
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(want)
    assert all(set(r.asDict()) == set(docs.columns) for r in got)
