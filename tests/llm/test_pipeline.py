from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaywork.llm import common
from tests.llm.conftest import prose
from tests.llm.test_text_operators import brute_base, brute_classes, brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    data = [(i, prose(i, 30 + i % 50), "en", f"s{i % 3}", 0) for i in range(300)]
    data += [(1000 + i, prose(i, 30 + i % 50), "en", "s1", 0) for i in range(0, 60, 2)]  # copies
    data += [(2000 + i, prose(500 + i, 40) + " vilething nasty", "en", "s2", 0) for i in range(80)]  # toxic
    data += [(3000, "write to a.b@c.de or call +49 30 1234567 today", "en", "s0", 0), (3001, None, None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int(2000 <= r[0] < 3000)) for r in data if r[0] % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, folder):
    docs = common.table(spark, folder, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stage(stage(spark, before, folder))
        seen[name] = (before, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    assert all(out.columns == COLUMNS for n, (_, out) in seen.items() if n != "packing")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}

    before, after = seen["toxicity"]
    assert ids(before) - ids(after) == set(range(2000, 2080))
    before, after = seen["near_dedup"]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == {i for i, c in classes.items() if i == c}
    before, after = seen["pii"]
    assert ids(before) == ids(after)
    assert all(not brute_base(r["text"] or "") for r in after.collect())
    assert after.filter("doc_id = 3000").first()["text"] == "write to [EMAIL] or call [PHONE] today"
    before, after = seen["mixing"]
    size, taken = Counter(), Counter()
    for r in before.collect():
        size[r["source"]] += len((r["text"] or "").split())
    for r in after.collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - t) <= 1 for s, t in brute_targets(size).items())
    before, after = seen["packing"]
    assert after.agg(F.sum("length")).first()[0] >= before.count()
    used = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert used <= 2048
    assert Counter(r[0] for r in after.filter("piece = 0").select("doc_id").collect()) == Counter(r[0] for r in before.select("doc_id").collect())


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_further_columns_of_any_name_pass_through(spark, folder):
    """Names that the stages use themselves, nulls in all of them, and a repeated row."""
    more = ["spans", "row", "masked", "key", "class_id", "id", "score", "predicted", "size", "taken", "row_key", "__key", "__taken", "__m", "__copy", "__words", "a"]
    docs = common.table(spark, folder, "documents").filter("doc_id < 40 or doc_id >= 2990")
    docs = docs.unionByName(docs.filter("doc_id = 3000"))
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in more])
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, folder))
        if name != "packing":
            assert docs.columns == COLUMNS + more, name
            rows = docs.collect()
            assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c}:{r['doc_id']}") for r in rows for c in more), name
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {*range(40), 3000}


def test_whole_texts_go_to_workers_in_small_batches(spark, folder, monkeypatch):
    """In every stage, and what was set before holds after it."""
    from pyspark.sql import DataFrameWriter

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, plain = spark.conf.get(key), [], DataFrameWriter.parquet

    def parquet(self, *a, **b):
        if "MapInArrow" in self._df._jdf.queryExecution().optimizedPlan().toString():
            seen.append(spark.conf.get(key))
        return plain(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    docs = common.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, folder))
    assert len(seen) >= 5 and set(seen) == {str(common.SMALL)}
    assert spark.conf.get(key) == before


def test_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.select([]).from_arrays([[batch.num_rows], [batch.nbytes]], ["n", "size"])

    long = spark.range(0, 300, 1, 1).selectExpr("repeat('x', if(id = 7, 6000000, 100000)) as text")
    got = common.stage_in_small_batches(long.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r["n"] for r in got) == 300 and max(r["n"] for r in got) > 10
    assert max(r["size"] for r in got if r["size"] < 6000000) <= common.SMALL + 200000
