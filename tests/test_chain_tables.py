"""The chain's tables keep their clustering by document, and go when it is released."""

import os

from pyspark.sql import functions as F

from toxiscope.operators import features as fe
from toxiscope.operators import linear as li
from toxiscope.plans import baselines, scoring_queries
from toxiscope.plans.ablation_queries import ablation_predictions
from toxiscope.plans.baselines import TRAIN, Chain
from toxiscope.streaming.scoring import score_texts

SF = "/root/testdata/sf0.001"


def exchanges(df, of: str) -> int:
    """Exchanges by document of rows that carry ``of``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning(doc_id" in line for line in plan.split("\n")) if of in plan else -1


def test_no_exchange_of_postings_by_document(small_chain):
    c = small_chain
    assert exchanges(fe.tfidf_transform(c.postings, c.idf, max_features=c.n_terms()), "tf") == 0
    train = c.weights.filter(F.col("split") == TRAIN).select("doc_id", "idx", "weight")
    assert exchanges(train.groupBy("doc_id").agg(F.collect_list("idx")), "weight") <= 0
    docs = c.cleaned.select("doc_id", F.col("toxic").alias("label"))
    # the documents themselves may move to the postings, or be broadcast; never the postings
    assert exchanges(li.sparse_rows(train, docs), "weight") <= 1


def test_release_drops_tables_and_files(spark):
    c = Chain(spark, SF)
    assert c.weights.count() > 0
    names, folder = list(c._tables), c._run_dir
    assert len(names) == 2 and all(spark.catalog.tableExists(n) for n in names)
    c.release()
    assert not any(spark.catalog.tableExists(n) for n in names) and not os.path.exists(folder.removeprefix("file:"))


def test_tasks_hold_bounded_text(spark):
    """Of 42 million characters, a bucket or a scored partition holds two."""
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 350_000).alias("clean"))
    c = Chain(spark, SF, _memo={"cleaned": texts})
    assert c.buckets == 21
    idf = spark.createDataFrame([("ab", 0, 1.0)], "term string, idx int, idf double")
    model = spark.createDataFrame([("ab", 1.0, 0.0)], "term string, log_ratio double, prior double")
    plan = score_texts(texts, ["doc_id"], "clean", idf, model, terms=1)._jdf.queryExecution().executedPlan().toString()
    assert any("Exchange hashpartitioning(doc_id" in line and ", 21)" in line for line in plan.split("\n"))


def test_ablation_tables_are_bucketed(spark, monkeypatch, tmp_path):
    """By the document, as many as the cleaned texts are long; the norm takes no exchange."""
    monkeypatch.setattr(baselines, "BUCKET_CHARS", 100)
    lang = F.when(F.col("doc_id") % 4 == 0, "de").otherwise("en")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some <b>words</b> no. "), F.col("id").cast("string")).alias("text"))
    docs.select("*", lang.alias("lang"), F.lit("web").alias("source"), F.length("text").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic")).write.parquet(
        f"{tmp_path}/labels.parquet")
    c = Chain(spark, str(tmp_path))
    preds = ablation_predictions(c)
    held = c.cleaned.filter(F.col("split") != TRAIN).count()
    assert preds.count() == 3 * held == preds.select("model", "doc_id").distinct().count()
    post, n = c._memo["ablation_postings"], c._memo["ablation_buckets"]
    assert n == -(-3 * docs.agg(F.sum(F.length("text"))).first()[0] // 100) > 4
    weights = fe.tfidf_transform(post, c._memo["ablation_idf"], ["cleaner", "doc_id"], c._memo["ablation_terms"], ["cleaner"])
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {c._tables[-1]}").collect()}
    assert described["Num Buckets"] == str(n)
    c.release()


def test_sums_by_term_read_bounded_parts(spark, monkeypatch, tmp_path):
    """A task has ``SUM_BYTES`` of files or of other tasks' sums, in a partition for every ``SUM_BUCKETS`` buckets; the sums are made once."""
    monkeypatch.setattr(baselines, "BUCKET_CHARS", 50)
    monkeypatch.setattr(baselines, "SUM_BYTES", 1 << 20)
    text = F.concat(F.lit("some words of "), F.col("id").cast("string"), F.lit(" and some words"))
    spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"),
                           F.length(text).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic")).write.parquet(
        f"{tmp_path}/labels.parquet")
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    own, seen, real = [spark.conf.get(k) for k in keys], [], fe.term_stats

    def stats(postings, by=()):
        seen.append([*(spark.conf.get(k) for k in keys), postings.select("term").rdd.getNumPartitions(), len(postings.inputFiles())])
        return real(postings, by)
    monkeypatch.setattr(fe, "term_stats", stats)
    c = Chain(spark, str(tmp_path))
    found = {r.term: (r.tot, r.df) for r in c.idf.collect()}
    assert c.buckets > 4 * int(own[0])
    bound = str(1 << 20)
    (*held, scans, files), = seen
    assert held == [str(-(-c.buckets // 4)), bound, bound] and scans == files > 4
    assert [spark.conf.get(k) for k in keys] == own
    train = c.postings.filter(F.col("split") == TRAIN)
    assert found == {r.term: (r.tot, r.df) for r in real(train).collect()} == {r.term: (r.tot, r.df) for r in c.term_stats.collect()}
    c.release()


def documents_and_labels(spark, folder, labels):
    text = F.concat(F.lit("some words of "), F.col("id").cast("string"), F.lit(" and some words"))
    spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"),
                           F.length(text).alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_texts_meet_labels_in_partitions_of_bounded_text(spark, monkeypatch, tmp_path):
    """However few partitions the session shuffles into; its own number comes back."""
    monkeypatch.setattr(baselines, "JOIN_CHARS", 100)
    documents_and_labels(spark, tmp_path, [(i, 1, int(i % 3 == 0)) for i in range(0, 60, 2)])
    own, seen, real = spark.conf.get("spark.sql.shuffle.partitions"), [], baselines.split_corpus

    def split(comments):
        seen.append(spark.conf.get("spark.sql.shuffle.partitions"))
        return real(comments)
    monkeypatch.setattr(baselines, "split_corpus", split)
    c = Chain(spark, str(tmp_path))
    assert sorted(r.doc_id for r in c.splits.select("doc_id").collect()) == list(range(0, 60, 2))
    chars = c.table("documents").agg(F.sum(F.length("text"))).first()[0]
    assert seen == [str(-(-chars // 100))] and int(seen[0]) > int(own)
    assert spark.conf.get("spark.sql.shuffle.partitions") == own
    c.release()


def test_labels_that_are_not_broadcast_meet_bounded_text(spark, monkeypatch, tmp_path):
    """In the measured partitions, the same rows as with broadcast labels; keys may repeat or be null."""
    monkeypatch.setattr(baselines, "JOIN_CHARS", 100)
    documents_and_labels(spark, tmp_path, [(None, 1, 0), (2, 1, 1), (2, 1, 0), (7, 1, None), (90, 1, 1)])
    spark.sql("SELECT cast(null as long) AS doc_id, 'no key' AS text, 'en' AS lang, 'web' AS source, 6 AS n_chars").write.mode("append").parquet(
        f"{tmp_path}/documents.parquet")
    spark.sql("SELECT 2L AS conv_id, -1L AS turn, 'a turn' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    expected = sorted([("documents", i, -1) for i in [*range(60), None] if i not in (2, 7)] + [("conversations", 2, -1)], key=str)

    def found():
        df = scoring_queries._unlabelled(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = sorted([tuple(r) for r in df.select("tbl", "id", "turn").collect()], key=str)
        return rows, "BroadcastHashJoin" in plan, [line.count(f", {n})") for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    n = baselines.chain(spark, str(tmp_path)).join_partitions
    assert n > 10
    assert found() == (expected, True, [])
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(fe, "BROADCAST_ROWS", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert found() == (expected, False, [1, 1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
