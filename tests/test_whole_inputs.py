"""No row is lost silently: missing languages and labels, further languages,
whole texts; written tables follow their inputs and go with their chain."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from toxiscope.operators import compare as cmp
from toxiscope.operators import embeddings as em
from toxiscope.operators import features as fe
from toxiscope.operators import sampling as sm
from toxiscope.plans.baselines import TEST, TRAIN, VAL, chain, split_corpus
from toxiscope.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_missing_language_and_label(spark):
    rows = [(i, f"text {i}", ("en", "tr", None)[i % 3], (0, 1, None)[i % 7 % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    out = {r.doc_id: r for r in split_corpus(df).collect()}
    assert set(out) == {i for i, _, _, y in rows if y is not None}
    for i, _, lang, y in rows:
        if y is not None:
            assert (out[i].split in (TRAIN, TEST)) == (lang == "en") and out[i].lang == (lang or "und")
            assert lang == "en" or out[i].split == VAL


def test_null_label_is_a_class_of_its_own(spark):
    df = spark.createDataFrame([(i, i % 2 if i < 80 else None) for i in range(100)], "doc_id long, toxic int")
    got = {(r.toxic, r.split): r["count"] for r in sm.stratified_split(df).groupBy("toxic", "split").count().collect()}
    assert got == {(0, "train"): 32, (0, "test"): 8, (1, "train"): 32, (1, "test"): 8, (None, "train"): 16, (None, "test"): 4}


def test_integer_quotas(spark):
    """Largest remainder with exact integers, also where doubles round."""
    big = 9_007_199_254_740_993
    counts = spark.createDataFrame([(0, big), (1, 3)], "label int, cnt long")
    take = {r.label: r.take for r in sm._largest_remainder(counts, "label", F.lit(big + 2)).collect()}
    assert sum(take.values()) == big + 2 and take[0] in (big - 1, big) and take[1] in (2, 3)


def test_pivot_keeps_every_language(spark):
    m = spark.createDataFrame([("m", "Val-tr", 0.5), ("m", "Val-de", 0.7), ("m", TEST, 0.9)], "model string, split string, auc_roc double")
    row = cmp.metric_pivot(m).first()
    assert (row.en, row.de, row.tr, row.es) == (0.9, 0.7, 0.5, None)


def test_encoding_covers_the_whole_text(spark):
    docs = spark.createDataFrame([(1, " ".join(["b", "a"] * 150)), (2, ""), (3, "a x")], "doc_id long, clean string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "term string, id int")
    got = {(r.doc_id, r.part): r.ids for r in fe.encode_sequences(docs, vocab).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    assert got[1, 0] + got[1, 1] + got[1, 2][:44] == [3, 2] * 150 and set(got[1, 2][44:]) == {0}
    assert got[2, 0] == [0] * 128 and got[3, 0][:3] == [2, 1, 0]


def test_unbounded_vocabulary(spark):
    stats = spark.createDataFrame([(f"t{i}", i + 1, 1) for i in range(20)], "term string, tot long, df long")
    assert fe.feature_vocabulary(stats, None).count() == 20 and fe.feature_vocabulary(stats, 5).count() == 5


def test_map_has_every_vector(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float("nan")], "t") for i in range(700)],
                               "vec_id long, embedding array<float>, label string")
    assert em.embedding_map_2d(df, "vec_id", "embedding", ["label"]).count() == 700


def test_chain_follows_its_input(spark):
    folder = tempfile.mkdtemp(prefix="toxiscope-in-")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    first = chain(spark, folder)
    n = first.splits.count()
    written = first._run_dir
    assert chain(spark, folder) is first
    labels.filter("doc_id % 2 = 0").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    second = chain(spark, folder)
    assert second is not first and second.splits.count() < n
    path = written.removeprefix("file:")
    assert not os.path.exists(path)
    second.release()
    assert not glob.glob(f"{path.rsplit('/', 1)[0]}/{os.path.basename(second.sf_dir)}*")


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
