"""File sources and sinks round trips on hand-made files."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from toxiscope.sources import files as fl
from toxiscope.sources import sinks as sk


def _tmp():
    return tempfile.mkdtemp(prefix="toxiscope-test-")


def test_comment_csv_multiline_quotes_and_missing(spark):
    d = _tmp()
    p = os.path.join(d, "train.csv")
    with open(p, "w") as f:
        f.write('id,comment_text,toxic,severe_toxic,obscene,threat,insult,identity_hate\n')
        f.write('a1,"line one\nline two, with ""quotes""",1,0,0,0,0,0\n')
        f.write('a2,null,0,0,0,0,0,0\n')
        f.write('a3,,0,0,0,0,0,0\n')
        f.write('a4,plain,0,0,1,0,0,0\n')
    rows = {r.id: r for r in fl.read_comments_csv(spark, p).collect()}
    assert rows["a1"].comment_text == 'line one\nline two, with "quotes"'
    assert rows["a2"].comment_text is None and rows["a3"].comment_text is None
    assert rows["a4"].obscene == 1 and len(rows) == 4


def test_metric_tables_ragged_and_last_wins(spark):
    d = _tmp()
    with open(os.path.join(d, "a_results.csv"), "w") as f:
        f.write("model,split,auc_roc,f1,accuracy,precision,recall,train_time_s\n")
        f.write("M,English Test (20%),0.9,0.5,0.9,0.5,0.5,2.1\nM,Val-tr,0.6,0.1,0.8,0.2,0.1,\n")
    with open(os.path.join(d, "b_results.csv"), "w") as f:
        f.write("model,split,auc_roc,f1,accuracy,precision,recall\nM,Val-tr,0.7,0.2,0.8,0.3,0.2\n")
    with open(os.path.join(d, "all_results.csv"), "w") as f:
        f.write("model,split,auc_roc\nX,Y,0.1\n")
    with open(os.path.join(d, "other_results.csv"), "w") as f:
        f.write("name,value\nq,1\n")
    got = {(r.model, r.split): r for r in fl.read_metric_tables(spark, d).collect()}
    assert set(got) == {("M", "English Test (20%)"), ("M", "Val-tr")}
    assert got[("M", "Val-tr")].auc_roc == 0.7 and got[("M", "Val-tr")].train_time_s is None
    assert got[("M", "English Test (20%)")].train_time_s == 2.1


def test_prediction_files_model_from_name(spark):
    d = _tmp()
    with open(os.path.join(d, "preds_Naive_Bayes_Multilingual_Val.csv"), "w") as f:
        f.write("y_true,y_prob,lang\n1,0.9,tr\n0,0.1,es\n")
    with open(os.path.join(d, "preds_BiLSTM_English_Test_20.csv"), "w") as f:
        f.write("y_true,y_prob\n1,0.8\n")
    got = fl.read_predictions(spark, d, "Multilingual_Val").collect()
    assert {r.model for r in got} == {"Naive Bayes"} and len(got) == 2


def test_run_summaries_skip_bad_files(spark):
    d = _tmp()
    json.dump({"model": "mBERT-full", "trainable_params": 100, "total_params": 100,
               "ms_per_sample": 17.0, "threshold": 0.05}, open(os.path.join(d, "full_results.json"), "w"))
    json.dump({"model": "mBERT-adapter-64", "trainable_params": 10, "threshold": 0.1},
              open(os.path.join(d, "adapter_results.json"), "w"))
    json.dump([{"model": "LR", "split": "x"}], open(os.path.join(d, "baseline_results.json"), "w"))
    json.dump({"threshold": 0.25, "results": []}, open(os.path.join(d, "lstm_results.json"), "w"))
    open(os.path.join(d, "broken_results.json"), "w").write("{not json")
    s = fl.read_run_summaries(spark, d)
    models = {r.model for r in s.collect()}
    assert models == {"mBERT-full", "mBERT-adapter-64", None}
    table = fl.model_size_table(s).collect()
    assert [r.model for r in table] == ["mBERT-adapter-64", "mBERT-full"]
    assert table[0].ms_per_sample == 0.0 and abs(table[1].trainable_m - 1e-4) < 1e-12


def test_word_vectors_header_and_width(spark):
    d = _tmp()
    p = os.path.join(d, "vec.txt")
    open(p, "w").write("3 2\nhello 0.1 0.2\nworld 0.3 0.4 \nbad 0.5\nfoo 1 2 3\n")
    v = {r.word: r.vec for r in fl.read_word_vectors(spark, p, 2).collect()}
    assert set(v) == {"hello", "world"} and abs(v["world"][1] - 0.4) < 1e-6
    vocab = spark.createDataFrame([("hello",), ("zzz",)], "term string")
    matched, counts = fl.vector_lookup(vocab, fl.read_word_vectors(spark, p, 2))
    c = counts.first()
    assert (c.matched, c.vocabulary) == (1, 2)


def test_sinks_round_trip(spark, small_chain):
    d = _tmp()
    sk.write_splits(small_chain.cleaned, os.path.join(d, "splits"))
    back = spark.read.parquet(os.path.join(d, "splits"))
    assert back.count() == small_chain.cleaned.count()
    assert back.filter(F.col("split") == "train").count() == \
        small_chain.cleaned.filter(F.col("split") == "train").count()
    m = small_chain.nb_metrics()
    sk.write_metrics(m, os.path.join(d, "metrics"))
    assert spark.read.option("header", True).csv(os.path.join(d, "metrics/csv")).count() == m.count()
    sk.write_predictions(small_chain.nb_predictions(), os.path.join(d, "preds"))
    pr = spark.read.parquet(os.path.join(d, "preds")).filter(F.col("model_tag") == "Naive_Bayes")
    assert pr.count() == small_chain.nb_predictions().count()
    from toxiscope.operators.models import top_features
    top = top_features(small_chain.nb_model().select("term", F.col("log_ratio").alias("coef")), 5)
    sk.write_feature_importance(top, os.path.join(d, "fi"))
    obj = spark.read.json(os.path.join(d, "fi")).first()
    assert len(obj.most_toxic) == 5 and len(obj.least_toxic) == 5
    assert obj.most_toxic[0].weight >= obj.most_toxic[-1].weight
