"""Ranking and threshold metrics against brute force."""

import random

from pyspark.sql import functions as F

from toxiscope.operators import evaluation as ev
from toxiscope.operators import ranges


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return round(u / (len(pos) * len(neg)) + 1e-12, 4)


def _df(spark, rows, g="a"):
    return spark.createDataFrame([(g, s, 1 / (1 + 2.718281828 ** -s), y) for s, y in rows],
                                 "grp string, score double, y_prob double, y_true int")


def test_auc_matches_brute_force_with_ties(spark):
    rnd = random.Random(7)
    for trial in range(4):
        rows = [(round(rnd.gauss(0, 1), 1), int(rnd.random() < 0.3)) for _ in range(300)]
        got = ev.auc_table(_df(spark, rows), ["grp"]).first().auc_roc
        assert abs(got - brute_auc(rows)) < 1e-4


def test_running_sums_do_not_depend_on_the_number_of_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.random(), int(rnd.random() < 0.2)) for _ in range(2000)]
    df = ev.score_counts(_df(spark, rows), ["grp"]).unionByName(ev.score_counts(_df(spark, rows[:9], "b"), ["grp"]))
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(ranges.prefix_sums(df, ["grp"], "score", ["neg"]).orderBy("grp", "score").collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    below = 0
    for s, y in sorted(rows):
        below += 1 - y
        assert next(r for r in found[0] if r.grp == "a" and r.score == s).cum_neg == below
        if below > 20:
            break


def test_row_numbers_follow_the_order(spark):
    rnd = random.Random(5)
    words = sorted({str(rnd.random()) for _ in range(500)})
    df = spark.createDataFrame([(w,) for w in rnd.sample(words, len(words))], "term string").repartition(9)
    got = {r.term: r.at for r in ranges.row_numbers(df, ["term"], "at").collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_auc_symmetry_and_single_class(spark):
    rows = [(s / 10, int(s % 3 == 0)) for s in range(50)]
    flipped = [(-s, y) for s, y in rows]
    a = ev.auc_table(_df(spark, rows), ["grp"]).first().auc_roc
    b = ev.auc_table(_df(spark, flipped), ["grp"]).first().auc_roc
    assert abs(a + b - 1) < 2e-4
    one = ev.auc_table(_df(spark, [(0.1, 0), (0.2, 0)]), ["grp"]).first()
    assert one.auc_roc is None


def test_roc_ends_at_one_and_pr_end(spark):
    rows = [(s / 7, int(s % 2)) for s in range(30)]
    roc = ev.roc_curve(_df(spark, rows), ["grp"]).collect()
    assert max(r.tpr for r in roc) == 1.0 and max(r.fpr for r in roc) == 1.0
    assert any(r.tps == 0 and r.fps == 0 for r in roc)
    pr = ev.pr_curve(_df(spark, rows), ["grp"]).collect()
    assert any(r.threshold is None and r.precision == 1.0 and r.recall == 0.0 for r in pr)


def test_average_precision_brute(spark):
    rnd = random.Random(11)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.4)) for _ in range(200)]
    got = ev.average_precision(_df(spark, rows), ["grp"]).first().average_precision
    P = sum(y for _, y in rows)
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(1 for x, y in rows if x >= s and y == 1)
        fp = sum(1 for x, y in rows if x >= s and y == 0)
        pos = sum(1 for x, y in rows if x == s and y == 1)
        ap += pos / P * tp / (tp + fp)
    assert abs(got - round(ap, 4)) < 1e-4


def test_best_threshold_lowest_wins_ties_and_no_positive(spark):
    df = spark.createDataFrame([("a", 0.12, 1), ("a", 0.01, 0), ("a", 0.5, 0)],
                               "grp string, y_prob double, y_true int")
    # F1 = 2/3 at both 0.05 and 0.10 (tp=1, fp=1): the lowest grid value wins.
    best = ev.best_threshold(df, ["grp"]).first()
    assert best.threshold == 0.05
    none = spark.createDataFrame([("a", 0.7, 0), ("a", 0.2, 0)], "grp string, y_prob double, y_true int")
    b = ev.best_threshold(none, ["grp"]).first()
    assert (b.threshold, b.f1) == (0.05, 0.0)


def test_confusion_sum_and_rates(spark):
    rows = [(s / 10 - 2, int(s % 4 == 0)) for s in range(40)]
    m = ev.classification_metrics(_df(spark, rows), ["grp"], 0.5).first()
    c = ev.confusion_counts(_df(spark, rows), ["grp"], 0.5).first()
    assert c.tp + c.fp + c.fn + c.tn == 40 == m.n
    p = c.tp / (c.tp + c.fp) if c.tp + c.fp else 0.0
    r = c.tp / (c.tp + c.fn) if c.tp + c.fn else 0.0
    assert abs(m.precision - p) < 1e-4 and abs(m.recall - r) < 1e-4


def _sk_roc_drop(rows):
    """Distinct-threshold ROC with the collinear-point rule (plain Python)."""
    scores = sorted({s for s, _ in rows}, reverse=True)
    fps = [sum(1 for x, y in rows if x >= s and y == 0) for s in scores]
    tps = [sum(1 for x, y in rows if x >= s and y == 1) for s in scores]
    keep = [0] + [i for i in range(1, len(scores) - 1)
                  if fps[i - 1] - 2 * fps[i] + fps[i + 1] != 0 or tps[i - 1] - 2 * tps[i] + tps[i + 1] != 0] \
        + [len(scores) - 1]
    return sorted((scores[i], tps[i], fps[i]) for i in keep)


def test_roc_drop_intermediate_matches_rule(spark):
    rnd = random.Random(5)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.35)) for _ in range(400)]
    got = ev.roc_curve(_df(spark, rows), ["grp"], drop_intermediate=True).collect()
    pts = sorted((r.threshold, r.tps, r.fps) for r in got if r.threshold != float("inf"))
    assert pts == _sk_roc_drop(rows)
    full = ev.roc_curve(_df(spark, rows), ["grp"]).collect()
    assert len(full) == len({s for s, _ in rows}) + 1 > len(got)
