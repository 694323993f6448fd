"""Held-out quality of the fitted operators, on the larger table."""

from larkspur.llm import queries as Q

SF = "/root/testdata/sf0.1"


def auc(pairs):
    ranked = sorted(pairs)
    good = [i for i, (_, y) in enumerate(ranked) if y]
    n, m = len(good), len(ranked) - len(good)
    return (sum(good) - n * (n - 1) / 2) / (n * m)


def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_op6_held_out(spark):
    known = labels(spark)
    found = [r for r in Q.op6_toxicity(spark, SF).collect() if r.held_out and r.doc_id in known]
    assert auc([(r.score, known[r.doc_id].toxic) for r in found]) > 0.97
    assert sum(r.predicted == known[r.doc_id].toxic for r in found) > 0.95 * len(found)


def test_op4_held_out(spark):
    known = labels(spark)
    found = [r for r in Q.op4_quality(spark, SF).collect() if r.held_out and r.doc_id in known]
    assert auc([(r.tail_probability, known[r.doc_id].quality) for r in found]) > 0.9


def test_op10_keeps_good_texts(spark):
    known = labels(spark)
    found = {r.doc_id: r for r in Q.op10_quality_rules(spark, SF).collect()}
    good = [found[k] for k, r in known.items() if r.quality and not found[k].base_failed]
    poor = [found[k] for k, r in known.items() if not r.quality]
    assert sum(r.kept for r in good) > 0.97 * len(good)
    assert sum(r.kept for r in poor) < 0.3 * len(poor)
