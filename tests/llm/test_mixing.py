import random

import numpy as np
from pyspark.sql import functions as F

from tarnwork.llm.mixing import draw_whole, mix_to_targets, normal_source, posterior_quality, replay


def test_names(spark):
    df = spark.createDataFrame([(" Big-Source ",), ("BIG_SOURCE",), ("big source ",), (None,)], "s string")
    assert [r[0] for r in df.select(normal_source("s")).collect()] == ["big_source"] * 3 + [None]


def test_projected_steps_reach_the_wish():
    rnd = np.random.default_rng(2)
    p = rnd.dirichlet([0.1, 0.1, 0.1], 400)
    t = rnd.pareto(1.5, 400) + 1
    cap, total = np.full(400, 3.0), t.sum()
    mass = t @ p
    want = np.array([0.5, 0.3, 0.2]) * total
    history = np.zeros((0, 3))
    for _ in range(30):
        history = np.vstack([history, ((replay(history, p, cap) * t) @ p - want) / mass])
    rate = replay(history, p, cap)
    assert np.abs((rate * t) @ p - want).max() < 1e-3 * total and rate.min() >= 0 and rate.max() <= 3


def test_whole_draws_keep_the_mass(spark):
    rnd = random.Random(1)
    rows = [(i, i % 2, int(rnd.paretovariate(1.0) * 50), 2.0, 0.37 if i % 2 else 1.61) for i in range(3000)] + [(9000, 0, 0, 1.0, 0.5), (9001, None, 10, None, None)]
    got = draw_whole(spark.createDataFrame(rows, "key int, domain int, tokens int, cap double, rate double")).toPandas()
    assert len(got) == 3002
    for d in (0, 1):
        part = got[got.domain == d]
        assert abs((part.tokens * part.repeats).sum() / (part.tokens * part.rate).sum() - 1) < 0.01 and part.repeats.max() <= 2


def test_mixing(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        name = ["big", "small one", "tiny"][min(2, i % 20 // 9)]
        spelled = rnd.choice([name, name.upper(), f" {name}", name.replace(" ", "-")])
        rows.append((i, "word " * rnd.randrange(1, 60), spelled if i % 50 else None, name[0]))
    rows += [(600, None, "big", "b"), (601, "", "big", "b"), (5, rows[5][1], rows[5][2], rows[5][3]), (602, "long " * 40_000, "big", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, domain string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small-one", 0.4, 5), ("Tiny", 0.2, 2), ("none", 0.1, 4)], "source_name string, target_share double, max_repeats int")
    draws, report = mix_to_targets(docs, "doc_id", "text", "source", ["domain"], targets)
    d, r = draws.toPandas(), {x.source_name: x for x in report.collect()}
    assert len(d) == len(rows) and set(r) == {"big", "small-one", "Tiny", "none"}
    short = {n for n, x in r.items() if x.max_repeats * x.own_tokens < x.target_share * d.tokens.sum()}
    assert {n for n, x in r.items() if x.falls_short} == short and "none" in short
    assert all(x.most_repeats <= x.max_repeats for x in r.values()) and r["none"].own_tokens == 0
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    empty, zero = mix_to_targets(docs.limit(0), "doc_id", "text", "source", ["domain"], targets)
    assert empty.count() == 0 and zero.where(F.col("drawn_tokens") != 0).count() == 0 and zero.count() == 4


def test_posteriors_know_nothing_of_the_name(spark):
    rnd = random.Random(3)
    rows = [(i, f"d{i % 3}", ["a", "b", "c"][i % 3] if i % 2 else "same", "word " * rnd.randrange(1, 9)) for i in range(900)]
    rows += [(900 + i, "small", "z", "other text") for i in range(3)] + [(1000, None, "a", "word")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, trait string, text string")
    targets = spark.createDataFrame([("d0", 0.3, 1), ("d1", 0.3, 1), ("d2", 0.399, 2), ("small", 0.001, 9)], "source_name string, target_share double, max_repeats int")
    quality = posterior_quality(docs, "doc_id", "text", "source", ["trait"], targets).first()
    # half of the documents show their source, the others look all alike
    assert 0.4 < quality.log_loss < 0.75 < quality.prior_log_loss and 0.55 < quality.accuracy < 0.8
    draws, report = mix_to_targets(docs, "doc_id", "text", "source", ["trait"], targets, train_rows=300)
    r = {x.source_name: x for x in report.collect()}
    assert r["small"].fitted_share > 0.0005 and r["small"].drawn_tokens > 0 and not r["small"].falls_short
    assert posterior_quality(docs.limit(0), "doc_id", "text", "source", ["trait"], targets).first().rows == 0
    one, _ = mix_to_targets(docs, "doc_id", "text", "source", ["trait"], targets.limit(1))
    assert one.count() == len(rows)
    assert mix_to_targets(docs, "doc_id", "text", "source", ["trait"], targets.limit(0))[1].count() == 0
