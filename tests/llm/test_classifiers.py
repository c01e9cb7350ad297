import random
import zlib

import numpy as np
import pytest

from rulespark.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, label int"
LABELS = "doc_id long, quality int, toxic int"


def make(spark, n=400):
    r = random.Random(2)
    calm = ["word%d" % i for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(calm) for _ in range(r.randrange(20, 80))]
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.6)
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["idiot", "grumbax", "grumbit", "zorple"])
        text = " ".join(w)
        docs.append((i, text if good else text.upper().replace(" ", "!! "), 0.0, 1))
        labels.append((i, good, toxic))
    docs += [(n, None, 0.0, 1), (n + 1, "", 0.0, 1), (None, "plain words", 0.0, 1), (n + 2, "word1 " * 20_000, 0.0, 1), (3, docs[3][1], 0.0, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {d: (q, t) for d, q, t in labels}


@pytest.mark.parametrize("module,at,threshold", [(quality, 0, 0.3), (toxicity, 1, 0.5)])
def test_held_out_accuracy(spark, module, at, threshold):
    docs, labels, truth = make(spark)
    model = module.fit(docs, labels)
    got = toxicity.judged(module.score(docs, model), threshold).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id][at] for r in held]) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_empty_inputs(spark, module):
    docs, labels, _ = make(spark, 20)
    model = module.fit(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())
    assert module.score(docs.limit(0), model).collect() == []


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = make(spark, 100)
    from pyspark.sql import functions as F
    from rulespark.llm.labelled import fold, training_ids

    flipped = labels.withColumn("toxic", F.when(fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    ids = lambda x: sorted(map(tuple, training_ids(x, "toxic", 1000).collect()))
    assert ids(labels) == ids(flipped)
    assert len(training_ids(labels, "toxic", 5).collect()) == 10


def test_equal_texts_score_alike_in_any_company(spark):
    docs, labels, _ = make(spark, 200)
    for module in (quality, toxicity):
        model = module.fit(docs, labels)
        alone = {r["row"].doc_id: r.score for r in module.score(docs.coalesce(1), model).collect()}
        apart = {r["row"].doc_id: r.score for r in module.score(docs.repartition(7).orderBy("text"), model).collect()}
        assert alone == apart


def test_repeated_ids_give_one_model(spark):
    docs, labels, _ = make(spark, 200)
    twice = docs.union(docs.selectExpr("doc_id", "concat('zz ', text) AS text", "score", "label"))
    for module in (quality, toxicity):
        a, b = module.fit(docs, labels), module.fit(twice, labels)
        assert [r.score for r in module.score(docs.coalesce(1), a).collect()] == [r.score for r in module.score(docs.coalesce(1), b).collect()]


def test_votes_equal_plain_cosines(spark):
    docs, labels, _ = make(spark, 150)
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model).collect():
        buf, offs = quality.T.packed(quality.pa.array([r["row"].text or ""], quality.pa.string()))
        z = (quality.term_counts(buf, offs)[0] * model.weights).astype(float) @ model.axes
        z = z / max((z * z).sum() ** 0.5, 1e-9)
        like = [round(sum(a * b for a, b in zip(z, v)), 9) for v in model.vectors]
        near = sorted(range(len(like)), key=lambda i: (-like[i], i))[: quality.NEIGHBOURS]
        weight = [max(like[i], 0) ** 4 + 1e-9 for i in near]
        assert abs(r.score - sum(w * model.labels[i] for w, i in zip(weight, near)) / sum(weight)) < 1e-6


def test_scores_equal_plain_votes(spark):
    import math
    import re

    docs, labels, _ = make(spark, 150)
    model = toxicity.fit(docs, labels)
    known = dict(zip(model.terms.tolist(), model.voters.tolist()))
    lexical = len(model.weights) - len(toxicity.HITS) - len(toxicity.SHARES) - 3
    for r in toxicity.score(docs, model).collect():
        words = [w.lower().encode() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r["row"].text or "")]
        fired, hits = set(), 0
        for w in words:
            own = set()
            for n in toxicity.BEGINNINGS:
                if n and len(w) < n + 1:
                    continue
                data = np.frombuffer(w[:n] if n else w, np.uint8)
                h = toxicity.T.mix(toxicity.T.word_hashes(data, np.array([0]), np.array([len(data)])) + toxicity.T.U64(n))
                own |= {known[x] for x in h.tolist() if x in known}
            fired |= own
            hits += bool(own)
        share = hits / max(1, len(words))
        dense = [*[hits >= n for n in toxicity.HITS], *[share >= s and hits > 0 for s in toxicity.SHARES], math.log1p(hits), min(1, 20 * share)]
        logit = model.weights[-1] + sum(model.weights[v] for v in fired) + sum(model.weights[lexical + i] * x for i, x in enumerate(dense))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, logit))))) < 1e-9


def test_label_model_finds_copied_voters():
    r = np.random.default_rng(0)
    y = r.random(2000) < 0.3
    fire = lambda p1, p0: np.where(y, r.random(2000) < p1, r.random(2000) < p0)
    copied = fire(0.7, 0.1)
    votes = np.column_stack([fire(0.8, 0.05), fire(0.7, 0.05), fire(0.75, 0.1), copied, copied, copied]).astype(float)
    posterior, rates, weights = toxicity.label_model(votes, 0.3)
    assert ((posterior > 0.5) == y).mean() > 0.9
    assert weights[3:].max() < 0.6 < weights[:3].min() and (rates[1] > rates[0]).all()
