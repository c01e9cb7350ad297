"""Toxicity by weak supervision.

Voters are lexicons and patterns: fixed word lists, words and word beginnings mined from the sample
of labelled rows, and patterns on the number and the share of hits. A generative label model estimates by EM how
often each voter fires in either class, and from the residuals which voters fire together; the vote
of a voter is divided by how much of it others repeat. Its posteriors, not the labels, train the
linear classifier that scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .labelled import fold, training_texts

#: Words of insult and contempt by language.
LEXICONS = {
    "en": "idiot moron stupid loser scum trash pathetic worthless clown disgusting dumb jerk imbecile vermin filthy",
    "de": "idiot dummkopf abschaum arschloch trottel schwachkopf widerlich wertlos versager dreckig",
    "fr": "idiot imbécile stupide connard salaud ordure crétin minable pathétique dégoûtant",
    "es": "idiota imbécil estúpido basura asqueroso escoria patético inútil payaso cretino",
}
#: Labelled rows of each class in the sample, at most.
SAMPLE_PER_CLASS = 3000
#: Mined voters of each kind, at most.
MINED = 96
#: Sampled texts that a mined term must stand in.
SUPPORT = 6
#: Word beginnings looked at, in bytes; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6)


def _term_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Per kind (word index, hash); the text of each word; words per text."""
    buf = T.lowered(buf)
    starts, ends, first = T.word_bounds(buf, offs, T.ALNUM)
    sums = T.prefix(buf)
    kinds = []
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= n + 1) if n else np.arange(len(starts))
        kinds.append((long, T.mix(T.spans_hash(sums, starts[long], starts[long] + n if n else ends) + T.U64(n))))
    counts = first[1:] - first[:-1]
    return kinds, np.repeat(np.arange(len(counts)), counts), counts


def _mine(batches):
    """(term, kind, label, did) for each distinct term of each sampled text."""
    for part in T.slices(batches):
        kinds, doc_of, _ = _term_hashes(*T.packed(part.column(1)))
        labels = part.column(2).to_numpy(zero_copy_only=False)
        for kind, (words, h) in enumerate(kinds):
            docs = doc_of[words]
            _, one = np.unique(h ^ T.mix(docs.astype(T.U64)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(h[one])), pa.array(np.full(len(one), kind, np.int32)), pa.array(labels[docs[one]].astype(np.int32))], names=["term", "kind", "label"])


@dataclass
class Hits:
    """What a slice's texts contain of the voters' terms."""

    doc: np.ndarray
    voter: np.ndarray
    total: np.ndarray
    words: np.ndarray


def _hits(buf: np.ndarray, offs: np.ndarray, terms: np.ndarray, voters: np.ndarray) -> Hits:
    kinds, doc_of, words = _term_hashes(buf, offs)
    docs, found, total = [], [], np.zeros(len(words))
    hit_words = []
    for at, h in kinds:
        i = np.searchsorted(terms, h)
        i[i == len(terms)] = 0
        ok = terms[i] == h if len(terms) else np.zeros(len(h), bool)
        docs.append(doc_of[at[ok]])
        found.append(voters[i[ok]])
        hit_words.append(at[ok])
    doc, voter = np.concatenate(docs), np.concatenate(found)
    total += np.bincount(doc_of[np.unique(np.concatenate(hit_words))], minlength=len(words))
    pair = np.unique(doc * (int(voters.max(initial=0)) + 1) + voter)
    width = int(voters.max(initial=0)) + 1
    return Hits(pair // width, pair % width, total, words)


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, rates [2, voters], weights) of a generative model of binary voters.

    ``votes`` is rows x voters; a voter fires (1) or abstains (0). The weight of a voter is
    1 / (1 + sum of its positive residual correlations with the others), so voters that copy each
    other share one vote.
    """
    rows, n = votes.shape
    fired = votes.mean(axis=0)
    centred = votes - fired
    spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
    copies = (centred.T @ centred) / rows / np.outer(spread, spread) > 0.8
    np.fill_diagonal(copies, False)
    weights = 1 / (1.0 + copies.sum(axis=1))
    total = votes @ weights
    posterior = np.clip(prior * total / max(1e-9, total.mean()), 0.01, 0.99)
    rates = np.zeros((2, n))
    for step in range(rounds):
        for c, p in enumerate((1 - posterior, posterior)):
            rates[c] = (p @ votes + 2 * fired) / (p.sum() + 2)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        if step % 5 == 4:
            rest = votes - np.outer(posterior, rates[1]) - np.outer(1 - posterior, rates[0])
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            together = (rest.T @ rest) / rows / np.outer(spread, spread)
            np.fill_diagonal(together, 0)
            weights = 1 / (1 + np.where(together > 0.05, together, 0).sum(axis=1))
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        logit = np.log(prior / (1 - prior)) + votes @ (weights * (on - off)) + (weights * off).sum()
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, rates, weights


#: How much stronger pattern features are held to zero than others: they say coarsely what the count and the share say finely.
PATTERN_RIDGE = 30.0


def logistic(x: np.ndarray, target: np.ndarray, ridge: float | np.ndarray = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, the intercept last (Newton steps); ``ridge`` for all columns or each."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.broadcast_to(np.asarray(ridge, float), x.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: np.ndarray
    voters: np.ndarray
    weights: np.ndarray  # per voter, per pattern, then log1p(hits), share of hits, intercept

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        hits = _hits(buf, offs, self.terms, self.voters)
        dense, w = features(hits.total, hits.words), self.weights
        lexical = len(w) - dense.shape[1] - 1
        # summed column by column, so a text's score does not depend on what else is in the slice
        logit = np.full(len(hits.words), w[-1])
        for i in range(dense.shape[1]):
            logit += w[lexical + i] * dense[:, i]
        logit += np.bincount(hits.doc, weights=w[hits.voter], minlength=len(logit))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


#: Pattern voters: at least so many hits, and at least this share of the words. More of either copy these and blur the posteriors.
HITS, SHARES = (2,), (0.0125,)


def patterns(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """texts x patterns: which of them fire."""
    share = total / np.maximum(1, words)
    return np.column_stack([*[total >= n for n in HITS], *[(share >= s) & (total > 0) for s in SHARES]]).astype(float)


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """texts x (patterns, log1p(hits), share of hits)."""
    return np.column_stack([patterns(total, words), np.log1p(total), np.minimum(1, 20 * total / np.maximum(1, words))])


def _fixed_terms() -> list[int]:
    out = []
    for words in LEXICONS.values():
        data = words.encode()
        buf = T.lowered(np.frombuffer(data, np.uint8))
        s, e, _ = T.word_bounds(buf, np.array([0, len(buf)]), T.ALNUM)
        out.append(T.mix(T.word_hashes(buf, s, e) + T.U64(0)))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The classifier, from at most 2 * ``per_class`` labelled rows outside the held-out fold.

    Without rows of both classes only the fixed lexicons count.
    """
    sample = training_texts(docs, labels, "toxic", per_class, id_col, text_col).persist()
    try:
        sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        groups = _fixed_terms()
        pairs = {int(t): v for v, terms in enumerate(groups) for t in terms}
        if len(sizes) == 2:
            share = {c: F.count_if(F.col("label") == c) + 0.5 for c in (0, 1)}
            lift = F.log(share[1] / (sizes[1] + 1)) - F.log(share[0] / (sizes[0] + 1))
            counted = sample.mapInArrow(_mine, "term long, kind int, label int").groupBy("kind", "term").agg(lift.alias("lift"), F.count_if(F.col("label") == 1).alias("seen")).filter(f"seen >= {SUPPORT} and lift > 2.5")
            counted = counted.withColumn("gain", F.col("lift") * F.sqrt("seen"))
            best = Window.partitionBy("kind").orderBy(F.desc("gain"), "term")
            mined = counted.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= MINED).select("kind", "n", "term")
            # at most MINED of each kind
            for r in sorted(mined.collect()):
                pairs.setdefault(r.term & 0xFFFFFFFFFFFFFFFF, len(set(pairs.values())))
        terms = np.array(sorted(pairs), dtype=T.U64)
        voters = np.array([pairs[t] for t in sorted(pairs)], dtype=np.int64)
        width = int(voters.max()) + 1
        model = Model(terms, voters, np.concatenate([np.ones(width), np.zeros(len(HITS) + len(SHARES)), [1.0, 1.0, -3.0]]))
        if len(sizes) < 2:
            return model

        def rows(batches):
            for part in T.slices(batches):
                hits = _hits(*T.packed(part.column(1)), terms, voters)
                bounds = np.searchsorted(hits.doc, np.arange(part.num_rows + 1))
                found = [hits.voter[a:b].astype(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(2), T.lists(found, pa.int64()), pa.array(hits.total), pa.array(hits.words.astype(np.int64))], names=["label", "voters", "total", "words"])

        got = sorted(sample.mapInArrow(rows, "label int, voters array<long>, total double, words long").collect())
    finally:
        sample.unpersist()
    total, words = np.array([r.total for r in got]), np.array([r.words for r in got])
    votes = np.zeros((len(got), width))
    for i, r in enumerate(got):
        votes[i, r.voters] = 1
    prior = sizes[1] / (sizes[0] + sizes[1])
    posterior, _, _ = label_model(np.hstack([votes, patterns(total, words)]), prior)
    few = len(HITS) + len(SHARES)
    model.weights = logistic(np.column_stack([votes, features(total, words)]), posterior, np.concatenate([np.ones(width), np.full(few, PATTERN_RIDGE), np.ones(2)]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, score) for every row; ``row`` is the whole input row.

    The score depends on the text alone: null or empty text scores as one without hits. Long texts
    are read whole. Repeated rows get equal scores; an empty table gives no rows.
    """

    def run(batches):
        for part in T.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(*T.packed(part.column(1))))], names=["row", "score"])

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, score double")


def judged(scored: DataFrame, threshold: float, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of scored rows; a null id is not held out."""
    return scored.select(F.col(f"row.`{id_col}`").alias(id_col), F.col("score")).select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
