"""Toxicity by weak supervision.

1. Candidate terms (words and word beginnings, by hash) come from a bounded
   sample of labelled documents (``SAMPLE_DOCS``); terms much likelier in toxic
   ones become lexicon voters, and patterns of their counts are further voters.
   Every voter says toxic, clean or nothing.
2. A generative label model estimates, from the votes alone and without the
   labels, how each voter answers for toxic and for clean documents
   (expectation maximisation), then the correlations that remain between voters
   given the class; a voter's evidence is divided by the number of voters that
   it moves with, and the model is fitted again. It gives every sampled document
   a posterior label.
3. A sparse linear classifier (logistic loss, L1 penalty) over the terms is
   trained on the posterior labels; it scores every whole text.

Terms are 64-bit hashes of lower-cased letter runs (A-Z lowered, other letters
by their UTF-8 bytes) and of their first 4, 5 and 6 bytes.

Defined results: null and empty texts have no terms and get the classifier's
base score; without a toxic or a clean labelled document every score is the
share of toxic ones (0 without any); rows are independent of one another, so
copies get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map, forget, store
from washframe.llm.words import mix, signed, text_buffers, unsigned

SAMPLE_DOCS = 12_000     # labelled documents that learning may use
LEAST_DOCS = 4           # toxic sample documents a term must occur in
TERMS = 4_000            # candidate terms of the classifier
VOTERS = 400             # lexicon voters
PREFIXES = (4, 5, 6)
CORRELATED = 0.3
_U = np.uint64
_BODY = np.zeros(256, dtype=bool)
_BODY[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += _U(32)


def text_terms(data: np.ndarray) -> np.ndarray:
    """Sorted distinct term hashes of one text's bytes."""
    body = np.concatenate([[False], _BODY[data], [False]])
    edge = np.flatnonzero(body[1:] != body[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lower = _LOWER[np.concatenate([data, np.zeros(max(PREFIXES), np.uint8)])]
    size, h, out = ends - starts, np.zeros(len(starts), dtype=np.uint64), []
    longest, alive = int(size.max()), np.arange(len(starts))
    for i in range(longest):   # byte i of every word that has one
        h[alive] = mix(h[alive] * _U(0x9E3779B97F4A7C15) + lower[starts[alive] + i] + _U(1))
        if i + 1 in PREFIXES:
            out.append(h[alive] ^ _U(0xA5A5A5A5))
        alive = alive[size[alive] > i + 1]
    return np.unique(np.concatenate([h, *out]))


def _term_rows(batches):
    for batch in batches:
        raw, offs = text_buffers(batch.column(1))
        terms = [signed(text_terms(raw[offs[i]:offs[i + 1]])) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))],
                                         names=["doc_id", "terms"])


@dataclass
class LabelModel:
    """Answer tables of the voters per class, correlations and evidence weights."""
    table: np.ndarray          # (voters, classes, answers)
    weight: np.ndarray
    correlation: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of votes in {0 nothing, 1 toxic, 2 clean}."""
        score = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        ratio = np.log(self.table[:, 1, :]) - np.log(self.table[:, 0, :])
        for j in range(votes.shape[1]):
            score += self.weight[j] * ratio[j][votes[:, j]]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation over votes (documents, voters); then once more with
    correlated voters sharing their evidence."""
    n, m = votes.shape
    prior = min(max(prior, 0.005), 0.5)
    says = (votes == 1).sum(axis=1) - 0.5 * (votes == 2).sum(axis=1)
    q = 1 / (1 + np.exp(-np.clip(says - 0.5, -4, 4)))
    weight, corr = np.full(m, 1 / max(1.0, m / 40)), np.eye(m)
    model = None
    for phase in range(2):
        for _ in range(rounds):
            table = np.empty((m, 2, 3))
            for c, share in enumerate((1 - q, q)):
                total = share.sum()
                for a in range(3):
                    table[:, c, a] = (share @ (votes == a) + 0.5) / (total + 1.5)
            model = LabelModel(table, weight, corr, float(np.clip(q.mean(), 0.5 * prior, 2 * prior)))
            new = model.posterior(votes)
            done = float(np.abs(new - q).max()) < 1e-4
            q = new
            if done:
                break
        if phase == 0:
            # correlation of answers given the class, pooled over the classes
            x = (votes == 1).astype(np.float64) - (votes == 2)
            mean = np.stack([(share @ x) / max(share.sum(), 1e-9) for share in (1 - q, q)])
            rest = x - (1 - q)[:, None] * mean[0] - q[:, None] * mean[1]
            spread = np.sqrt((rest * rest).mean(axis=0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(spread, spread)
            weight = 1 / np.where(np.abs(corr) >= CORRELATED, np.abs(corr), 0).sum(axis=1).clip(1)
    return model, q


def fit_linear(rows: list[np.ndarray], y: np.ndarray, m: int, penalty: float = 2e-5, rounds: int = 300):
    """Sparse logistic regression on presence of terms, by accelerated proximal
    gradients; y are posterior labels in [0, 1]."""
    n = len(rows)
    at, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows) if n else np.zeros(0, int)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 4.0 * n / max(1.0, float(np.bincount(at, minlength=n).max() + 1)) / n
    vw, vb, k = w.copy(), b, 1.0
    for _ in range(rounds):
        z = np.bincount(at, weights=vw[col], minlength=n) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        nw = vw - step * n ** 0.5 * np.bincount(col, weights=g[at], minlength=m)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * n ** 0.5 * penalty, 0)
        nb = vb - step * n ** 0.5 * g.sum()
        nk = (1 + (1 + 4 * k * k) ** 0.5) / 2
        vw, vb = nw + (k - 1) / nk * (nw - w), nb + (k - 1) / nk * (nb - b)
        w, b, k = nw, nb, nk
    return w, b


@dataclass
class Model:
    terms: np.ndarray      # sorted term hashes
    weights: np.ndarray
    base: float
    label_model: LabelModel | None = None


def cast_votes(rows: list[np.ndarray], lexicon: np.ndarray, m: int) -> np.ndarray:
    """Votes of the lexicon terms (toxic or nothing) and of the patterns: no lexicon
    term at all (clean), none of either half (clean), two or more, four or more
    (toxic)."""
    has = np.zeros((len(rows), m), dtype=bool)
    for i, r in enumerate(rows):
        has[i, r] = True
    hits = has[:, lexicon]
    n = hits.sum(axis=1)
    odd = hits[:, ::2].sum(axis=1)
    patterns = np.stack([2 * (n == 0), 2 * (odd == 0), 2 * (n - odd == 0), n >= 2, n >= 4], axis=1)
    return np.concatenate([hits, patterns], axis=1).astype(np.int8)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Learn from rows of ``docs`` (only those to learn from) and their labels."""
    known = labels.where(f"{label_col} IN (0, 1) AND {id_col} IS NOT NULL").groupBy(id_col).agg(
        F.max(label_col).alias("toxic")).withColumnRenamed(id_col, "doc_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pool = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = store(pool.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE_DOCS), "toxic-sample")
    few = texts.join(F.broadcast(sample), "doc_id", "left_semi")
    rows = store(arrow_map(few, _term_rows, "doc_id long, terms array<long>").join(F.broadcast(sample), "doc_id"),
                 "toxic-terms")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        p = toxic / n if n else 0.0
        base = -np.inf if p == 0 else np.inf
        forget(sample, rows)
        return Model(np.zeros(0, np.uint64), np.zeros(0), base)
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("c")).where(f"t >= {LEAST_DOCS}")
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") - F.col("t") + 0.5) / (n - toxic + 1))
    top = counts.select("term", odds.alias("odds"), "t").orderBy(F.col("odds").desc(), F.col("t").desc(), "term")
    top = top.limit(TERMS).collect()    # a fixed number of terms
    terms = unsigned(np.array([r["term"] for r in top], dtype=np.int64))
    order = np.argsort(terms)
    terms, odds_ = terms[order], np.array([r["odds"] for r in top])[order]
    got = arrow_map(rows.select("doc_id", "toxic", "terms"), _pick_rows(terms), "doc_id long, at array<int>").toArrow()
    ids = np.array(got["doc_id"].to_pylist())
    by_id = np.argsort(ids, kind="stable")
    picked = got["at"].to_pylist()
    docs_terms = [np.array(picked[i], dtype=np.int64) for i in by_id]
    lexicon = np.argsort(-odds_, kind="stable")[:VOTERS]
    lexicon = lexicon[odds_[lexicon] > np.log(10)]
    label_model, q = fit_label_model(cast_votes(docs_terms, lexicon, len(terms)), toxic / n)
    w, b = fit_linear(docs_terms, q, len(terms))
    keep = w != 0
    forget(sample, rows)
    return Model(terms[keep], w[keep], b, label_model)


def _pick_rows(terms: np.ndarray):
    """Positions of a document's terms among the chosen ones."""
    def run(batches):
        for batch in batches:
            values, offs = unsigned(batch.column(2).values.to_numpy()), batch.column(2).offsets.to_numpy()
            out = []
            for i in range(len(batch)):
                mine = values[offs[i]:offs[i + 1]]
                at = np.searchsorted(terms, mine)
                at[at == len(terms)] = 0
                out.append(at[terms[at] == mine].astype(np.int32) if len(terms) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))],
                                             names=["doc_id", "at"])
    return run


def _score_rows(model: Model):
    def run(batches):
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            z = np.full(len(batch), model.base, dtype=np.float64)
            for i in range(len(batch)):
                if len(model.terms) and offs[i + 1] > offs[i]:
                    mine = text_terms(raw[offs[i]:offs[i + 1]])
                    at = np.searchsorted(mine, model.terms)
                    at[at == len(mine)] = 0
                    if len(mine):
                        z[i] += model.weights[mine[at] == model.terms].sum()
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-z)))],
                                                 names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _score_rows(model), "doc_id long, score double")
