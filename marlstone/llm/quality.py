"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic model on selected words, word beginnings and shape figures gives each document a probability for each
target. Hosts, and paths within hosts, pool these probabilities by grouped aggregation: a path's rate is shrunk
towards its host's, the host's towards the global one, by prior strengths that are fitted to the spread between
sites (so sparse sites stay near the prior). The log odds that a document's site adds, without the document's own
share, are added to its evidence.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import map_columns, only, salted_join, written

#: The classifier is fitted on at most so many labelled documents of at most so many characters, with so many selected features a target.
TRAIN_ROWS, TRAIN_CHARS, SELECTED = 6_000, 50_000, 300
LEAST_DOCS, LEAST_Z, STEPS, RIDGE = 5, 5.0, 40, 0.3
#: Documents at least this likely to be toxic are not kept.
TOXIC_AT = 0.2
PREFIXES = (3, 4, 5, 6, 7)
TARGETS = ("quality", "toxic")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = "*%$&#!|@<>{}[]=~^_/\\"
REMEMBER = 200_000


def token_features(token: str) -> list[str]:
    core = token.strip(PUNCTUATION)
    return [f"={core}", *(core[:n] for n in PREFIXES if len(core) > n)] if core else []


def shape(text: str, tokens: list[str], distinct: int) -> list[float]:
    """Figures of the whole text: shares of symbols, capitals, digits and lines; repetition; lengths."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, words = max(1, int(raw.sum())), max(1, len(tokens))
    return [
        1.0,
        *(min(1.0, 5.0 * raw[ord(c)] / words) for c in SYMBOLS),
        5.0 * raw[65:91].sum() / n,
        5.0 * raw[48:58].sum() / n,
        5.0 * raw[10] / words,
        5.0 * (raw[46] + raw[44]) / words,
        1 - distinct / words,
        math.log1p(words) / 5,
        min(2.0, n / words / 8),
        1.0 if words < 5 else 0.0,
        max(0.0, distinct / words - 0.5) if words > 50 else 0.0,
        1.0 if words > 20 and distinct / words < 0.2 else 0.0,
    ]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a ridge penalty (none on the constant)."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[0] = 1e-3
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: np.ndarray) -> dict:
    """Selected features (by the z score of their log odds) and weights for each target. ``labels``: (rows, targets)."""
    tokens = [(t or "").lower().split() for t in texts]
    sets = [set(t) for t in tokens]
    memo = {t: token_features(t) for t in set().union(*sets)} if sets else {}
    docs = [{f for t in s for f in memo[t]} for s in sets]
    index: dict[str, int] = {}
    rows, cols = [], []
    for k, feats in enumerate(docs):
        cols += [index.setdefault(f, len(index)) for f in sorted(feats)]
        rows += [k] * len(feats)
    row, col, names = np.array(rows, int), np.array(cols, int), list(index)
    chosen: dict[str, int] = {}
    df = np.bincount(col, minlength=len(names)).astype(float)
    own: list[list[int]] = [[] for _ in range(labels.shape[1])]
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        if not len(names) or y.min() == y.max():
            continue
        hit = np.bincount(col, y[row], minlength=len(names))
        share = (y.sum() + 0.5) / (len(y) + 1)
        z = (hit - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
        z[df < LEAST_DOCS] = 0
        for f in np.argsort(-np.abs(z), kind="stable")[:SELECTED]:
            if abs(z[f]) >= LEAST_Z:
                own[c].append(chosen.setdefault(names[f], len(chosen)))
    model = {"features": chosen, "weights": None}
    x = np.array([_row(model, t, text or "", {}) for t, text in zip(tokens, texts, strict=True)])
    model["weights"] = np.zeros((x.shape[1], labels.shape[1]))
    figures = x.shape[1] - len(chosen)
    for c in range(labels.shape[1]):  # each target uses the features selected for it
        use = np.concatenate([np.arange(figures), figures + np.array(own[c], int)])
        model["weights"][use, c] = _logistic(x[:, use], labels[:, c].astype(float))
    return model


def _row(model: dict, tokens: list[str], text: str, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Shape figures, then log(1 + number of distinct tokens) of each selected feature."""
    chosen, distinct = model["features"], set(tokens)
    for token in distinct.difference(memo):
        memo[token] = tuple(chosen[f] for f in token_features(token) if f in chosen)
    out = np.zeros(len(chosen))
    for token in distinct:
        for f in memo[token]:
            out[f] += 1
    return np.concatenate([shape(text, tokens, len(distinct)), np.log1p(out)])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The pickled model (some tens of kB), fitted in one task on the bounded sample of labelled documents."""
    ship(docs.sparkSession)
    known = labels.filter(" and ".join(f"{t} is not null" for t in TARGETS)).groupBy(id_col).agg(*[F.max(t).cast("int").alias(t) for t in TARGETS])
    sample = written(known.filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(5)), id_col).limit(TRAIN_ROWS), "labelled")
    rows = docs.filter(F.length(text_col) <= TRAIN_CHARS).select(id_col, F.col(text_col).alias("text")).join(sample, id_col).select(F.xxhash64(id_col).alias("order"), "text", *TARGETS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "text"]).head(2 * TRAIN_ROWS)
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].tolist(), pdf[list(TARGETS)].to_numpy()))]})

    row = rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").first()
    return bytes(row["model"]) if row else pickle.dumps({"features": {}, "weights": np.zeros((len(shape("", [], 0)), len(TARGETS)))})


class _Scorer:
    def __init__(self, model: dict):
        self.model, self.memo = model, {}

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty((len(texts), len(TARGETS)))
        for k, text in enumerate(texts):
            if len(self.memo) > REMEMBER:
                self.memo.clear()
            out[k] = _row(self.model, (text or "").lower().split(), text or "", self.memo) @ self.model["weights"]
        return np.clip(out, -12, 12)


def _cached(digest: str, model: bytes) -> _Scorer:
    return only(("scorer", digest), lambda: _Scorer(pickle.loads(model)))


def evidence(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(id, host, path, and the document's log odds for each target) for every row; a null text counts as empty."""
    digest = hashlib.sha256(model).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        odds = _cached(digest, model).log_odds(batch.column(3).to_pylist())
        return pa.record_batch([*batch.columns[:3], *[pa.array(odds[:, c]) for c in range(len(TARGETS))]], names=["id", "host", "path", *TARGETS])

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    return map_columns(named, ["id", "host", "path", "text"], f"id {kind}, host string, path string, " + ", ".join(f"{t} double" for t in TARGETS), run)


def _odds(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(held / (1 - held))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _strength(sites: DataFrame, n: Column, k: Column, prior: Column) -> float:
    """Prior strength by the method of moments: how many documents the prior counts for, between 1 and 1e6.

    The spread of site rates beyond what chance within sites explains is the variance of the prior.
    """
    row = sites.agg(F.sum(n).alias("n"), F.sum(n * F.pow(k / n - prior, 2)).alias("seen"), F.sum(prior * (1 - prior)).alias("chance"), F.sum(n * prior * (1 - prior)).alias("most")).first()
    if not row["n"] or not row["most"]:
        return 1.0
    spread = max(0.0, row["seen"] - row["chance"]) / row["most"]
    return float(min(1e6, max(1.0, 1 / spread - 1 if spread > 0 else 1e6)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(id, doc_quality, doc_toxic, host_quality, path_quality, p_quality, p_toxic, keep) for every row of ``docs``.

    ``doc_*``: the document's own evidence; ``host_*`` and ``path_*``: shrunk rates of its site; ``p_*``: all
    combined; ``keep``: of quality and under ``TOXIC_AT``. Null hosts and paths form a site of their own, null texts count as
    empty, repeated rows stay and count in their site as often, a table without labels gives even odds; other
    columns are ignored.
    """
    # Written: the sites and the documents below both use it, and the text is scored once.
    own = written(evidence(docs, train(docs, labels, id_col, text_col), id_col, text_col, host_col, path_col), "evidence")
    chance = own.select("id", "host", "path", *TARGETS, *[_chance(F.col(t)).alias(f"p_{t}") for t in TARGETS])
    paths = written(chance.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"p_{t}").alias(f"k_{t}") for t in TARGETS]), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"k_{t}").alias(f"hk_{t}") for t in TARGETS]), "hosts")
    total = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"hk_{t}").alias(t) for t in TARGETS]).first()
    base = {t: (total[t] + 0.5) / (total["n"] + 1) if total["n"] else 0.5 for t in TARGETS}
    for t in TARGETS:
        strength = _strength(hosts, F.col("hn"), F.col(f"hk_{t}"), F.lit(base[t]))
        hosts = hosts.withColumn(f"hc_{t}", F.lit(strength)).withColumn(f"host_{t}", (F.col(f"hk_{t}") + strength * base[t]) / (F.col("hn") + strength))
    sites = written(paths.join(hosts, "host"), "sites")
    for t in TARGETS:
        strength = _strength(sites, F.col("n"), F.col(f"k_{t}"), F.col(f"host_{t}"))
        sites = sites.withColumn(f"c_{t}", F.lit(strength))

    out = salted_join(chance, sites, ["host", "path"], ["id", *TARGETS])
    for t in TARGETS:
        mine = F.col(f"p_{t}")
        host = (F.greatest(F.col(f"hk_{t}") - mine, F.lit(0.0)) + F.col(f"hc_{t}") * base[t]) / (F.col("hn") - 1 + F.col(f"hc_{t}"))
        path = (F.greatest(F.col(f"k_{t}") - mine, F.lit(0.0)) + F.col(f"c_{t}") * host) / (F.col("n") - 1 + F.col(f"c_{t}"))
        out = out.withColumn(f"site_{t}", path).withColumn(f"all_{t}", _chance(F.col(t) + _odds(F.col(f"site_{t}")) - _odds(F.lit(base[t]))))
    return out.select(
        F.col("id").alias(id_col),
        F.col("p_quality").alias("doc_quality"),
        F.col("p_toxic").alias("doc_toxic"),
        "host_quality",
        F.col("site_quality").alias("path_quality"),
        F.col("all_quality").alias("p_quality"),
        F.col("all_toxic").alias("p_toxic"),
        ((F.col("all_quality") >= 0.5) & (F.col("all_toxic") < TOXIC_AT)).alias("keep"),
    )
