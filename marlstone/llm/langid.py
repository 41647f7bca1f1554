"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams with word marks (those at a mark are its affixes) and the word itself
(lexicon); their weights and the transitions between languages are learned together, from documents and from
documents spliced together, as code-switched text would be. Forward-backward gives each word a distribution over
the languages; a document gets the language with the largest mean. Chains run over whole documents: they are cut
into blocks, the blocks' transfer matrices carry the messages across the cuts, and all blocks step together.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import broadcast_if_small, map_columns, only, written

#: The sample that the weights are fitted on: at most so many labelled documents of each language, of at most so many characters.
TRAIN_DOCS, TRAIN_CHARS = 150, 20_000
ROUNDS, RATE, DECAY = 24, 0.5, 1e-6
BITS, GRAMS, BLOCK = 15, (1, 2, 3, 4, 5), 64
REMEMBER, GROUP = 200_000, 500_000
UNKNOWN = "und"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words one after the other, and where each word's begin."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    buf = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.repeat(np.cumsum(size), size)
    place, word = np.arange(len(buf)), np.repeat(np.arange(len(marked)), size)
    feats, owner = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) >> np.uint32(32 - BITS)], [np.arange(len(words))]
    rolling = np.zeros(len(buf), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        reach = len(buf) - n + 1
        if reach <= 0:
            break
        rolling[:reach] = rolling[:reach] * np.uint32(16777619) + buf[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            own = place[:reach] + n <= end[:reach]
            feats.append((rolling[:reach][own] * np.uint32(2654435761)) >> np.uint32(32 - BITS))
            owner.append(word[:reach][own])
    feat, who = np.concatenate(feats), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))[:-1]])
    return feat[order].astype(np.int64), starts


def emissions(weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """(words, labels): the sum of each word's weights, over the root of their number."""
    feat, starts = features(words)
    n = np.diff(np.append(starts, len(feat)))
    return np.add.reduceat(weights[feat], starts, axis=0) / np.sqrt(n)[:, None]


def messages(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains that follow one another in ``emit`` (words, labels; logarithms).

    ``lengths``: words of each chain, none of them 0. ``trans``: (from, to), logarithms. Returns each word's distribution
    over the labels, and (``pairs``) the expected number of each transition, from the messages of both sides of it.
    A chain's first word has no transition before it.
    """
    k = emit.shape[1]
    step = np.exp(trans - trans.max())
    power = np.exp(emit - emit.max(axis=1, keepdims=True))
    power[np.cumsum(lengths) - lengths] /= step.sum(axis=0)  # undoes the step from the even start
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    chain_of = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(total) - first_block[chain_of]
    start = (np.cumsum(lengths) - lengths)[chain_of] + nth * BLOCK
    size = np.minimum(BLOCK, lengths[chain_of] - nth * BLOCK)
    grid = start[:, None] + np.minimum(np.arange(BLOCK), size[:, None] - 1)
    e, live = power[grid], np.arange(BLOCK) < size[:, None]
    width = int(size.max())
    norm = lambda x, axes: x / x.sum(axis=axes, keepdims=True)

    # Transfer matrix of each block: its rows are the states before it.
    carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(width):
        on = live[:, t]
        carry[on] = norm((carry[on] @ step) * e[on, t][:, None, :], (1, 2))
    # Messages into each block, over the chains side by side, longest first.
    order = np.argsort(-blocks, kind="stable")
    into, out_of = np.empty((total, k)), np.empty((total, k))
    state = np.full((len(lengths), k), 1.0 / k)
    for j in range(int(blocks.max())):
        who = order[: int(np.searchsorted(-blocks[order], -j))]
        at = first_block[who] + j
        into[at] = state[who]
        state[who] = norm((state[who][:, None, :] @ carry[at])[:, 0], 1)
    state = np.full((len(lengths), k), 1.0 / k)
    for j in range(int(blocks.max()) - 1, -1, -1):
        who = order[: int(np.searchsorted(-blocks[order], -j))]
        at = first_block[who] + j
        out_of[at] = state[who]
        state[who] = norm((carry[at] @ state[who][:, :, None])[:, :, 0], 1)
    # Inside the blocks.
    ahead, state = np.empty((total, width, k)), into
    behind = np.empty((total, width, k)) if pairs else None
    for t in range(width):
        state = np.where(live[:, t, None], norm((state @ step) * e[:, t], 1), state)
        ahead[:, t] = state
    state, on = out_of, live[:, :width]
    before = ahead[on] if pairs else None
    for t in range(width - 1, -1, -1):
        ahead[:, t] *= state
        if pairs:
            behind[:, t] = state * e[:, t]
        state = np.where(live[:, t, None], norm((e[:, t] * state) @ step.T, 1), state)
    p, expected = norm(ahead[on], 1), np.zeros((k, k))
    if pairs and len(emit) > len(lengths):
        inner = np.setdiff1d(np.arange(len(emit) - 1), np.cumsum(lengths) - 1)
        joint = before[inner][:, :, None] * step[None] * behind[on][inner + 1][:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, expected


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each word's distribution over the labels."""
    return messages(emit, lengths, trans)[0]


class Tagger:
    """A model and the emissions of the words that it has met."""

    def __init__(self, model: dict):
        self.labels, self.weights, self.trans = model["labels"], model["weights"], model["trans"]
        self.place: dict[str, int] = {}
        self.used = 0
        self.emit = np.zeros((1024, len(self.labels)), np.float32)

    def _learn(self, tokens: set[str]) -> None:
        if len(self.place) > REMEMBER:
            self.place.clear()
            self.used = 0
        new, words, at = tokens.difference(self.place), [], self.used
        for token in new:
            if (core := token.strip(PUNCTUATION)) and any(map(str.isalpha, core)):
                self.place[token] = at + len(words)
                words.append(core.encode("utf-8", "surrogatepass"))
            else:
                self.place[token] = -1
        if words:
            while len(self.emit) < at + len(words):
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            self.emit[at : at + len(words)] = emissions(self.weights, words)
        self.used = at + len(words)

    def tag(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its mean probability of each text."""
        names, scores, k = [], [], 0
        while k < len(texts):
            group, held = [], 0
            while k < len(texts) and (not group or held + len(texts[k] or "") <= GROUP):
                group.append((texts[k] or "").lower().split())
                held += len(texts[k] or "")
                k += 1
            self._learn(set().union(*group))
            ids = np.fromiter((x for tokens in group for x in map(self.place.__getitem__, tokens)), np.int64, sum(map(len, group)))
            doc = np.repeat(np.arange(len(group)), np.fromiter(map(len, group), np.int64, len(group)))
            doc, ids = doc[ids >= 0], ids[ids >= 0]
            mean = np.zeros((len(group), len(self.labels)))
            if len(ids):
                n = np.bincount(doc, minlength=len(group))
                p = marginals(self.emit[ids].astype(np.float64), n[n > 0], self.trans)
                for c in range(p.shape[1]):
                    mean[:, c] = np.bincount(doc, p[:, c], minlength=len(group)) / np.maximum(n, 1)
            best = mean.argmax(axis=1)
            top = mean[np.arange(len(group)), best]
            names += [self.labels[b] if s > 0 else UNKNOWN for b, s in zip(best, top, strict=True)]
            scores += [min(1.0, float(s)) for s in top]
        return names, scores


def fit(texts: list[str], langs: list[str]) -> dict:
    """Weights and transitions by adaptive gradient steps on the conditional likelihood of the sample."""
    labels = sorted(set(langs))
    place: dict[bytes, int] = {}
    docs: list[tuple[int, np.ndarray]] = []
    for text, lang in zip(texts, langs, strict=True):
        words = [w.encode("utf-8", "surrogatepass") for t in text.lower().split() if (w := t.strip(PUNCTUATION)) and any(map(str.isalpha, w))]
        if words:
            docs.append((labels.index(lang), np.array([place.setdefault(w, len(place)) for w in words])))
    weights, trans, k = np.zeros((1 << BITS, len(labels))), np.zeros((len(labels), len(labels))), len(labels)
    if not docs:
        return {"labels": labels, "weights": weights.astype(np.float32), "trans": trans}
    # Half of the sample as it is, half in runs of 5 to 40 words from documents in turn.
    rng, parts, gold, lengths = np.random.default_rng(7), [], [], []
    for c, ids in docs[::2]:
        parts.append(ids)
        gold.append(np.full(len(ids), c))
        lengths.append(len(ids))
    pool = [(c, ids[a : a + 40]) for c, ids in docs[1::2] for a in range(0, len(ids), 40)]
    for at in rng.permutation(len(pool)):
        c, ids = pool[at]
        parts.append(ids[: int(rng.integers(5, 41))])
        gold.append(np.full(len(parts[-1]), c))
        if len(lengths) > len(docs[::2]) and lengths[-1] < 200:
            lengths[-1] += len(parts[-1])
        else:
            lengths.append(len(parts[-1]))
    ids, want, n = np.concatenate(parts), np.concatenate(gold), np.array(lengths)
    feat, starts = features(list(place))
    count = np.diff(np.append(starts, len(feat)))
    owner, scale = np.repeat(np.arange(len(place)), count), 1 / np.sqrt(count)
    inner = np.setdiff1d(np.arange(len(ids) - 1), np.cumsum(n) - 1)
    seen = np.bincount(want[inner] * k + want[inner + 1], minlength=k * k).reshape(k, k)
    hist_w, hist_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(ROUNDS):
        emit = np.add.reduceat(weights[feat], starts, axis=0) * scale[:, None]
        p, pairs = messages(emit[ids], n, trans, pairs=True)
        wrong = np.zeros((len(place), k))
        for c in range(k):
            wrong[:, c] = np.bincount(ids, p[:, c] - (want == c), minlength=len(place))
        wrong *= scale[:, None]
        grad = np.stack([np.bincount(feat, wrong[owner, c], minlength=1 << BITS) for c in range(k)], axis=1) / len(ids) + DECAY * weights
        hist_w += grad**2
        weights -= RATE * grad / np.sqrt(hist_w)
        step = (pairs - seen) / max(1, len(inner)) + DECAY * trans
        hist_t += step**2
        trans -= RATE / 2 * step / np.sqrt(hist_t)
        trans = np.clip(trans, -6, 6)
    return {"labels": labels, "weights": weights.astype(np.float32), "trans": trans}


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> bytes:
    """The model, pickled (about 130 kB for each language): fitted in one task on the documented, bounded sample of folds 1 to 4."""
    spark = docs.sparkSession
    ship(spark)
    able = docs.filter((fold(id_col) != 0) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= chars))
    rank = F.xxhash64(F.col(id_col), F.lit(11))
    light = able.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), rank.alias("r"), F.pmod(rank, F.lit(64)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        light = light.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("r", "id"))).filter(F.col("n") <= per_language).drop("n")
    ids = broadcast_if_small(written(light.select(F.col("id").alias(id_col)).distinct(), "sample"), 100_000)
    chosen = able.join(ids, id_col, "left_semi").select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "text"]).groupby("lang").head(per_language * 2)
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].tolist(), pdf["lang"].tolist()))]})

    row = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").first()
    return bytes(row["model"]) if row else pickle.dumps(fit([], []))


def _tagger(digest: str, model: bytes) -> Tagger:
    return only(("tagger", digest), lambda: Tagger(pickle.loads(model)))


def predict(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row.

    Null texts and texts without a letter get ``und`` and score 0, as all do if nothing was learned; repeated rows
    stay; other columns are ignored.
    """
    digest = hashlib.sha256(model).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tagger = _tagger(digest, model)
        names, scores = tagger.tag(batch.column(2).to_pylist()) if tagger.labels else ([UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return map_columns(rows, ["id", "held_out", "text"], f"id {kind}, held_out boolean, lang_pred string, score double", run).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` with a model learned from the same table's folds 1 to 4."""
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows whose text has a language with a mean probability of at least ``least``, with all their columns.

    Null and empty texts and texts without a letter go; repeated rows share their fate; a null label only keeps a row from
    the training sample; very long texts are judged whole; without labels nothing is known and nothing stays; an empty table
    is no error. A tie between languages goes to the first by name.
    """
    model = train(docs, id_col, text_col, lang_col)
    digest, columns = hashlib.sha256(model).hexdigest(), docs.columns
    at = columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tagger = _tagger(digest, model)
        names, scores = tagger.tag(batch.column(at).to_pylist()) if tagger.labels else ([UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows)
        return batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)]))

    return map_columns(docs, columns, docs.schema, run)
