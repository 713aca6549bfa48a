"""Toxicity scores by non-negative positive-unlabelled learning, in numpy.

Training takes confirmed toxic documents (P) and unlabelled text (U); labels of clean documents are never used for the
loss. With class prior p, the risk is ``p * R_P(+) + max(0, R_U(-) - p * R_P(-))``: where the bracket falls below 0 the
step ascends it instead, so the model cannot fit unlabelled positives as negatives.

The model is linear over hashed features of a text's distinct words (the word and its prefixes), divided by a power of
their number. Both training sets are bounded, seeded samples (at most ``positives`` and ``unlabelled`` distinct pairs of id
and text, so repeated rows count once); the settings are trained as tasks beside each other. A quarter of each is kept aside to choose between a few settings and to place the cut where recall squared over the share of unlabelled
text predicted positive is largest, which needs no clean labels. All documents are scored, over their whole text.

Edge cases: null and empty texts have no features and score the bias; without any positive or unlabelled row every
score is 0; repeated rows are scored alike and drawn once, however often they occur; rows that share an id share its label
and its fold; documents without id count as not held out and are never drawn; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import Scratch

EDGES = b".,;:!?\"'()[]{}#*$%&|<>"
#: (power of the feature count, L2 weight, learning rate)
SETTINGS = ((0.7, 1e-5, 0.1), (0.5, 1e-4, 0.1), (0.5, 3e-5, 0.1), (0.7, 1e-4, 0.1))
#: Standard errors by which the share of unlabelled text predicted positive may exceed the class prior.
ERRORS = 1.0


def fold(key: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def word_features(word: bytes, bits: int) -> list[int]:
    w = word.lower().strip(EDGES)
    if not w:
        return []
    return [xxhash.xxh32_intdigest(x) & ((1 << bits) - 1) for x in [b"w" + w, *(b"p" + w[:n] for n in range(4, 9) if len(w) > n)]]


class Features(dict):
    """The features of a word, remembered for up to ``limit`` words."""

    limit = 300_000

    def __init__(self, bits: int):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.limit:
            self.clear()
        f = self[word] = word_features(word, self.bits)
        return f


def feature_rows(bits: int):
    """For ``mapInArrow``: (positive, text) to (positive, feature numbers, counts), as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(bits)
        for batch in batches:
            index, count = [], []
            for t in batch.column(1).to_pylist():
                f = [x for w in set((t or "").encode("utf-8", "surrogatepass").split()) for x in known[w]]
                i, n = np.unique(np.array(f, np.int32), return_counts=True)
                index.append(i.tobytes())
                count.append(np.minimum(n, 32767).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(count, pa.binary())], ["positive", "index", "count"])

    return run


@dataclass
class Model:
    bits: int = 18
    power: float = 0.5
    bias: float = -20.0
    cut: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))


Rows = list[tuple[np.ndarray, np.ndarray]]


class Sparse:
    """Rows of feature numbers and counts, end to end; a value is its count over a power of the row's sum."""

    def __init__(self, rows: Rows):
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int32)
        self.count = np.concatenate([n for _, n in rows]) if rows else np.empty(0, np.int16)
        self.size = np.array([len(i) for i, _ in rows], np.int64)
        self.total = np.array([max(1, int(n.sum())) for _, n in rows], np.float64)
        self.starts = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def only(self, live: np.ndarray) -> None:
        """Forget all other features and number these anew; the rows' sums stay."""
        kept = live[self.index]
        self.size = np.bincount(np.repeat(np.arange(len(self.size)), self.size), kept, len(self.size)).astype(np.int64)
        self.index, self.count = (np.cumsum(live) - 1).astype(np.int32)[self.index[kept]], self.count[kept]
        self.starts = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.size[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row = np.repeat(np.arange(len(rows)), size)
        return self.index[at], self.count[at] / (self.total[rows] ** power)[row], row

    def score(self, rows: np.ndarray, w: np.ndarray, b: float, power: float) -> np.ndarray:
        out = []
        for part in np.array_split(rows, max(1, len(rows) // 500)):
            index, value, row = self.take(part, power)
            out.append(b + np.bincount(row, value * w[index], len(part)))
        return np.concatenate(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, bool, np.ndarray, np.ndarray]:
    """``(risk, ascend, d fp, d fu)`` of the non-negative risk with the logistic loss for outputs on P and U.

    Where the bracket ``R_U(-) - prior * R_P(-)`` is below 0, the slopes are those of its negative alone.
    """
    bracket = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    risk = prior * np.logaddexp(0, -fp).mean() + max(0.0, bracket)
    if bracket < 0:
        return risk, True, prior * sigmoid(fp) / len(fp), -sigmoid(fu) / len(fu)
    # logistic loss: l(-) - l(+) = f, so both terms of P add up to a constant slope
    return risk, False, np.full(len(fp), -prior / len(fp)), sigmoid(fu) / len(fu)


def train(p: Sparse, pr: np.ndarray, u: Sparse, ur: np.ndarray, prior: float, width: int, power: float, l2: float, rate: float, steps: int = 400, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias on the rows ``pr`` of P and ``ur`` of U, after about ``steps`` Adam steps on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w, b, m, v, mb, vb, t = np.zeros(width), float(np.log(prior / (1 - prior))), np.zeros(width), np.zeros(width), 0.0, 0.0, 0
    for _ in range(-(-steps // max(1, -(-len(ur) // batch)))):
        order = rng.permutation(ur)
        for at in range(0, len(order), batch):
            nu, np_ = min(batch, len(order) - at), min(len(pr), batch // 4)
            iu, xu, ru = u.take(order[at : at + batch], power)
            ip, xp, rp = p.take(rng.choice(pr, np_, replace=False), power)
            _, _, gp, gu = risk_slopes(b + np.bincount(rp, xp * w[ip], np_), b + np.bincount(ru, xu * w[iu], nu), prior)
            g = l2 * w + np.bincount(iu, xu * gu[ru], width) + np.bincount(ip, xp * gp[rp], width)
            gb, t = gu.sum() + gp.sum(), t + 1
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def trial(p: Sparse, u: Sparse, prior: float, width: int, setting: tuple[float, float, float], seed: int) -> tuple[float, float, float, np.ndarray]:
    """``(gain, bias, cut, weights)`` of one setting, judged on the rows kept aside."""
    power, l2, rate = setting
    rng = np.random.default_rng(seed)
    po, uo = rng.permutation(len(p)), rng.permutation(len(u))
    a, b = max(1, len(p) // 4), max(1, len(u) // 4)
    w, bias = train(p, po[a:], u, uo[b:], prior, width, power, l2, rate)
    sp, su = p.score(po[:a], w, bias, power), u.score(uo[:b], w, bias, power)
    cuts = np.unique(np.concatenate([sp, su]))
    recall = 1 - np.searchsorted(np.sort(sp), cuts, "left") / len(sp)
    share = 1 - np.searchsorted(np.sort(su), cuts, "left") / len(su)
    gain = np.where(share <= prior + ERRORS * (prior * (1 - prior) / len(su)) ** 0.5, recall**2 / np.maximum(share, prior / 2), -1)
    i = int(gain.argmax())
    below = sp[sp < cuts[i]].tolist() + su[su < cuts[i]].tolist()
    return float(gain.max()), bias, float((cuts[i] + max(below)) / 2 if below else cuts[i]), w.astype(np.float32)


def fit(spark: SparkSession, p: Sparse, u: Sparse, prior: float, bits: int = 18, seed: int = 5) -> Model:
    """The best of ``SETTINGS`` on rows kept aside, with its cut. Each setting is one task."""
    if len(p) < 2 or len(u) < 2:
        return Model(bits)
    live = np.bincount(u.index, minlength=1 << bits) + np.bincount(p.index, minlength=1 << bits) >= 3
    p.only(live)
    u.only(live)
    width = int(live.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                gain, bias, cut, w = trial(p, u, prior, width, SETTINGS[i], seed)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([gain]), pa.array([bias]), pa.array([cut]), pa.array([w.tobytes()])], ["i", "gain", "bias", "cut", "weights"])

    n = len(SETTINGS)
    best = max(spark.range(0, n, 1, n).mapInArrow(run, "i bigint, gain double, bias double, cut double, weights binary").collect(), key=lambda r: (r["gain"], -r["i"]))
    weights = np.zeros(1 << bits, np.float32)
    weights[live] = np.frombuffer(best["weights"], np.float32)
    return Model(bits, SETTINGS[best["i"]][0], best["bias"], best["cut"], weights)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, train_rows: Column, positives: int, unlabelled: int, bits: int, features: int = 24_000_000) -> tuple[Sparse, Sparse, float]:
    """Bounded, seeded samples of P and U as features, and the share of toxic among labelled training rows.

    The draw is over distinct pairs of id and text, found by hash; one row of each drawn pair is read. P and U are cut, in
    the order of the draw, where they reach ``features`` distinct features in all, so texts of very many words make the
    sample shorter, not larger.
    """
    known = labels.where(train_rows).select(key, "toxic").distinct()
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    rows = docs.where(train_rows).select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    draw = lambda df, salt, n, positive: df.select("k", "h").distinct().orderBy(F.xxhash64("k", "h", F.lit(salt)), "k", "h").limit(n).withColumn("positive", F.lit(positive))
    toxic = known.where("toxic = 1").select(F.col(key).alias("k"))
    chosen = draw(rows.join(toxic, "k", "left_semi"), 11, positives, True).union(draw(rows, 12, unlabelled, False))  # at most positives + unlabelled rows, hence the broadcast
    found = rows.join(F.broadcast(chosen), ["k", "h"]).dropDuplicates(["k", "h", "positive"])
    own = Scratch(docs.sparkSession)
    ready = own.save(found.select("positive", "t").mapInArrow(feature_rows(bits), "positive boolean, index binary, count binary").withColumn("i", F.monotonically_increasing_id()), "sample")
    size = ready.select("i", "positive", F.xxhash64("index", "count").alias("draw"), (F.length("index") / 4).cast("long").alias("n"))  # one narrow row for each of the drawn
    running = F.sum("n").over(Window.partitionBy("positive").orderBy("draw", "i").rowsBetween(Window.unboundedPreceding, 0))
    rows = ready.join(size.withColumn("sum", running).where(F.col("sum") <= features).select("i"), "i", "left_semi").select("positive", "index", "count").collect()
    own.close()
    rows.sort(key=lambda r: (r["positive"], r["index"], r["count"]))  # the same order on every run
    packed = lambda want: Sparse([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["count"], np.int16)) for r in rows if r["positive"] == want])
    p, u = packed(True), packed(False)
    rows.clear()  # both hold copies
    return p, u, float(min(max(prior or 0.1, 0.005), 0.9))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every document: 0.5 at the model's cut. A document is one sum over its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.astype(np.float64)

        class Sums(dict):
            def __missing__(self, word: bytes) -> tuple[float, int]:
                if len(self) >= Features.limit:
                    self.clear()
                f = word_features(word, model.bits)
                s = self[word] = (float(weights[f].sum()) if f else 0.0, len(f))
                return s

        known = Sums() if len(weights) > 1 else None
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                total = n = 0.0
                if known is not None:
                    for w in set((t or "").encode("utf-8", "surrogatepass").split()):
                        s = known[w]
                        total += s[0]
                        n += s[1]
                z = model.bias + total / max(1.0, n) ** model.power - model.cut
                out.append(0.0 if known is None else float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [key, "score"])

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, f"{key} bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0, positives: int = 2500, unlabelled: int = 8000, bits: int = 18, features: int = 24_000_000) -> DataFrame:
    """``(key, held_out, score, predicted)`` for every document, learnt from rows outside the held-out fold."""
    outside = F.coalesce(fold(key, folds) != held, F.lit(False))
    p, u, prior = sample(docs, labels, key, text, outside, positives, unlabelled, bits, features)
    scored = score(docs, fit(docs.sparkSession, p, u, prior, bits), key, text)
    return scored.select(key, F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
