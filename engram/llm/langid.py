"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

The features of a text are its character 2- to 5-grams, lower-cased, with one blank for all that is no letter, hashed
into buckets. A text is the average of its features' embeddings; a linear softmax gives the language. As both layers are
linear up to the softmax, prediction adds up one small vector per gram.

Training takes a bounded, seeded sample of labelled texts outside the held-out fold, drawn by language: each gets an equal
part of ``rows`` (20 at least), and where it has fewer its rows repeat, so a rare language is learnt too. A fifth of each
language is kept aside: a temperature calibrates the probabilities on it, and the least score whose accepted texts reach
``precision`` becomes the rejection level, reported as ``accepted``. With fewer than five rows in every language none can
be kept aside, and nothing is accepted.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without training rows every text is
``und``; ties go to the first language in order; repeated rows are predicted alike and drawn once, however often they
occur; rows with a null id are drawn as others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.toxicity import Rows, fold

BLANK = 32
#: Characters scored at a time.
PIECE = 1 << 18


def letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a blank; beyond the basic plane ``codes`` asks per character."""
    table = np.full(1 << 16, BLANK, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def codes(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-case letters with one blank for every run of other characters, blanks at both ends."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = c >= 1 << 16
    out = table[np.where(high, 0, c)]
    if high.any():
        found = {x: x if chr(x).isalpha() else BLANK for x in np.unique(c[high]).tolist()}
        out[high] = [found[x] for x in c[high].tolist()]
    out = np.concatenate([[BLANK], out, [BLANK]]).astype(np.uint32)
    return out[np.concatenate([[True], (out[1:] != BLANK) | (out[:-1] != BLANK)])]


def grams(c: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the character 2- to 5-grams, in pieces of one length each."""
    h = c * np.uint32(0x9E3779B1)
    for n in range(2, 6):
        if len(c) < n:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :]
        yield ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def feature_rows(bits: int):
    """For ``mapInArrow``: (lang, text) to (lang, bucket numbers, counts), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for batch in batches:
            index, count = [], []
            for t in batch.column(1).to_pylist():
                total = sum((np.bincount(g, minlength=1 << bits) for g in grams(codes(t or "", table), bits)), np.zeros(1 << bits, np.int64))
                i = np.flatnonzero(total)
                index.append(i.astype(np.int32).tobytes())
                count.append(np.minimum(total[i], 32767).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(count, pa.binary())], ["lang", "index", "count"])

    return run


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    bits: int = 16
    #: bucket by language: the embedding and the linear layer multiplied out
    logits: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    reject: float = 0.0


def _take(rows: Rows, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index = np.concatenate([rows[i][0] for i in ids])
    value = np.concatenate([rows[i][1] / rows[i][1].sum() for i in ids])
    return index, value, np.repeat(np.arange(len(ids)), [len(rows[i][0]) for i in ids])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_slopes(h: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Summed cross-entropy of averaged embeddings ``h`` and its slopes by ``h``, ``w`` and ``b``."""
    p = _softmax(h @ w + b)
    at = np.arange(len(y)), y
    loss = -np.log(p[at]).sum()
    p[at] -= 1
    return float(loss), p @ w.T, h.T @ p, p.sum(axis=0)


def fit(rows: Rows, langs: list[str], bits: int = 16, dim: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.5, precision: float = 0.99, seed: int = 9, least_steps: int = 120) -> Model:
    """SGD with a falling rate, then temperature and rejection level on the rows kept aside."""
    keep = [i for i, (x, _) in enumerate(rows) if len(x)]
    rows, langs = [rows[i] for i in keep], [langs[i] for i in keep]
    names = sorted(set(langs))
    if not names:
        return Model(bits=bits)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(rows))
    per = [order[y[order] == c] for c in range(len(names))]
    aside = np.concatenate([x[: len(x) // 5] for x in per])
    most = max(len(x) - len(x) // 5 for x in per)
    used = np.concatenate([np.resize(x[len(x) // 5 :], most) for x in per])  # rows of rarer languages repeat
    e, w, b = rng.normal(0, 0.1, (1 << bits, dim)), rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    epochs = max(epochs, -(-least_steps // -(-len(used) // batch)))
    steps, t = epochs * -(-len(used) // batch), 0
    for _ in range(epochs):
        used = rng.permutation(used)
        for at in range(0, len(used), batch):
            ids = used[at : at + batch]
            index, value, row = _take(rows, ids)
            h = np.stack([np.bincount(row, value * e[index, d], len(ids)) for d in range(dim)], axis=1)
            _, gh, gw, gb = loss_slopes(h, w, b, y[ids])
            now = rate * (1 - t / steps)
            touched, back = np.unique(index, return_inverse=True)
            for d in range(dim):  # summed, not averaged: a bucket is in few documents of a batch
                e[touched, d] -= now * 40 * np.bincount(back, value * gh[row, d], len(touched))
            w -= now * gw / len(ids)
            b -= now * gb / len(ids)
            t += 1
    model = Model(names, bits, e @ w, b, reject=2.0)  # no score reaches 2
    if len(aside):
        z = np.stack([(rows[i][1] / rows[i][1].sum()) @ model.logits[rows[i][0]] + b for i in aside])
        loss = lambda c: -np.log(np.maximum(_softmax(z / c)[np.arange(len(aside)), y[aside]], 1e-12)).mean()
        model.temperature = float(min((0.05 * 1.25**i for i in range(24)), key=loss))
        p = _softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == y[aside]
        o = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[o]) / np.arange(1, len(o) + 1) >= precision)
        model.reject = float(best[o][good[-1]]) if len(good) else 2.0
    return model


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, accepted)`` of every document."""

    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, table, logits = len(model.langs), letters(), model.logits.astype(np.float32)
        for batch in batches:
            lang, score = [], []
            for t in batch.column(1).to_pylist():
                c = codes(t or "", table)
                if not n or (c == BLANK).all():
                    lang.append("und")
                    score.append(0.0)
                    continue
                total, count = np.zeros(n), 0
                for at in range(0, len(c), PIECE):  # long texts in pieces that share a gram's length
                    for g in grams(c[at : at + PIECE + 4], bits):
                        total += logits[g].sum(axis=0, dtype=np.float64)
                        count += len(g)
                p = _softmax(((total / max(count, 1) + model.bias) / model.temperature)[None])[0]
                lang.append(model.langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s >= model.reject and x != "und" for s, x in zip(score, lang, strict=True)], pa.bool_())], [key, "lang_pred", "score", "accepted"])

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, f"{key} bigint, lang_pred string, score double, accepted boolean")


def drawn(known: DataFrame, rows: int, languages: int) -> DataFrame:
    """Distinct ``(lang, k, h)``: at most ``rows`` in all, alike for each of the ``languages`` most frequent languages.

    A hash below a threshold, set by each language's number of rows so that four times its share pass, comes before any row
    is ordered; so what is shuffled and sorted is bounded however many rows a language has. A language of which copies are
    more than three quarters may give fewer.
    """
    per = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = max(1, rows // max(1, per.count()))
    hashed = F.xxhash64("k", "h", F.lit(21))
    level = F.least(F.lit(1.0), F.lit(4.0 * share) / F.col("n"))
    near = known.join(F.broadcast(per), "lang").where(F.pmod(hashed, F.lit(1 << 40)) < level * float(1 << 40)).select("lang", "k", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "k", "h"))
    return near.withColumn("n", place).where(F.col("n") <= share).select("lang", "k", "h")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2, rows: int = 2_500, bits: int = 16, languages: int = 250) -> DataFrame:
    """``(key, held_out, lang_pred, score, accepted)`` for every document, learnt outside the held-out fold.

    The sample is bounded by ``rows``; of more than ``languages`` languages only the most frequent are learnt.
    """
    outside = F.coalesce(fold(key, folds) != held, F.lit(True))
    known = docs.where(outside & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    chosen = drawn(known, rows, languages)  # at most ``rows``, hence the broadcast
    same = [F.col("r.lang") == F.col("c.lang"), F.col("r.k").eqNullSafe(F.col("c.k")), F.col("r.h") == F.col("c.h")]
    picked = known.alias("r").join(F.broadcast(chosen.alias("c")), same, "left_semi").dropDuplicates(["lang", "k", "h"])
    found = picked.select("lang", "t").mapInArrow(feature_rows(bits), "lang string, index binary, count binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["index"]), bytes(r["count"])))
    model = fit([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["count"], np.int16)) for r in found], [r["lang"] for r in found], bits)
    out = predict(docs, model, key, text)
    return out.select(key, F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
