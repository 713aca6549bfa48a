"""What a store knows about itself: the fingerprint of its vocabulary, the embedding model and dimension, re-embedding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from engram.schema import Vocabulary
from engram.sources.versions import Store, Transaction

META = "meta"
#: The parts of a vocabulary by name, in the order of its canonical form.
PARTS = ("blocking", "categories", "recovery", "relations", "stateful", "states", "unblocking")


def canonical(v: Vocabulary) -> str:
    """The vocabulary as JSON with sorted names and sets, without blanks; the order of states is part of it."""
    parts = {"categories": sorted(v.categories), "relations": sorted(v.relations), "stateful": sorted(v.task_categories), "states": list(v.states), "blocking": v.blocking, "unblocking": v.done, "recovery": v.recovery}
    text = json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for mark in "<>&\u2028\u2029":
        text = text.replace(mark, f"\\u{ord(mark):04x}")
    return text


def fingerprint(v: Vocabulary) -> str:
    """Sixteen hexadecimal digits: the first eight bytes of the canonical form's SHA-256."""
    return hashlib.sha256(canonical(v).encode()).hexdigest()[:16]


def fingerprint_of(**parts: Column) -> Column:
    """The same of a vocabulary in columns: arrays (sorted by the caller) and strings by the names of ``PARTS``."""
    return F.substring(F.sha2(F.to_json(F.struct(*[parts[name].alias(name) for name in PARTS])), 256), 1, 16)


def get(store: Store, key: str) -> str | None:
    if META not in store.tables():
        return None
    row = store.read(META).where(F.col("key") == key).first()
    return row["value"] if row else None


def put(tx: Transaction, **values: object) -> None:
    rows = tx.store.spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
    if tx.has(META):
        tx.upsert(META, rows)
    else:
        tx.create(META, rows, ["key"])


def check_fingerprint(store: Store, v: Vocabulary) -> tuple[str, str]:
    """(stored, current): they differ if the vocabulary has drifted. A store without one takes the current and reports ''."""
    stored, current = get(store, "schema_fingerprint"), fingerprint(v)
    if stored is None:
        store.update(lambda tx: put(tx, schema_fingerprint=current))
    return stored or "", current


def store_fingerprint(store: Store, v: Vocabulary) -> None:
    store.update(lambda tx: put(tx, schema_fingerprint=fingerprint(v)))


@dataclass
class Counters:
    old_dim: int = 0
    new_dim: int = 0
    total: int = 0
    skipped: int = 0
    failed: int = 0
    reembedded: int = 0
    batches: int = 0


def needs_reembedding(store: Store, dim: int, model: str = "") -> tuple[bool, int]:
    """(whether a run is needed, recorded dimension): the dimension or, if both are known, the model differs. A store without
    a record needs none."""
    old, known = get(store, "embedding_dim"), get(store, "model_name")
    if old is None:
        return False, dim
    return int(old) != dim or bool(model and known and model != known), int(old)


def reembed(store: Store, embed: Callable[[pd.Series], pd.Series], dim: int, model: str = "", batch_rows: int = 100_000, table: str = "entities") -> Counters:
    """New embeddings of all live entities, in batches of about ``batch_rows``; each batch is one commit with its counters.

    ``embed`` turns a series of contents into lists (null: failed); vectors are normalised, one of another length counts as
    failed and leaves the old one, an empty content is skipped. Counters are observed in the write of a batch. A run that died
    goes on with the batches that are left, if dimension, model and batches are the same; model and dimension are recorded
    at the end.
    """
    rows = store.read(table).where("not coalesce(archived, false)")
    count = max(1, -(-rows.count() // batch_rows))
    plan = {"dim": dim, "model": model, "of": count}
    before = json.loads(get(store, "reembed") or "{}")
    resumed = {k: before.get(k) for k in plan} == plan
    done, sums = (before["done"], Counters(**before["counters"])) if resumed else (0, Counters(old_dim=int(get(store, "embedding_dim") or dim), new_dim=dim))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches):
        for df in batches:
            text = df["content"].fillna("")
            full = text[text != ""]
            new = dict(zip(full.index, embed(full), strict=True)) if len(full) else {}
            state, out = [], []
            for i, t, old in zip(df.index, text, df["embedding"], strict=True):
                x = new.get(i)
                ok = x is not None and len(x) == dim
                norm = sum(float(v) ** 2 for v in x) ** 0.5 if ok else 0.0
                out.append([float(v) / (norm or 1.0) for v in x] if ok else old)
                state.append("skipped" if t == "" else "reembedded" if ok else "failed")
            yield df.assign(embedding=out, _state=state)

    def change(tx: Transaction, i: int) -> Counters:
        part = tx.read(table).where("not coalesce(archived, false)").where(F.pmod(F.xxhash64("id"), F.lit(count)) == i)
        seen = Observation(f"batch{i}")
        of = lambda s: F.count_if(F.col("_state") == s).alias(s)
        made = part.mapInPandas(run, f"{kinds}, _state string").observe(seen, F.count("*").alias("total"), of("skipped"), of("failed"), of("reembedded"))
        tx.upsert(table, made.select(*part.columns))
        got = seen.get
        now = Counters(sums.old_dim, dim, sums.total + got["total"], sums.skipped + got["skipped"], sums.failed + got["failed"], sums.reembedded + got["reembedded"], sums.batches + 1)
        end = {"embedding_dim": dim} | ({"model_name": model} if model else {}) if i + 1 == count else {}
        put(tx, reembed=json.dumps({} if end else plan | {"done": i + 1, "counters": asdict(now)}), **end)
        return now

    for i in range(done, count):
        sums = store.update(lambda tx, i=i: change(tx, i))
    return sums


def vocabulary_of(entities: DataFrame, edges: DataFrame, tasks: DataFrame, v: Vocabulary) -> DataFrame:
    """One row: the vocabulary that is in use, as sorted arrays, with the declared names of single parts."""
    every = lambda df, c, name: df.agg(F.sort_array(F.collect_set(c)).alias(name))
    row = every(entities, "category", "categories").crossJoin(every(edges, "relation_type", "relations")).crossJoin(every(tasks, "category", "stateful")).crossJoin(every(tasks, "status", "states"))  # one row each
    return row.select("*", F.lit(v.blocking).alias("blocking"), F.lit(v.done).alias("unblocking"), F.lit(v.recovery).alias("recovery"))
