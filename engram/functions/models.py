"""Injected models: a deterministic embedder for tests and a bounded retry around any callable."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pandas as pd


def hash_embedder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """Unit vectors from hashed words: equal texts get equal vectors, texts that share words are near."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts.fillna(""):
            v = np.zeros(dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out, index=texts.index)

    return embed


def with_retry(call: Callable, attempts: int = 5, first: float = 0.2, most: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` repeated on errors with doubling pauses between ``first`` and ``most`` seconds."""

    def run(*a, **k):
        for i in range(attempts):
            try:
                return call(*a, **k)
            except Exception:
                if i + 1 == attempts:
                    raise
                sleep(min(first * 2**i, most))

    return run
