"""The language scorer on long texts: sums by steps against a plain loop, and bounded memory."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from corpusmill.llm import language_id


def score(model, texts):
    return language_id.text_scores(SimpleNamespace(value=model)).func(pd.Series(texts))


def test_steps_against_a_loop(monkeypatch):
    rng = random.Random(1)
    model = np.random.default_rng(2).normal(size=(5, language_id.BUCKETS)).astype(np.float32)
    texts = ["", None, "a", "ab", "abc", "  \n 12", "é", "日本語", *("".join(rng.choice("abé 中\n1") for _ in range(rng.randint(0, 90))) for _ in range(60))]
    expected = []
    middle = model.mean(axis=0)
    for t in texts:
        b = np.frombuffer((t or "").encode(), dtype=np.uint8)
        bucket = language_id.trigram_buckets(b) if len(b) > 2 else np.zeros(0, dtype=np.int32)
        bucket = bucket[bucket >= 0]
        scale = min(0.3 * len(bucket), 150.0) / max(len(bucket), 1)
        expected.append([float((row - middle)[bucket].sum(dtype=np.float64)) * scale for row in model] if len(bucket) else None)
    for step in (3, 7, 50, 1 << 18):
        monkeypatch.setattr(language_id, "STEP_BYTES", step)
        for got, want in zip(score(model, texts), expected, strict=True):
            assert (got is None) == (want is None)
            assert want is None or np.allclose(got, want, atol=1e-6)


def test_long_text_with_many_languages():
    """50 MB and 50 languages: no more is held than a few steps besides the text and the model."""
    model = np.random.default_rng(3).normal(size=(50, language_id.BUCKETS)).astype(np.float32)
    text = "the words of a long text " * 2_000_000
    tracemalloc.start()
    got = score(model, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got[0]) == 50
    assert peak < 200e6
