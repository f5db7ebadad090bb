import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import lm_scoring as lm
from tests.llm.helpers import clashing, documents, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return [*WORD.findall(lower(text)), None]


def probability(counts, context, symbol):
    excluded, p = set(), 1.0
    for order in range(len(context), -1, -1):
        seen = counts.get(context[len(context) - order :])
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        whole = sum(left.values()) + len(left)
        if symbol in left:
            return p * left[symbol] / whole
        if whole:
            p *= len(left) / whole
        excluded |= set(seen)
    return p / (256 - len(excluded))


def brute(rows):
    held_out = [zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2 for k, _ in rows]
    words, counts = Counter(), defaultdict(Counter)
    raw = [b"\xff" * 5 + lower(t).encode() + b"\xff" for _, t in rows]
    for (_, t), r, held in zip(rows, raw, held_out):
        if not held:
            words.update(tokens(t))
            for i in range(5, len(r)):
                for order in range(6):
                    counts[r[i - order : i]][r[i]] += 1
    n, v = sum(words.values()), len(words)
    for (_, t), r, held in zip(rows, raw, held_out):
        own = tokens(t)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        score = sum(math.log10(probability(counts, r[i - 5 : i], r[i])) for i in range(5, len(r)))
        yield held, len(own), sum(words[w] > 0 for w in own), n, base, score


def check(spark, texts):
    rows = sorted(lm.score_documents(clashing(documents(spark, texts))).collect())
    assert len(rows) == len(texts)
    for got, want in zip(rows, brute(list(enumerate(texts))), strict=True):
        assert tuple(got)[1:5] == want[:4]
        assert tuple(got)[5:] == pytest.approx(want[4:], rel=1e-9)
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = odd_texts() + [prose(rng, rng.randrange(80), 60) for _ in range(40)]
    rows = check(spark, texts)
    known = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert known and all(r.score > 3 * r.base_score for r in known)
    monkeypatch.setattr(lm, "BATCH", 2000)  # many batches
    monkeypatch.setattr(lm, "PART", 777)  # and many parts of long texts
    check(spark, texts)


def test_repeated_and_null_keys(spark):
    texts = ["alpha beta", "alpha beta", "alpha gamma", None, "beta"]
    keys = [5, 5, 5, None, None]
    docs = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    rows = [tuple(r)[1:] for r in lm.score_documents(docs).collect()]
    want = list(brute(list(zip(keys, texts, strict=True))))
    assert sorted(r[:4] for r in rows) == sorted(w[:4] for w in want)
    assert sorted(r[5] for r in rows) == pytest.approx(sorted(w[5] for w in want))


def test_without_training_documents(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = documents(spark, ["a b"] * (held + 1)).filter(f"doc_id = {held}")
    row = lm.score_documents(docs).collect()[0]
    assert row.train_tokens == 0 and row.base_score == 0 and row.score == pytest.approx(-4 * math.log10(256))
    assert lm.score_documents(docs.limit(0)).count() == 0
