import hashlib
import random
from collections import Counter

from tessera.llm import substring_dedup as s
from tests.llm.helpers import clashing, documents, odd_texts, prose


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def case():
    rng = random.Random(9)
    passage = [prose(rng, n, 9999) for n in (70, 90, 400)]
    exact = prose(rng, 300, 9999)[:400]
    texts = odd_texts() + [exact, exact + "x", "y" + exact[:399], exact[:399], passage[2] + passage[2], "ab" * 600, "é" * 500]
    for _ in range(60):
        parts = [prose(rng, rng.randrange(120), 9999)]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passage)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(300, len(p))], prose(rng, rng.randrange(80), 9999)]
        texts.append(" ".join(parts))
    for _ in range(6):  # near copies
        words = passage[2].split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    return texts


def test_cover_is_a_difference_cover():
    assert all({(a - b) % period for a in cover for b in cover} == set(range(period)) for period, cover in s.COVERS.items())
    assert s.period_of(400) == 273 and s.period_of(300) == 183


def test_matches_brute_force(spark):
    texts = case()
    rows = sorted(s.repeated_substrings(clashing(documents(spark, texts))).collect())
    assert [tuple(r)[1:] for r in rows] == brute(texts)
    rows = sorted(s.repeated_substrings(documents(spark, texts), 300).collect())
    assert [tuple(r)[1:] for r in rows] == brute(texts, 300)
    kept = s.remove_repeated(clashing(documents(spark, texts)))
    assert kept.columns == clashing(documents(spark, [])).columns
    left = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
    assert len(left) == len(texts) and left[0] is None and left[6] == "" and left[3] == "one"


def test_empty_and_small_tables(spark):
    assert s.repeated_substrings(documents(spark, [])).count() == 0
    rows = s.repeated_substrings(documents(spark, ["short", None])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 0, 0), (5, 0, 0)]
