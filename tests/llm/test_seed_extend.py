import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm import seed_extend as s
from tests.llm.helpers import clashing, documents, odd_texts, prose


def brute(texts, window=s.WINDOW):
    words = [(t or "").encode().split() for t in texts]
    grams = [[tuple(w[i : i + window]) for i in range(len(w) - window + 1)] for w in words]
    seen = Counter(g for own in grams for g in own)
    out = []
    for w, own in zip(words, grams, strict=True):
        gone = [False] * len(w)
        for i, g in enumerate(own):
            if seen[g] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def case():
    rng = random.Random(12)
    passages = [prose(rng, n, 9999) for n in (34, 35, 36, 80, 300)]
    texts = [*odd_texts(), *passages, passages[1], "x " + passages[2], passages[3] + " " + passages[3], "a b " * 60, "Case " + passages[1].upper(), passages[1].replace(" ", " "), passages[4].replace(" ", "\x0b\n")]
    for _ in range(80):
        parts = [prose(rng, rng.randrange(60), 9999)]
        for _ in range(rng.randrange(4)):
            own = rng.choice(passages).split()
            a = rng.randrange(max(len(own) - 30, 1))
            parts += [" ".join(own[a : a + rng.randrange(20, 120)]), prose(rng, rng.randrange(40), 9999)]
        texts.append(" ".join(parts))
    for _ in range(20):  # near copies
        words = passages[4].split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"other{rng.randrange(3)}"
        texts.append(" ".join(words))
    return [*texts, *texts[-25:-18]]


def test_least_is_the_rightmost():
    rng = np.random.default_rng(3)
    for n, width in ((0, 4), (3, 4), (4, 4), (50, 1), (200, 28), (90, 33)):
        hashes = rng.integers(0, 9, n).astype(np.uint64)
        want = [max(range(i, i + width), key=lambda j: (-int(hashes[j]), j)) for i in range(n - width + 1)]
        assert s.least_of(hashes, width).tolist() == want


def test_matches_brute_force(spark):
    texts = case()
    rows = sorted(s.repeated_passages(clashing(documents(spark, texts))).collect())
    assert [tuple(r)[1:4] for r in rows] == brute(texts)
    for r in rows:
        assert sum(x.words for x in r.spans) == r.n_removed and all(x.words >= s.WINDOW for x in r.spans)
        assert all(a.first + a.words < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))
    rows = sorted(s.repeated_passages(documents(spark, texts), 12, 5).collect())
    assert [tuple(r)[1:4] for r in rows] == brute(texts, 12)


def test_many_copies_and_common_grams(spark):
    rng = random.Random(4)
    common = prose(rng, 20, 9999)
    copy, near = prose(rng, 200, 9999), prose(rng, 120, 9999).split()
    texts = [copy] * 300 + [f"{prose(rng, 40, 9999)} {common} {prose(rng, 40, 9999)}" for _ in range(200)]
    texts += [" ".join([*near[: i % 120], f"n{i}", *near[i % 120 + 1 :]]) for i in range(300)]
    rows = sorted(s.repeated_passages(documents(spark, texts)).collect())
    assert [tuple(r)[1:4] for r in rows] == brute(texts)


def test_keys_and_empty_tables(spark):
    text = " ".join(map(str, range(60)))
    rows = spark.createDataFrame([(None, text), (None, text), (3, None), (3, ""), (4, text + " more")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in s.repeated_passages(rows).collect())
    assert got == [(0, 60, 60), (0, 60, 60), (3, 0, 0), (3, 0, 0), (4, 61, 60)]
    assert s.repeated_passages(documents(spark, [])).count() == 0
