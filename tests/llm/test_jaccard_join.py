import random
import re

import numpy as np

from tessera.llm import jaccard_join as j
from tests.llm.helpers import clashing, documents, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def case():
    rng = random.Random(11)
    texts = odd_texts() + ["a b c d", "A b c d", "a b c d e", "Ä b c d"]
    passages = [prose(rng, 60, 5000) for _ in range(3)]
    for _ in range(12):
        base = prose(rng, rng.randrange(20, 200), 3000).split()
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(copy) + (" " + rng.choice(passages) if rng.random() < 0.3 else ""))
    texts += [prose(rng, 20, 9999) + " " + passages[0] for _ in range(30)]
    return texts


def test_matches_brute_force(spark):
    texts = case()
    want = brute(texts)
    docs = clashing(documents(spark, texts))
    # defaults; few frequent shingles told apart; nearly all frequent, and clusters cut into blocks
    for options in ({}, {"dense": 4}, {"dense": 4, "most_dense": 50}, {"dense": 1, "block": 300}):
        rows = sorted(j.jaccard_components(docs, **options).collect())
        assert [(r.n_shingles, r.component_id) for r in rows] == want, options
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want}


def test_clusters_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.4], rng.integers(0, 1 << 60, rng.integers(1, 8)).astype(np.uint64)])) for _ in range(40)]
        label = list(range(len(sets)))
        for links in (j.join_cluster(sets),):
            for a, b in links:
                label = [label[a] if x == label[b] else x for x in label]
        want = list(range(len(sets)))
        for a in range(40):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    want = [want[a] if x == want[b] else x for x in want]
        assert [label.index(x) for x in label] == [want.index(x) for x in want]


def test_every_link_is_counted(spark):
    rng = random.Random(8)
    bases = [prose(rng, 90, 9999) for _ in range(4)]
    texts = [None, "", "x", "x"] + bases * 2
    for base in bases[:3] * 6:  # near copies link with their base, but not all with each other
        copy = base.split()
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    want = [sum(a != b and bool(s) and 100 * len(s & t) >= 75 * len(s | t) for b, t in enumerate(sets)) for a, s in enumerate(sets)]
    assert len(set(want)) > 4
    rows = j.jaccard_components(documents(spark, texts), block=300).collect()
    assert {r.doc_id: r.n_links for r in rows} == dict(enumerate(want))
    nulls = documents(spark, texts).selectExpr("CAST(NULL AS bigint) AS doc_id", "text")
    assert sorted(r.n_links for r in j.jaccard_components(nulls).collect()) == sorted(want)


def test_empty_table(spark):
    assert j.jaccard_components(documents(spark, [])).count() == 0
