import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lexical_search as s
from tests.llm.helpers import clashing, documents, odd_texts, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, top=s.TOP):
    """(item, rank, document, score); documents are numbered, a document's number being its id."""
    docs = {i: Counter(own) for i, t in enumerate(texts) if (own := terms(t))}
    n, total = len(docs), sum(sum(d.values()) for d in docs.values())
    df = Counter(t for d in docs.values() for t in d)
    out = []
    for item, text in items:
        scores = []
        for i, d in docs.items():
            m = 100 - 25 + 25 * sum(d.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * d[t] // (1000 * d[t] + 12 * m)) for t in terms(text) if t in d)
            scores.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:top], 1)]
    return sorted(out)


def case():
    rng = random.Random(11)
    texts = odd_texts() + ["A-b_c'd e.f 9 99 漢字 é É", "tie w1", "tie w1", "w1 tie", "\x7f~^", "a" * 300, "a" * 299] + [prose(rng, rng.randrange(1, 200), 60) for _ in range(150)]
    items = [(f"i{i}", prose(rng, rng.randrange(1, 30), 80)) for i in range(30)]
    items += [("tie", "TIE tie"), ("none", "nowhere"), ("blank", " ,;"), ("long", "a" * 300), ("odd", "漢字 É é 9"), ("same", "one"), ("same", "w1")]
    return texts, items


def rows(spark, texts, items, **options):
    table = spark.createDataFrame(items, "item_id string, text string")
    return sorted(map(tuple, s.search(clashing(documents(spark, texts)), table, **options).collect()))


def test_matches_brute_force(spark):
    texts, items = case()
    assert rows(spark, texts, [*items, ("null", None)]) == brute(texts, items)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    texts, items = case()
    monkeypatch.setattr(s, "SORTED", 50)
    assert rows(spark, texts, items, block_bytes=700, top=3) == brute(texts, items, 3)
    index = s.Index([t.encode() for _, t in items])
    counts, found = index.postings([(t or "").encode() for t in texts])
    lengths, held = np.array(counts, np.int64), [np.frombuffer(b"".join(c), np.int32).astype(np.int64) for c in zip(*found, strict=True)]
    owner = np.repeat(np.arange(len(texts)), [len(t) // 4 for t, _ in found])
    weight = np.ones(len(index.words), np.int64)
    pairs = lambda: sorted(tuple(map(int, r)) for x in s._matches(index, weight, 150, int(lengths.sum()), lengths, owner, *held) for r in zip(*x, strict=True))
    small = pairs()
    monkeypatch.setattr(s, "SORTED", 1 << 22)
    assert small == pairs() and len(small) > 1000


def test_radix_and_heaps():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 37, 5000).astype(np.uint64) & np.uint64(0x1F0000FFF)
    assert (keys[s.radix_order(keys, 37)] == np.sort(keys)).all()
    heaps, every = s.Heaps(4, 5), []
    for _ in range(30):
        q, d, score = np.sort(rng.integers(0, 4, 60)), rng.integers(0, 10**6, 60), rng.integers(0, 9, 60)
        heaps.offer(q, d, score)
        every += zip(q.tolist(), d.tolist(), score.tolist(), strict=True)
    for q in range(4):
        assert sorted((-x, d) for o, d, x in heaps.rows() if o == q) == sorted((-x, d) for o, d, x in every if o == q and x > 0)[:5]


def test_equal_hashes_are_told_apart():
    index = s.Index([b"alpha beta", b"beta"])
    assert index.words == [b"alpha", b"beta"]
    index.odd = {b"alpha": 0}  # as if both words had one hash
    index.table = s.hashing.Table(2)
    own = s.Terms([b"alpha beta gamma"])
    index.table.add(own.hashes[:2], np.array([1, 1]))
    assert [x.tolist() for x in index.find(own)] == [[0, 1], [0, 1]]


def test_keys_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "x y"), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x"), (5, "x"), (5, "x"), (None, "x"), (2, None)], "doc_id long, text string")
    got = [(r.rank, r.doc_id) for r in sorted(s.search(docs, items).collect(), key=lambda r: (r.item_id or 0, r.rank))]
    assert got == [(1, 5), (2, 5), (3, None), (4, None)] * 2
    assert s.search(documents(spark, []), items).count() == 0 == s.search(docs, items.limit(0)).count()
