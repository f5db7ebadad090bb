import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality
from tests.llm.helpers import clashing, documents, odd_texts


def brute(words):
    """(words in repeated 8-word windows, covered words, longest repeat) from all pairs of suffixes."""
    n, places = len(words), defaultdict(list)
    for i in range(n - 7):
        places[tuple(words[i : i + 8])].append(i)
    eight = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    covered, longest = set(), 0
    for p in places.values():
        for i in p:
            best = 0
            for j in p:
                k = 0
                while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
            longest = max(longest, best)
            if best >= quality.LEAST_REPEAT:
                covered.update(range(i, i + best))
    return len(eight), len(covered), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), min_size=1, max_size=5))
def test_repeats_match_brute_force(docs):
    got = list(zip(*(x.tolist() for x in quality.repeats(docs)), strict=True))
    assert got == [brute(d) for d in docs]


def test_long_repeats():
    rng = random.Random(3)
    passage = [b"p%d" % rng.randrange(50) for _ in range(90)]
    docs = [passage + [b"x"] + passage[10:70], [b"z"] * 300, []]
    got = list(zip(*(x.tolist() for x in quality.repeats(docs)), strict=True))
    assert got == [brute(d) for d in docs]


def test_rows(spark):
    rows = {r.doc_id: r for r in quality.with_quality(clashing(documents(spark, odd_texts()))).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert rows[11].n_dup_lines == 2 and rows[5].n_symbols == 2 and rows[5].word_chars == 12
    assert rows[6].kept and rows[9].kept and not rows[10].kept and rows[10].n_repeat_words == 900
    assert quality.with_quality(documents(spark, [])).count() == 0
    kept = quality.keep_good(clashing(documents(spark, odd_texts())))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept} and "shard" in kept.columns
