import zlib

from tessera.llm import sharding
from tests.llm.helpers import clashing, documents, odd_texts, prose


def check(rows, texts, shards):
    held, slots, size_of = {}, {}, {}
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        held[r.shard] = held.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        size_of.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(held) <= set(range(shards))
    return held, size_of


def test_bytes_are_near_equal(spark):
    import random

    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(3000)] + ["hot " * 30] * 1500 + ["pair one"] * 2
    rows = sharding.shard_by_bytes(clashing(documents(spark, texts)), 8).collect()
    held, of = check(rows, texts, 8)
    mean = sum(held.values()) / 8
    assert len(held) == 8 and all(abs(h - mean) < 0.02 * mean for h in held.values())
    assert len(of[zlib.crc32(b"pair one")]) == 1
    again = sharding.shard_by_bytes(documents(spark, texts), 8).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in rows}


def brute(rows, shards):
    """(id, size, crc, shard, slot) of records (id, size, crc, k1, k2) laid end to end in key order, one by one."""
    rows = sorted(rows, key=lambda r: (r.k1, r.k2, r.id, r.crc))
    quota, end, place, groups = sum(r["size"] for r in rows) / shards, 0, [], {}
    for r in rows:
        end += r["size"]
        place.append(end - r["size"] / 2)
        groups.setdefault(r.k1, []).append(len(place) - 1)
    shard = [min(int(at // quota), shards - 1) for at in place]
    for own in groups.values():
        if shard[own[0]] != shard[own[-1]] and sum(rows[i]["size"] for i in own) <= sharding.KEEP_WHOLE * quota:
            whole = min(int((place[own[0]] + place[own[-1]]) / 2 // quota), shards - 1)
            for i in own:
                shard[i] = whole
    filled, out = {}, []
    for r, s in zip(rows, shard, strict=True):
        out.append((r.id, r["size"], r.crc, s, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + 1
    return sorted(out)


def test_matches_brute_force(spark, sf):
    import random

    rng = random.Random(5)
    drawn = documents(spark, [prose(rng, rng.randrange(1, 60)) for _ in range(2000)] + ["hot " * 30] * 900 + ["few"] * 40 + odd_texts())
    for docs, shards in ((drawn, 7), (spark.read.parquet(f"{sf}/documents.parquet"), 40)):
        rows = sharding.shard_by_bytes(docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert sorted(map(tuple, rows)) == brute(sharding._records(docs, "doc_id", "text").collect(), shards)


def test_odd_rows(spark):
    check(sharding.shard_by_bytes(documents(spark, odd_texts())).collect(), odd_texts(), 40)
    assert sharding.shard_by_bytes(documents(spark, [])).count() == 0
    twice = documents(spark, ["a", None]).union(documents(spark, ["a", None]))
    assert sharding.shard_by_bytes(twice, 2).count() == 4
