import random

import xxhash
from helpers import documents, odd_documents
from pyspark.sql import functions as F

from tally.llm import simhash


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_fingerprints_match_the_definition(spark):
    docs = [r["text"] for r in documents(spark).select("text").collect()]
    for t in [*docs[:60], "", " \n", "One", "one TWO", "a b c", "a b c a b c É é", "x\x85y z\x1cw q"]:
        assert simhash.text_fingerprint(t) == brute_fingerprint(t)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(n=60, seed=5):
    rnd = random.Random(seed)
    fps = []
    for _ in range(n):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(5)):
            fps.append(x)
            for _ in range(rnd.randrange(4)):
                x ^= 1 << rnd.randrange(64)
    return sorted(set(fps))


def test_links_lose_nothing(spark):
    fps = planted()
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for d in (1, 2, 3, 4):
        found = {frozenset((r[0], r[1])) for r in simhash.links(frame, d).collect()}
        want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= d}
        assert found == want, d


def test_links_of_large_variants(spark, monkeypatch):
    """Many fingerprints that share one half: the piece in the join key loses no link."""
    rnd = random.Random(1)
    fps = sorted({(0xABCDEF01 << 32) | rnd.getrandbits(9) << rnd.choice((0, 11, 20)) for _ in range(300)})
    monkeypatch.setattr(simhash, "HOT_VARIANT", 20)
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {frozenset((r[0], r[1])) for r in simhash.links(frame, 2).collect()}
    assert found == {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}


def test_variants_are_never_broadcast(spark):
    """64 rows a fingerprint: the size in the plan is that of the fingerprints."""
    reps = simhash.materialize(spark.range(1000).select(F.xxhash64("id").alias("fp")), "simhash-test")
    plan = simhash.links(reps, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_every_piece_splits_a_hot_variant(spark):
    """Fingerprints that share one half meet in small groups for each piece of the other half."""
    rnd = random.Random(2)
    for shift in (0, 32):
        fps = {rnd.getrandbits(32) << shift | 0x5EED << (32 - shift) for _ in range(3000)}
        v = simhash._variants(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 2)
        hot = v.where(F.col("bit").between(32 - shift, 63 - shift)).select("bit", "rest", F.inline(simhash._pieces(2)))
        most = hot.groupBy("bit", "rest", "piece", "value").count()
        assert most.agg(F.max("count")).first()[0] <= 3000 / 2 ** 10 * 6


def test_components_match_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions near an old stone bridge"
    texts = [base, base.upper(), base + " x", base.replace("fox", "cat"), "", None, " ", "one", "one two", "One", base + "  "]
    texts += [r["text"] for r in documents(spark).select("text").collect()][:80]
    rows = [(100 - i if i != 3 else None, t) for i, t in enumerate(texts)]
    found = simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(fps, 2)
    low = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            low[g] = min(doc_id, low.get(g, doc_id))
    want = sorted(((d, signed(f), low.get(g)) for (d, _), f, g in zip(rows, fps, group)), key=repr)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in found), key=repr) == want
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == len(set(group))
    assert {r["doc_id"] for r in kept} == {low.get(g) for g in group}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = simhash.components(docs)
    assert out.columns == ["doc_id", "fp", "component_id"] and out.count() == docs.count()
    kept = simhash.dedup(docs)
    assert kept.schema == docs.schema
    groups = len(set(brute_components([brute_fingerprint(r["text"]) for r in docs.select("text").distinct().collect()], 2)))
    assert kept.count() == groups
    empty = docs.where("false")
    assert simhash.components(empty).count() == 0 and simhash.dedup(empty).count() == 0
