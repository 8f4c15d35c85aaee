"""SimHash fingerprints and links against brute force."""

import random
import re

import xxhash

from corpuslab.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [f"Word{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one TWO", "É ß 日本"]
    for _ in range(6):
        words = [rng.choice(base) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(words))
        for _ in range(5):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            texts.append("\t".join(near))
    texts += [texts[6]] * 5
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: (r.h, r.component_id) for r in simhash.near_duplicates(docs).withColumn("h", simhash.hex_fingerprint()).collect()}
    prints = [brute_print(t) for t in texts]
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints), strict=True))}


def test_links_in_small_and_large_buckets(spark):
    """More different fingerprints in a bucket than are paired take the linear way; reachability is the same."""
    rng = random.Random(5)
    center, prints = rng.getrandbits(64), set()
    while len(prints) < 500:
        value = center
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            value ^= 1 << bit
        prints.add(value)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    for value in list(prints)[:20]:
        prints.add(value ^ 3)
    prints = sorted(prints)
    rows = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "node long, fp long")
    links = [(r.a, r.b) for r in simhash.links(rows, "node").collect()]
    assert all(0 < (prints[a] ^ prints[b]).bit_count() <= 2 for a, b in links)
    parent = list(range(len(prints)))
    for _ in range(len(prints)):
        before = list(parent)
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
        if before == parent:
            break
    assert parent == brute_components(prints)


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "x y z")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 4), (2, 2), (4, 4), (4, 4)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_text():
    text = " ".join(f"w{i % 1000}" for i in range(100_000))
    assert simhash.fingerprint(text) == brute_print(text)


def test_carried_columns(spark):
    docs = spark.createDataFrame([(2, "a b c", "x"), (1, "A b c", None), (None, None, "y")], "doc_id long, text string, note string")
    rows = simhash.near_duplicates(docs, carry=["note"]).collect()
    assert sorted(((r.doc_id, r.component_id, r.note) for r in rows), key=str) == [(1, 1, None), (2, 1, "x"), (None, None, "y")]
