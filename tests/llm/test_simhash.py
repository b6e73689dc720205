import random

import xxhash
from pyspark.sql import functions as F

from tidemill.llm import simhash

COLUMNS = "doc_id bigint, text string, fp string"


def brute(text):
    words = (text or "").lower().split(" ") if (text or "").strip() else []
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(fps):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_brute_force():
    for text in ("", "one", "one two", "a b c", "The cat sat on the mat and the cat sat", "x " * 500):
        assert simhash.fingerprint(text.encode()) == brute(text)


def test_links_close_to_the_same_groups(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(30):
        seed = rng.getrandbits(64)
        fps.append(seed)
        for _ in range(rng.choice((0, 2, 40))):
            x = rng.choice(fps[-5:])
            for _ in range(rng.choice((1, 2, 3))):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from tidemill.llm.graph import components
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(table)).collect()}
    got, want = [found.get(s, s) for s in signed], closed(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d", None), (3, "a b c d", None), (None, "a b c d", "z"), (5, "w " * 3000, "q")]
    found = simhash.groups(spark.createDataFrame(rows, COLUMNS)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in found] == [(None, 3), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5)]
    assert simhash.groups(spark.createDataFrame([], COLUMNS)).count() == 0


def test_the_pivot_table_discards_and_loses_nothing(spark):
    """Fingerprints that agree in 32 bits and differ at random in the others: pairs to look at, few to verify."""
    rng = random.Random(5)
    fps = []
    for _ in range(150):
        high = rng.getrandbits(32) << 32
        fps += [high | rng.getrandbits(32) for _ in range(8)]
        fps.append(fps[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    pairs = simhash.candidates(table)
    before, after = pairs.select("a", "b").distinct().count(), simhash.pruned(pairs).select("a", "b").distinct().count()
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    found = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(table).collect()}
    assert found == want and before > 4000 and len(want) <= after < before / 10


def test_groups_equal_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))) for _ in range(25)]
    texts = [None, "", " \n "] + base
    for _ in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = "x"
        texts.append(rng.choice((" ", "\t")).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    found = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], COLUMNS)).collect()}
    want = closed([brute(" ".join((t or "").split())) for t in texts])
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) < len(texts) - 60
