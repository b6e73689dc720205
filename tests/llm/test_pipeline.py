import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import neardup

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark int"


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [rows[find(i)][0] for i in range(len(rows))]


def test_near_groups_match_brute_force(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", "one two", "one  two", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(20, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 1, 3, 30))):
            other = list(base)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in rows], COLUMNS)
    found = {r.doc_id: r.first_id for r in neardup.near_groups(docs).collect()}
    assert [found[i] for i, _ in rows] == brute_groups(rows)
    kept = sorted(r.doc_id for r in neardup.drop_near(docs).collect())
    assert kept == sorted(set(brute_groups(rows)))


def test_stages_keep_columns_and_rows_that_should_stay(spark, tmp_path):
    rng = random.Random(13)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(12)) for _ in range(n))
    item = " ".join(f"b{i}" for i in range(40))
    rows = [(i, text(10), "en", "s", 0, 0) for i in range(250)]
    rows.append((300, rows[0][1] + "\nextra", "en", "s", 0, 0))  # a copy but for a line
    rows.append((301, text(4) + "\n" + item + "\n" + text(4), "en", "s", 0, 0))  # leaked
    rows.append((302, "too short", None, None, None, None))
    rows.append((303, " ".join(w + "$$$" for w in text(8).split()), "en", "s", 0, 0))
    rows.append((None, text(9), "en", "s", 0, 0))
    rows.append(rows[7])  # a row twice
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == given, name
    rows_left = docs.collect()
    kept = {r.doc_id: r.text for r in rows_left}
    assert len(rows_left) == len(kept) + 1 and set(kept) == set(range(250)) | {300, None} and kept[300] == "extra"
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == set(kept) and all(r.round_trip for r in found)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(50000)}"
    base, letter, texts = [word() for _ in range(200)], [word() for _ in range(109)], []
    for _ in range(400):
        other = list(base)
        for at in rng.sample(range(200), rng.randrange(5)):
            other[at] = word()
        texts.append(" ".join(other))
    for i in range(150):  # form letters, just under the similarity, and some pairs over it
        own = [word() for _ in range(15)]
        texts.append(" ".join(letter + own))
        if i % 10 == 0:
            texts.append(" ".join(letter + own[:8] + [word() for _ in range(7)]))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in enumerate(texts)], COLUMNS)
    found = {r.doc_id: r.first_id for r in neardup.near_groups(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute_groups(list(enumerate(texts)))


def test_simhash_links_settle_groups_without_buckets(spark, monkeypatch):
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(50000)}"
    texts = ["", "a b", "c d"]
    for _ in range(25):
        base = [word() for _ in range(800)]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 1, 2, 20))):
            at = rng.randrange(len(base))
            base = base[:at] + [word()] + base[at + 1 :] if rng.randrange(2) else base + [word()]
            texts.append(" ".join(base))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in enumerate(texts)], COLUMNS)
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in neardup._sketches(docs).select("doc_id", "fp").collect()}
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles(texts[i]), shingles(texts[j])
            if a and b and (fps[i] ^ fps[j]).bit_count() <= 2 and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((want[i], want[j]))
                want = [x if w == y else w for w in want]
    assert len(set(want)) < len(texts) - 40
    bare = neardup._sketches
    marked = F.when(F.size("keys") > 0, F.array(F.hash("doc_id").cast("bigint"))).otherwise(F.col("keys"))
    monkeypatch.setattr(neardup, "_sketches", lambda d: bare(d).withColumns({"keys": marked}))
    found = {r.doc_id: r.first_id for r in neardup.near_groups(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_near_groups_bounds_what_the_driver_holds(spark, monkeypatch):
    """Memory goes back after each round, and no plan of the SimHash pairs holds all of operator 3's exchanges."""
    rng = random.Random(16)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(6)]
    texts = [" ".join(b[:at] + [f"v{rng.randrange(5000)}"] + b[at + 1 :]) for b in bases for at in range(0, 40, 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in enumerate(texts)], COLUMNS)
    steps, real, free = [], neardup.written, neardup.release
    monkeypatch.setattr(neardup, "written", lambda df, name: (steps.append(name), real(df, name))[1])
    monkeypatch.setattr(neardup, "release", lambda s: (steps.append("release"), free(s))[1])
    found = {r.doc_id: r.first_id for r in neardup.near_groups(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute_groups(list(enumerate(texts)))
    rounds = steps.count("pairs") - 1
    assert rounds >= 2
    assert steps.count("release") >= rounds + 2
    pairs = neardup._simhash_pairs(real(neardup._sketches(docs).select("tid", "fp", "keys"), "texts"))
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 8
