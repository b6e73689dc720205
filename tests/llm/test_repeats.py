import random
from collections import Counter

import pytest

from tidemill.llm.repeats import Plan, cut_repeats

COLUMNS = "doc_id bigint, text string, at int, n string"


def brute(texts, unit, length):
    units = [(t or "").encode().split() if unit == "word" else list((t or "").encode()) for t in texts]
    grams = [[tuple(u[i : i + length]) for i in range(len(u) - length + 1)] for u in units]
    counts = Counter(g for gs in grams for g in gs)
    out = []
    for u, gs in zip(units, grams):
        gone = [False] * len(u)
        for i, g in enumerate(gs):
            if counts[g] > 1:
                gone[i : i + length] = [True] * length
        left = [x for x, g in zip(u, gone) if not g]
        kept = b" ".join(left) if unit == "word" else bytes(left)
        spans = sum(g and not p for g, p in zip(gone, [False] + gone))
        out.append((len(u), sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("unit,length,gram,piece,crowd", [("word", 7, 3, 1 << 20, 4096), ("byte", 40, 25, 1 << 20, 4096), ("byte", 40, 25, 37, 2), ("word", 7, 3, 5, 1)])
def test_matches_brute_force(spark, unit, length, gram, piece, crowd):
    rng = random.Random(5)
    words = ["ab", "c", "déf", "ghij", "k"]
    some = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = [some(n) for n in (8, 12, 30, 60)]
    texts = [None, "", "   ", "a " * 90, "b" * 300, shared[2], shared[2]]
    for _ in range(60):
        texts.append(rng.choice((" ", "\n", "\t ")).join(rng.choice(shared) if rng.random() < 0.4 else some(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6))))
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    found = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut_repeats(spark.createDataFrame(rows, COLUMNS).repartition(3), Plan(unit, length, gram, piece, crowd)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, unit, length)
    assert sum(f[1] for f in found.values()) > 500


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, 0, ""), (1, text, 0, ""), (None, "short", 0, ""), (1, "other words here", 0, "")]
    found = cut_repeats(spark.createDataFrame(rows, COLUMNS), Plan("word", 7, 3)).collect()
    assert sorted((r.n_units, r.n_removed) for r in found) == [(1, 0), (3, 0), (20, 20), (20, 20)]
    assert cut_repeats(spark.createDataFrame([], COLUMNS), Plan("word", 7, 3)).count() == 0


def test_near_copies_that_branch(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = rng.choice("xyz")
        texts.append(" ".join(own[rng.randrange(10) : rng.randrange(40, 60)]))
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    for plan in (Plan("word", 9, 3), Plan("word", 9, 3, crowd=3), Plan("byte", 33, 12, crowd=3), Plan("byte", 33, 12, rounds=1), Plan("byte", 33, 12, crowd=3, rounds=1)):
        found = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut_repeats(spark.createDataFrame(rows, COLUMNS), plan).collect()}
        assert [found[i] for i in range(len(texts))] == brute(texts, plan.unit, plan.length)


def test_polynomial_collisions_remove_nothing(spark):
    """Thue-Morse words of 4,096 letters collide in every polynomial modulo 2^64."""
    a = "".join("xy"[i.bit_count() % 2] for i in range(4096))
    b = "".join("yx"[i.bit_count() % 2] for i in range(4096))
    head = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{head} {a}", 0, ""), (2, f"{head} {b}", 0, ""), (3, f"{a} {head}", 0, ""), (4, f"{b} {head}", 0, "")]
    found = cut_repeats(spark.createDataFrame(rows, COLUMNS), Plan("word", 35, 11)).collect()
    assert [r.n_removed for r in found] == [0] * 4
