import random
import re
from collections import Counter

from tidemill.llm import quality

COLUMNS = "doc_id bigint, text string, lang string, source string, kept string"


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    many = Counter(windows)
    gone = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(gone)


def test_base_counts():
    rng = random.Random(4)
    texts = ["", " \n ", "a a a a", "a b c a b c", "é#\x0b|ü\n\nx\nx\r\nx", "𝄞 <b> x"]
    texts += [rng.choice(" \n").join(rng.choice(("a", "b", "ñ", "c\nc", "#")) for _ in range(rng.randrange(40))) for _ in range(200)]
    for text in texts:
        assert quality.counts(text.encode()) == brute(text)


def test_outliers_are_rejected(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 400))]
        if i % 30 == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), ("en", None)[i % 2], "s", ""))
    rows += [(2000, None, "en", "s", ""), (2001, "", None, None, ""), (2002, "x " * 60, "en", "s", ""), (2003, " ".join(vocabulary[500:700]), "xx", "rare", ""), (None, " ".join(vocabulary[1500:1600]), "en", "s", "")]
    rows += [rows[1]]
    found = quality.judge(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 2000:
            assert r.kept == (r.doc_id % 30 != 0), r
    kept = {r.doc_id: (r.kept, r.base_failed) for r in found}
    assert kept[2000] == kept[2001] == kept[2002] == (False, True)
    assert kept[2003] == kept[None] == (True, False)


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], COLUMNS)).count() == 0


def test_estimate_equals_brute_force(spark):
    """The least determinant over all subsets that hold the core share of a small group."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    rows, want = [], {}
    for group in ("a", "b", "c"):
        x = rng.normal(0, 1, (12, 5)) @ rng.normal(0, 1, (5, 5))
        x[:3] += 25
        rows += [(group, v.tolist()) for v in x]
        wide = np.diag(np.square(quality.FLOOR))
        want[group] = min((np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) + wide)[1], s) for s in itertools.combinations(range(12), 9))
        want[group] = x[list(want[group][1])].mean(axis=0)
    found = quality.estimates(spark.createDataFrame(rows, "group string, x array<double>"), spark.createDataFrame([(g, None) for g in "abc"], "group string, parent string"), 3).collect()
    assert len(found) == 3 and all(np.allclose(r["mean"], want[r["group"]]) for r in found)


def test_small_groups_lean_on_their_language(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(100, 300))), "en", f"s{i % 7}", "") for i in range(420)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "##" for _ in range(150)), "en", "tiny", "") for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(kept[i] for i in range(420)) and not any(kept[1000 + i] for i in range(3))
