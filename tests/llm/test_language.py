import itertools
import math
import random

import numpy as np

from tidemill.llm import language
from tidemill.llm.language import Lattice

COLUMNS = "doc_id bigint, text string, lang string, score string"


def test_forward_sums_all_segmentations():
    vocabulary = ("▁a", "a", "b", "ab", "▁ab", "ba", "bab", "▁")
    rng = np.random.default_rng(1)
    chance = np.vstack((rng.random((len(vocabulary), 2)), np.zeros((1, 2))))

    def brute(word, k):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at, value = 0, 1.0
            for end in [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]:
                piece = word[at:end]
                value *= (chance[vocabulary.index(piece), k] if piece in vocabulary else 0) + (language.UNKNOWN if end - at == 1 else 0)
                at = end
            total += value
        return math.log(total)

    words = ["▁a", "▁abab", "▁babab", "xab", "▁bé"]
    got = Lattice(vocabulary).forward(words, chance)
    assert np.allclose(got, [[brute(w, k) for k in range(2)] for w in words])


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(9)
    stems = {"en": ("the", "ing", "tion", "and", "wh", "er"), "de": ("sch", "ung", "die", "ich", "ein", "ver"), "fr": ("eau", "que", "ment", "les", "oi", "é")}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang, ""))
    rows += [(700, None, "en", ""), (701, "", "en", ""), (702, "123 !?", "en", ""), (None, "theingtion", None, ""), (704, "ver" * 3000, None, ""), rows[0]]
    docs = spark.createDataFrame(rows, COLUMNS)
    found = language.predict(docs, language.learn(docs)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" for i in (700, 701, 702)) and by[None].lang_pred == "en" and by[704].lang_pred == "de"
    right = sum(by[i].lang_pred == lang for i, _, lang, _ in rows[:600])
    assert right >= 590 and all(0 <= r.score <= 1 for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert language.predict(docs, language.learn(docs)).count() == 0
    docs = spark.createDataFrame([(1, "abc", None, "")], COLUMNS)
    assert language.predict(docs, language.learn(docs)).first().lang_pred == "und"


def test_learning_equals_brute_force(spark):
    """One step of expectation and maximisation over all segmentations of each word, written out."""
    rows = [(1, "aba ab ba", "x", ""), (3, "ab abab", "x", ""), (4, "ba", "y", ""), (9, "bab ab", "y", "")]
    rows = [r for r in rows if not __import__("zlib").crc32(str(r[0]).encode()) % 4 == 2]
    model = language.learn(spark.createDataFrame(rows, COLUMNS))
    vocabulary = language.pieces(model.path)
    place = {p: i for i, p in enumerate(vocabulary)}
    for k, lang in enumerate(model.languages):
        words = {}
        for _, text, own, _ in rows:
            for w in language.words_of(text) if own == lang else ():
                words[w] = words.get(w, 0) + 1
        chance = np.full(len(vocabulary), 1 / len(vocabulary))
        for _ in range(language.STEPS):
            used = np.full(len(vocabulary), language.PRIOR)
            for word, n in words.items():
                ways = []
                for cuts in itertools.product((0, 1), repeat=len(word) - 1):
                    ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
                    parts = [word[a:b] for a, b in zip([0, *ends], ends)]
                    if all(p in place or len(p) == 1 for p in parts):
                        ways.append((parts, math.prod((chance[place[p]] if p in place else 0) + language.UNKNOWN * (len(p) == 1) for p in parts)))
                total = sum(v for _, v in ways)
                for parts, value in ways:
                    for p in parts:
                        if p in place:
                            share = chance[place[p]] / (chance[place[p]] + language.UNKNOWN * (len(p) == 1))
                            used[place[p]] += n * value / total * share
            chance = used / used.sum()
        assert np.allclose(model.chance[:-1, k], chance, rtol=1e-6)
