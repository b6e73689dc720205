import math
import random
import zlib

from tidemill.llm import toxicity

COLUMNS = "doc_id bigint, text string, score string"


def test_folding():
    assert toxicity.fold("Ідіот 1D10T! í-d.i0t 2024 st@r") == f" {toxicity.fold('Ідіот').strip()} idiot i d iot 2024 star "
    assert toxicity.fold("") == "  " and toxicity.fold("а5s") == " ass "


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(8)
    vocabulary = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    docs, labels = [], []
    for i in range(1200):
        words, toxic = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))], int(rng.random() < 0.2)
        for _ in range(rng.randrange(2, 5) * toxic):
            words[rng.randrange(len(words))] = rng.choice(("scumbag", "sc0wler", "Dolt", "dоlt"))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, toxic, "y"))
    docs += [(5000, None, ""), (5001, "", ""), (5002, "see the bin", ""), (None, "dolt", ""), (docs[0][0], docs[0][1], "again"), (5003, "dolt " * 4000, "")]
    labels += [(None, 1, ""), (7, None, ""), (99999, 1, "")]
    found = toxicity.score(spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id bigint, toxic int, score string")).collect()
    assert len(found) == len(docs)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in found if r.held_out and r.doc_id < 5000]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in found}
    assert by[5000].score == by[5001].score and by[5000].predicted == 0 and by[5003].predicted == 1


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score(spark.createDataFrame([(1, "a b", "")], COLUMNS), labels).collect()] == [0]
    assert toxicity.score(spark.createDataFrame([], COLUMNS), labels).count() == 0


def test_exception_phrases():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " tras": 2.0}, ("trash can",))
    machine = lexicon.automaton()
    assert toxicity.Lexicon.measure(toxicity.fold("Trash and the trash can."), machine) == (3.0, 3.0, 5)


def test_learned_exception_turns_a_verdict(spark):
    rng = random.Random(12)
    vocabulary = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        words, toxic = [rng.choice(vocabulary) for _ in range(30)], int(i % 3 == 0)
        words.insert(rng.randrange(30), "you trash" if toxic else "trash can" if rng.random() < 0.15 else "quiet")
        docs.append((i, " ".join(words), ""))
        labels.append((i, toxic))
    frames = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    lexicon = toxicity.learn(*frames)
    assert " trash " in lexicon.weights and "trash can" in lexicon.exceptions
    both = [(1, "wortaa wortba trash can wortca", ""), (2, "wortaa wortba trash wortca wortda", "")]
    scores = {r.doc_id: r.score for r in toxicity.measured(spark.createDataFrame(both, COLUMNS), lexicon, curve=True).collect()}
    assert scores[1] < toxicity.THRESHOLD <= scores[2]


def test_scores_equal_brute_force():
    """Plain search of the folded text for every term and exception."""
    rng = random.Random(13)
    letters = "abcаеo0 1!@-é"
    weights, text = {}, lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(60):
        word = toxicity.fold(text(3)).replace(" ", "")
        if word:
            weights[rng.choice((f" {word} ", f" {word}"))] = 1 + rng.random()
    lexicon = toxicity.Lexicon(weights, tuple(p for p in (" ".join(toxicity.fold(text(6)).split()) for _ in range(15)) if p), (-1.0, 0.5, 1.0, 0.2))
    machine = lexicon.automaton()
    for _ in range(300):
        folded = toxicity.fold(text(rng.randrange(60)))
        best = {}
        for term, weight in weights.items():
            for i in range(len(folded)):
                if folded.startswith(term, i):
                    best[i] = max(best.get(i, 0.0), weight)
        for phrase in lexicon.exceptions:
            for i in range(len(folded)):
                if folded.startswith(f" {phrase} ", i):
                    best = {s: w for s, w in best.items() if not i <= s < i + len(phrase) + 1}
        want = sum(best.values()), max(best.values(), default=0.0), len(folded.split())
        got = toxicity.Lexicon.measure(folded, machine)
        assert abs(got[0] - want[0]) < 1e-9 and got[1:] == want[1:]
        value = 1 / (1 + math.exp(1.0 - 0.5 * math.log1p(want[0]) - want[0] / math.sqrt(want[2] + 25) - 0.2 * want[1]))
        assert abs(lexicon.scores([got])[0] - value) < 1e-12
