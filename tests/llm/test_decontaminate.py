import random

from tidemill.llm import decontaminate
from tidemill.llm.decontaminate import common_subsequence

COLUMNS = "doc_id bigint, text string, items string"


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert common_subsequence(masks, len(a), b) == brute(a, b)


def test_planted_items_are_found_and_others_left(spark):
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(4000)]
    some = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = {i: some(rng.choice((12, 30, 45, 150))) for i in range(40)}
    rows, want = [], {}
    for i in range(400):
        words, held = some(rng.randrange(5, 600)), []
        if i % 5 == 0:
            item = rng.randrange(40)
            text = list(items[item])
            if i % 10 == 0 and len(text) >= 30:  # a paraphrase: some words replaced, dropped and put in
                text = [w for x in text if rng.random() > 0.08 for w in ([x] if rng.random() > 0.08 else [x, rng.choice(rare)])]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in text]
            held = [item]
        rows.append((i, " ".join(words), ""))
        want[i] = held
    rows += [(900, None, ""), (901, "", ""), (None, " ".join(items[3]), ""), rows[5], (903, "c1 " * 5000, "")]
    benchmark = [(i, " ".join(w)) for i, w in items.items()] + [(3, " ".join(items[3])), (None, "x y"), (77, None), (78, " ")]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(benchmark, "item_id bigint, text string")).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: list(r.items) for r in found}
    assert {i: by[i] for i in want} == want
    assert by[900] == by[901] == by[903] == [] and by[None] == [3]


def test_empty_tables(spark):
    docs, benchmark = spark.createDataFrame([(1, "a b", "")], COLUMNS), spark.createDataFrame([], "item_id bigint, text string")
    assert [list(r.items) for r in decontaminate.find_leaks(docs, benchmark).collect()] == [[]]
    assert decontaminate.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def test_recall_over_more_items_than_the_space_has_dimensions(spark):
    rng = random.Random(6)
    some = lambda n: [f"v{int(3000 * rng.random() ** 2)}" for _ in range(n)]
    items = {i: some(rng.randrange(12, 60)) for i in range(700)}
    rows = [(i, " ".join(some(rng.randrange(40)) + items[i] + some(rng.randrange(40))), "") for i in items]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string"))
    by = {r.doc_id: set(r.items) for r in found.collect()}
    assert [i for i in items if i not in by[i]] == []
    words = {i: t.split() for i, t, _ in rows}
    clear = {d: {i for i, w in items.items() if len(set(w) & set(words[d])) >= 0.6 * len(set(w)) and brute(w, words[d]) >= 0.9 * len(w)} for d in by}
    assert all(clear[d] <= by[d] for d in by)


def test_an_item_leaked_in_a_third_of_the_rows_is_found(spark):
    rng = random.Random(7)
    some = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = {i: some(rng.randrange(12, 60)) for i in range(30)}
    hot = " ".join(some(60) + items[3] + some(60))
    rows = [(i, hot if i % 3 == 0 else " ".join(some(150)), "") for i in range(600)]
    rows += [(1000 + i, " ".join(some(50) + items[3] + some(50)), "") for i in range(20)]
    rows += [(2000 + i, " ".join(some(50) + items[i] + some(50)), "") for i in items]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string"))
    want = {i: [3] if i % 3 == 0 and i < 600 or 1000 <= i < 2000 else [i - 2000] if i >= 2000 else [] for i, _, _ in rows}
    assert {r.doc_id: list(r.items) for r in found.collect()} == want
    _, terms, _ = next(decontaminate.blocks(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(3, " ".join(items[3]))], "item_id bigint, text string")))
    assert all(terms.idf[terms.place[w.encode()]] > 0 for w in items[3])


def test_rows_of_one_id_stay_apart_over_several_blocks(spark, monkeypatch):
    items = {i: " ".join(f"b{i}x{j}" for j in range(20)) for i in range(6)}
    rows = [(None, items[0], ""), (None, "x y z", ""), (7, items[1] + " " + items[5], ""), (7, items[1] + " " + items[5], ""), (8, items[4], "")]
    docs, benchmark = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    plain = lambda: sorted((str(r.doc_id), r.n_passages, list(r.items), r.score) for r in decontaminate.find_leaks(docs, benchmark).collect())
    whole = plain()
    for size in (100, 300):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        assert plain() == whole and len(whole) == 5


def test_ids_of_text_and_shared_dimensions(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    items = {f"q{i}": some(rng.randrange(12, 40)) for i in range(25)}
    rows = [(i, " ".join(some(30) + w + some(30)), "") for i, w in enumerate(items.values())]
    docs, benchmark = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id string, text string")
    whole = {r.doc_id: list(r.items) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert all(q in whole[i] for i, q in enumerate(items))
    monkeypatch.setattr(decontaminate, "TERMS", 64)
    monkeypatch.setattr(decontaminate, "COSINES", 50)
    assert {r.doc_id: list(r.items) for r in decontaminate.find_leaks(docs, benchmark).collect()} == whole


def reworded(words, rate, rng, other):
    out = []
    for w in words:
        draw = rng.random()
        if draw < rate / 3:
            continue
        out += [other()] if draw < 2 * rate / 3 else [w, other()] if draw < rate else [w]
    return out


def test_whole_result_equals_brute_force_and_recall_of_paraphrases(spark):
    rng = random.Random(11)
    draw = lambda: f"v{int(2500 * rng.random() ** 2)}"
    items = {i: [draw() for _ in range(rng.randrange(12, 60))] for i in range(60)}
    rows, planted = [], {}
    for rate in (0.0, 0.1, 0.2, 0.3):
        for i in items:
            rows.append((len(rows), " ".join([draw() for _ in range(rng.randrange(90))] + reworded(items[i], rate, rng, draw) + [draw() for _ in range(rng.randrange(90))]), ""))
            planted.setdefault(rate, []).append((len(rows) - 1, i))
    found = {r.doc_id: set(r.items) for r in decontaminate.find_leaks(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")).collect()}

    held = {}
    for _, text, _ in rows:  # the passages that hold each word
        words = text.split()
        for start in range(0, max(1, len(words) - 32), 32):
            for w in set(words[start : start + 64]):
                held[w] = held.get(w, 0) + 1
    for doc, text, _ in rows:
        words, want = text.split(), set()
        for start in range(0, max(1, len(words) - 32), 32):
            near = words[max(0, start - 32) : start + 96]
            for i, item in items.items():
                answers = sorted(set(item), key=lambda w: (held.get(w, 0), w))[:4]
                if not set(near).isdisjoint(answers) and brute(item, near) >= 0.6 * len(item):
                    want.add(i)
        assert found[doc] == want
    recall = {rate: sum(i in found[d] for d, i in pairs) / len(pairs) for rate, pairs in planted.items()}
    assert recall[0.0] == recall[0.1] == 1 and recall[0.2] >= 0.95 and recall[0.3] >= 0.9, recall
