from tidemill.llm.licenses import TEMPLATES, need, scan

COLUMNS = "doc_id bigint, text string, words string, labels string"


def test_phrases_and_templates(spark):
    bsd = next(t for label, t in TEMPLATES if label == "bsd")
    rows = [
        (1, "Under the MIT-License, or the mit license!", "", ""), (2, None, None, None), (3, "", "", ""), (4, "GNU General\nPublic LICENSE", "", ""),
        (5, "filler " * 5000 + bsd.upper().replace("SOURCE", "SORCE") + " filler" * 500, "", ""), (5, "mitlicense apache 2", "", ""),
        (None, "Licensed under CC BY-NC 4.0.", "", ""), (7, "public license general", "", ""), (8, "éapache license apache license", "", ""),
    ]
    found = {(r.doc_id, r.n_words): r[2:] for r in scan(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found[1, 8] == (2, 2, 6, "mit", "mit", 1.0)
    assert found[2, 0] == found[3, 0] == (0, None, None, "", "", 0.0)
    assert found[4, 4] == (1, 1, 1, "gpl", "gpl", 1.0)
    long = found[5, 5500 + len(bsd.split())]
    assert long[:5] == (0, None, None, "", "bsd") and 0.9 <= long[5] < 1
    assert found[5, 3] == (0, None, None, "", "", 0.0)
    assert found[None, 7] == (0, None, None, "", "cc-by-nc", 1.0)
    assert found[7, 3][0] == 0 and found[8, 4][:3] == (1, 2, 2)
    assert scan(spark.createDataFrame([], COLUMNS)).count() == 0


def test_filters_lose_nothing(spark):
    import random
    rng = random.Random(2)
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
    rows = []
    for i in range(300):
        words = []
        for _ in range(3):
            words += rng.sample(vocabulary, rng.randrange(20))
            t = rng.choice(TEMPLATES)[1].split()
            words += [w for w in t if rng.random() < 0.95]
        rows.append((i, " ".join(words), "", ""))
    found = {r.doc_id: r.labels for r in scan(spark.createDataFrame(rows, COLUMNS)).collect()}
    for i, text, *_ in rows:
        words, labels = text.split(), set()
        for b in range(0, max(1, -(-(len(words) - 32) // 32)) * 32, 32):
            block = set(words[b : b + 64])
            labels |= {label for label, t in TEMPLATES if len(block & set(t.split())) >= need(len(set(t.split())))}
        for j, w in enumerate(words):
            if w == "license" and j:
                labels |= {words[j - 1]} & {"mit", "apache"} or ({"gpl"} if words[max(0, j - 2) : j] == ["general", "public"] else set())
        assert set(filter(None, found[i].split(","))) == labels
