import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tidemill.llm import bpe, bpe_words

COLUMNS = "doc_id bigint, text string, ids string"
TEXTS = [
    None, "", " ", "Hello, world! It's 2024.", "a" * 300, "naïve café über Straße – déjà vu", "한국어 텍스트\n\n\tmixed  spaces   end  ", "<|endoftext|> stays text",
    "\x1c\x1d odd \x85 blanks here　", "🙂🙃 emoji 👩‍👩‍👧", "'S 't it'll ''re", "x" * 70 + " " + "ab" * 200, "\u0000nul", "ééé" * 50,
]


def reference():
    path = public_tokenizers.path(bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})


def test_ids_match_and_round_trip(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3040, 0x30FF)))) for _ in range(rng.randrange(200))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], COLUMNS).select("doc_id", "text")
    own = reference()
    for row in bpe.encode(docs).withColumn("back", bpe.decoded("ids")).collect():
        want = own.encode_ordinary(row.text or "")
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert bytes(row.back) == (row.text or "").encode()


def test_word_table_by_higher_order_functions(spark):
    words = ["", "the", " the", "unbelievably", "Straße", "aaaaaaa", " xqzt", "éééé", "한국", None]
    rank = bpe.ranks(public_tokenizers.path(bpe.VOCABULARY))
    found = bpe_words.encode_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert [(r.word, r.ids) for r in found] == [(w, None if w is None else bpe.merge(w.encode(), rank) if w else []) for w in words]


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_documents_by_higher_order_functions(spark):
    own = reference()
    short = [t for t in TEXTS if not t or len(t) < 60]  # a fold takes a step for each byte, over all of a word's pairs
    rows = [(i, t, "x") for i, t in enumerate(short)] + [(3, short[3], "again"), (3, "another text of one id", ""), (None, "no id", "")]
    found = bpe_words.encode_documents(spark.createDataFrame(rows, COLUMNS)).collect()
    want = sorted((str(i), own.encode_ordinary(t)) for i, t in {(i, t) for i, t, _ in rows} if t)
    assert sorted((str(r.doc_id), r.ids) for r in found) == want


def test_clashing_columns_and_repeated_rows(spark):
    rows = [("z", 1, "the cat", "old", 5), ("z", 1, "the cat", "old", 5), (None, None, None, None, None)]
    found = bpe.encode(spark.createDataFrame(rows, "ids_sha256 string, doc_id bigint, text string, ids string, n_tokens int"))
    assert found.columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256"]
    assert [r.n_tokens for r in found.select("ids", "n_tokens").collect()] == [2, 2, 0]
