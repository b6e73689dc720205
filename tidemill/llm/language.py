"""Language identification by unigram pieces with all segmentations summed (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, mixed, written

VOCABULARY = "piece_bpe_32k.model"
#: About so many rows of each language are learned from, picked by a hash of doc_id.
PER_LANGUAGE = 1_500
#: Steps of expectation and maximisation, what each piece counts besides, and the probability of an unknown letter.
STEPS, PRIOR, UNKNOWN = 3, 0.05, 1e-8
#: Letters of a stretch: longer words are scored stretch by stretch. Letters of the longest piece used.
STRETCH, LONGEST = 24, 12
#: Distinct words a worker remembers before it starts anew, and characters of text it splits at a time.
REMEMBERED, AT_ONCE = 1 << 19, 1 << 21

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """Words in lower case after the mark of a word's beginning; stretches past the first have none."""
    out = []
    for word in _WORD.findall(text.lower()):
        if len(word) < STRETCH:
            out.append("▁" + word)
        else:
            word = "▁" + word
            out += [word[i : i + STRETCH] for i in range(0, len(word), STRETCH)]
    return out


@cache
def pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's pieces of letters in lower case, each once, in order."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return tuple(dict.fromkeys(p for p in plain if len(p) <= LONGEST and "▁" not in p[1:] and regex.fullmatch(r"▁?[\p{L}\p{M}]*", p) and p))


class Lattice:
    """All segmentations of words into pieces, as arrays over words of one length at a time."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, vocabulary: tuple[str, ...]):
        self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(STRETCH + 1, self.BASE, np.uint64))), dtype=np.uint64)
        self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(STRETCH + 1, pow(self.BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
        keys = np.zeros(len(vocabulary), np.uint64)
        for n in {len(v) for v in vocabulary}:
            at = [i for i, v in enumerate(vocabulary) if len(v) == n]
            keys[at] = self._prefix([vocabulary[i] for i in at], n)[:, n]
        keys = mixed(keys)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.size = len(vocabulary)
        self.starts = np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))

    def _prefix(self, words: list[str], n: int) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
        out = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(mixed(points) * self.power[:n], axis=1, out=out[:, 1:])
        return out

    def edges(self, words: list[str], n: int):
        """(start, end, ids) of each place a piece can stand in words of n letters; `size` is no piece."""
        prefix = self._prefix(words, n)
        for end in range(1, n + 1):
            for start in range(max(0, end - LONGEST), end):
                key = mixed((prefix[:, end] - prefix[:, start]) * self.inverse[start])
                slot = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
                yield start, end, np.where(self.keys[slot] == key, self.order[slot], self.size)

    def forward(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """Log probability of each word under each language; chance: a row for each piece, one for none, a column for each language."""
        out = np.empty((len(words), chance.shape[1]))
        for n, at in by_length(words):
            alpha = [np.ones((len(at), chance.shape[1]))] + [np.zeros((len(at), chance.shape[1])) for _ in range(n)]
            for start, end, ids in self.edges([words[i] for i in at], n):
                hit = np.flatnonzero(ids < self.size)
                alpha[end][hit] += alpha[start][hit] * chance[ids[hit]]
                if end - start == 1:
                    alpha[end] += alpha[start] * UNKNOWN
            out[at] = np.log(alpha[n])
        return out

    def expected(self, words: list[str], weight: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """How often each piece is used in each language, over all segmentations of words that count `weight` in each."""
        out = np.zeros((self.size + 1, chance.shape[1]))
        for n, at in by_length(words):
            edges = list(self.edges([words[i] for i in at], n))
            shape = (len(at), chance.shape[1])
            alpha, beta = [np.zeros(shape) for _ in range(n + 1)], [np.zeros(shape) for _ in range(n + 1)]
            alpha[0] += 1
            beta[n] += 1
            cost = lambda ids, one: chance[ids] + UNKNOWN * one
            for start, end, ids in edges:
                alpha[end] += alpha[start] * cost(ids, end - start == 1)
            for start, end, ids in sorted(edges, key=lambda e: -e[1]):
                beta[start] += beta[end] * cost(ids, end - start == 1)
            share = weight[at] / alpha[n]
            for start, end, ids in edges:
                use = alpha[start] * chance[ids] * beta[end] * share
                for k in range(chance.shape[1]):
                    out[:, k] += np.bincount(ids, weights=use[:, k], minlength=self.size + 1)
        return out


def by_length(words: list[str]):
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for n in np.unique(lengths):
        low, high = np.searchsorted(lengths[order], [n, n + 1])
        for i in range(low, high, 1 << 15):
            yield int(n), order[i : min(high, i + (1 << 15))]


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray
    path: str


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n: how often each word stands in each language."""

    def run(batches):
        from collections import Counter, defaultdict

        for batch in batches:
            own = defaultdict(Counter)
            for lang, text in zip(batch.column(0), batch.column(1)):
                own[lang.as_py()].update(words_of(text.as_py()))
            flat = [(k, w, n) for k, c in own.items() for w, n in c.items()]
            columns = list(zip(*flat)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    found = rows.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, model: Model) -> np.ndarray:
    """How often each piece is used in each language, summed over the partitions of a table of lang, word, n.

    A language's words are weighed under its own probabilities alone, so work and memory don't grow with the languages.
    """
    place = {k: i for i, k in enumerate(model.languages)}
    shared = words.sparkSession.sparkContext.broadcast(model)  # a number for each piece and language

    def run(batches):
        model = shared.value
        lattice = Lattice(pieces(model.path))
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                at = [i for i, k in enumerate(langs) if k == lang]
                weight = batch.column(2).take(pa.array(at)).to_numpy().astype(float)[:, None]
                used = lattice.expected(batch.column(1).take(pa.array(at)).to_pylist(), weight, model.chance[:, [place[lang]]])[:-1, 0]
                hit = np.flatnonzero(used)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(used[hit])], ["lang", "piece", "used"])

    out = np.zeros((len(pieces(model.path)), len(model.languages)))
    found = words.select("lang", "word", "n").mapInArrow(run, "lang string, piece int, used double")
    found = found.groupBy("lang", "piece").agg(F.sum("used").alias("used")).toArrow()  # a row for each piece and language at most
    out[found["piece"].to_numpy(), [place[k] for k in found["lang"].to_pylist()]] = found["used"].to_numpy()
    return out


def learn(docs: DataFrame, path: str | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Piece probabilities of each language by expectation and maximisation over all segmentations.

    Learns from rows that are not held out and have a language: about `per_language` of each, all their words. Words stay in
    the shared folder; sums for each piece and language are all that reaches the driver. No such rows: no languages, and
    every text is und.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.filter("lang is not null and text is not null").filter(~held_out()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    grid = 1 << 30
    cut = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(grid * min(1, per_language / n)))) for k, n in counts.items()], F.lit(0))
    size = len(pieces(path))
    model = Model(languages, np.vstack((np.full((size, len(languages)), 1 / size), np.zeros((1, len(languages))))), path)
    if languages:
        words = written(_word_counts(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < cut)), "words")
        for _ in range(STEPS):
            used = _expected(words, model) + PRIOR
            model = Model(languages, np.vstack((used / used.sum(axis=0), np.zeros((1, len(languages))))), path)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row: the likeliest language of the whole text and its posterior under equal priors.

    A text that is null or has no letter is und with score 0; ties go to the first language by name. Each text is judged
    alone; repeated rows come out once each and other columns are ignored.
    """
    kept = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each piece and language

    def run(batches):
        model = shared.value
        lattice, known = Lattice(pieces(model.path)), {}
        table = np.zeros((0, len(model.languages)))
        for batch in batches:
            best, chances = [], []
            texts = [t.as_py() or "" for t in batch.column(1)]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= AT_ONCE):
                    size += len(texts[stop])
                    stop += 1
                split = [words_of(t) for t in texts[at:stop]]
                if len(known) >= REMEMBERED:
                    known, table = {}, table[:0]
                new = list({w for ws in split for w in ws}.difference(known)) if model.languages else []
                if new:
                    known.update(zip(new, range(len(table), len(table) + len(new))))
                    table = np.concatenate((table, lattice.forward(new, model.chance)))
                for words in split:
                    if not words or not model.languages:
                        best.append("und"), chances.append(0.0)
                        continue
                    total = table[[known[w] for w in words]].sum(axis=0)
                    i = int(np.argmax(total))
                    best.append(model.languages[i]), chances.append(float(1 / np.exp(np.maximum(total - total[i], -700)).sum()))
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(chances, pa.float64())], ["doc_id", "lang_pred", "score"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """learn() and predict() over all documents; held-out rows are predicted, never learned from."""
    docs = documents(spark, sf_dir, "lang")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
