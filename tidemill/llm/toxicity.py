"""Toxicity by a learned, weighted lexicon and Aho-Corasick matching of folded text (operator 5)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, written

#: Look-alike letters after lower-casing and decomposition, and digit substitutions, with the letter each is folded to (fixed
#: values, a choice from the public table of confusable characters).
LETTERS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ҽ": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ք": "p", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ʏ": "y", "ɪ": "i", "ʀ": "r", "ʙ": "b", "ʜ": "h", "ʟ": "l", "ɴ": "n", "ᴀ": "a", "ᴄ": "c",
    "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ø": "o", "ł": "l", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: At most so many labelled rows are learned from, two thirds for the lexicon and one for the curve; the terms kept.
SAMPLE, TERMS = 12_000, 4_000
#: Exception phrases kept; each is a word with a term in it and the word before or after, in so many clean rows and surely clean.
PHRASES = 1_000
#: A term is a word or the first so many letters of one, in so many toxic rows, of so much log-odds at a one-sided 95 %.
PREFIX, SUPPORT, LEAST = (5, 6, 7, 8), 4, 1.0
THRESHOLD = 0.3

_LETTERS = str.maketrans(LETTERS)
_MARKS = regex.compile(r"\p{Mn}+")
_DIGIT = regex.compile(r"(?<=\p{L})[0134578@$!](?=\p{L})|(?<=\p{L})[0134578]|[0134578@$](?=\p{L})")
_APART = regex.compile(r"[^\p{L}\p{N}]+")


def fold(text: str) -> str:
    """The words of a text, each between single blanks: lower case, accents gone, look-alikes and digits within words as letters."""
    plain = text.lower()
    if not plain.isascii():
        plain = _MARKS.sub("", unicodedata.normalize("NFKD", plain)).translate(_LETTERS)
    for _ in range(2):  # a digit after a digit that became a letter
        plain = _DIGIT.sub(lambda m: DIGITS[m[0]], plain)
    return f" {_APART.sub(' ', plain).strip()} "


@dataclass
class Lexicon:
    """Weights of terms; ' word ' is a whole word and ' begin' the first letters of one."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = ()

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            key = fold(phrase)
            machine.add_word(key, (len(key), 0.0))
        machine.make_automaton()
        return machine

    @staticmethod
    def measure(folded: str, machine) -> tuple[float, float, float]:
        """Sum of the matched words' weights, their largest, and the number of words; words within an exception count nothing."""
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(folded) if len(machine) else ():
            start = end - size + 1
            if weight:
                best[start] = max(best.get(start, 0.0), weight)
            else:
                excused.append((start, end))
        for low, high in excused:
            for start in [s for s in best if low <= s < high]:
                del best[start]
        return sum(best.values()), max(best.values(), default=0.0), folded.count(" ") - 1 if len(folded) > 2 else 0

    @staticmethod
    def features(total, most, words) -> np.ndarray:
        """A column each of ones, weight, weight for the length, and largest weight."""
        total, most, words = (np.asarray(x, float) for x in (total, most, words))
        return np.column_stack((np.ones(len(total)), np.log1p(total), total / np.sqrt(words + 25), most))

    def scores(self, measured: list[tuple[float, float, float]]) -> np.ndarray:
        x = self.features(*zip(*measured)) if measured else np.zeros((0, 4))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -40, 40)))


def held_out(doc_id="doc_id"):
    """Whether a row is kept from learning; a null id is not held out but has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _counted(rows: DataFrame, found_in) -> DataFrame:
    """term, toxic, clean: the rows of each label in whose folded text `found_in` finds a term."""

    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1)):
                counts[toxic.as_py()].update(found_in(fold(text.as_py() or "").split()))
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in counts[::-1]]], ["term", "toxic", "clean"])

    found = rows.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, clean bigint")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def terms_in(words: list[str]) -> set[str]:
    """Every word, and the first letters of every longer one."""
    out = set()
    for word in set(words):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in PREFIX if len(word) >= n)
    return out


def phrases_in(weights) -> Callable[[list[str]], set[str]]:
    """A function that finds the pairs of neighbouring words of which one holds a term."""

    def hit(word: str) -> bool:
        return f" {word} " in weights or any(f" {word[:n]}" in weights for n in PREFIX if len(word) >= n)

    def found_in(words: list[str]) -> set[str]:
        known = {w: hit(w) for w in set(words)}
        return {f"{a} {b}" for a, b in zip(words, words[1:]) if known[a] or known[b]}

    return found_in


def sure_odds(one: str, other: str, n1: int, n0: int):
    """Log-odds of a row of one label holding a term against the other's, less 1.645 standard errors."""
    odds = F.log((F.col(one) + 0.5) / (n1 + 1)) - F.log((F.col(other) + 0.5) / (n0 + 1))
    return odds - 1.645 * F.sqrt(1 / (F.col(one) + 0.5) + 1 / (F.col(other) + 0.5))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Lexicon:
    """Weights and score curve from up to `sample` labelled rows that are not held out, picked by a hash of doc_id.

    Terms are weighed by how surely they tell toxic rows; pairs of words with a term in them that as surely tell clean rows
    become exceptions. What reaches the driver is bounded: `terms` weights, PHRASES exceptions, and three numbers for a
    third of the sample.
    Without both labels in the sample, every score is the share of toxic rows (0 without any).
    """
    rows = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = rows.orderBy(order, "doc_id").limit(sample).withColumns({"part": F.pmod(F.hash("doc_id"), F.lit(3))})
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `sample` ids
    known = written(known, "labelled")
    count = {(r["p"], r["toxic"]): r["count"] for r in known.groupBy((F.col("part") > 0).alias("p"), "toxic").count().collect()}
    n1, n0 = count.get((True, 1), 0), count.get((True, 0), 0)
    base = sum(v for k, v in count.items() if k[1]) / max(1, sum(count.values()))
    logit = float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    if not n1 or not n0:
        return Lexicon({}, curve=(logit, 0.0, 0.0, 0.0))
    best = _counted(known.filter("part > 0"), terms_in).filter(F.col("toxic") >= SUPPORT).select("term", sure_odds("toxic", "clean", n1, n0).alias("sure"))
    lexicon = Lexicon({r.term: float(r.sure) for r in best.filter(F.col("sure") >= LEAST).orderBy(F.desc("sure"), "term").limit(terms).collect()})
    # A phrase that is in clean rows as surely as a term is in toxic ones excuses the terms in it.
    phrases = _counted(known.filter("part > 0"), phrases_in(frozenset(lexicon.weights))).filter(F.col("clean") >= SUPPORT).select("term", sure_odds("clean", "toxic", n0, n1).alias("sure"))
    lexicon.exceptions = tuple(r.term for r in phrases.filter(F.col("sure") >= LEAST).orderBy(F.desc("sure"), "term").limit(PHRASES).collect())

    rest = measured(known.filter("part = 0").select("doc_id", "text", "toxic"), lexicon, "toxic").collect()
    if len({r.toxic for r in rest}) < 2:
        lexicon.curve = (logit, 1.0, 0.0, 0.0)
        return lexicon
    x = Lexicon.features(*zip(*[(r.total, r.most, r.words) for r in rest]))
    y = np.array([r.toxic for r in rest], float)
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * beta)
    lexicon.curve = tuple(map(float, beta))
    return lexicon


def measured(docs: DataFrame, lexicon: Lexicon, *more: str, curve: bool = False) -> DataFrame:
    """doc_id, `more`, total, most and words of every row, and score with `curve`."""
    kept = docs.select("doc_id", *more, "text")

    def run(batches):
        machine = lexicon.automaton()
        for batch in batches:
            found = [Lexicon.measure(fold(t.as_py() or ""), machine) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array(c, pa.float64()) for c in (zip(*found) if found else ([], [], []))]
            if curve:
                columns.append(pa.array(lexicon.scores(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names)

    names = ["doc_id", *more, "total", "most", "words", *["score"] * curve]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, shape + "".join(f", {n} double" for n in names[1 + len(more) :]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; a score is a function of the text alone.

    Null and empty texts match nothing and get the score of that. Repeated rows come out once each. Labels that are null,
    or of unknown or null documents, are left out; an id labelled twice is toxic if either label is. Other columns of
    either table are ignored.
    """
    lexicon = learn(docs, labels)
    found = measured(docs, lexicon, curve=True)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() over all documents, learned from labels that are not held out."""
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
