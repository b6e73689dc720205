"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates (operator 10)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemill.llm.common import byte_texts, discard, documents, written

SYMBOLS = b"#*$%&|<>"
#: Rows below this many words, or with over half of their words in repeated three-word windows, fail before any estimate.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a group's rows that an estimate keeps, and rows' worth that the estimate of the language (of all rows, for a
#: language) counts in that of a group, so that small groups lean on it and large ones hardly do.
CORE, LEAN = 0.75, 200.0
#: The CORE quantile of a chi-square variable with five degrees of freedom.
CHI_CORE = 6.6257
#: Concentration ends when no determinant moves by this share any more, or after so many steps.
FALL, STEPS = 1e-2, 40
#: Up to so many groups, a row of some 400 bytes each, go to every task; more are joined by their keys.
BROADCAST = 20_000
#: A row is rejected beyond the upper fence of its group's distances (not squared), FENCE quartile ranges over the third
#: quartile, but never below LEAST_CUTOFF, the 99.9 % point of a chi-square variable with five degrees of freedom.
FENCE, LEAST_CUTOFF = 3.0, 20.5
STATS = ("log_length", "word_size", "symbols", "dup_lines", "repeats")
#: Least spread of each statistic, so that one that is constant in a group has no infinite weight; length by itself is no fault.
FLOOR = (1.0, 0.1, 0.02, 0.1, 0.2)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE = ", ".join(f"{name} bigint" for name in COUNTS)


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first: dict = {}
            gone = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    gone[i : i + 3] = gone[j : j + 3] = b"\1\1\1"
            repeat = sum(gone)
    return n, chars, symbols, dup, repeat


def measured(docs: DataFrame, *through: str) -> DataFrame:
    """The columns `through` and the base counts of every row."""

    def run(batches):
        for batch in batches:
            found = np.array([counts(t) for t in byte_texts(batch.column(batch.num_columns - 1))], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c) for c in found.T]], [*through, *COUNTS])

    kept = docs.select(*through, F.col("text").alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{shape}, {BASE}")


def failed(df: DataFrame) -> Column:
    return (df["n_words"] < LEAST_WORDS) | (100 * df["n_repeat_words"] > MOST_REPEATED * df["n_words"])


def _vector(df: DataFrame) -> Column:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(
        F.log(n),
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p(F.col("n_dup_lines").cast("double")) / F.log1p(n),
        F.sqrt(F.col("n_repeat_words") / n),
    )


def _distance(x: Column, mean: Column, inverse: Column) -> Column:
    """(x - mean)' inverse (x - mean), unrolled over half of the symmetric matrix."""
    d = len(STATS)
    centred = [F.get(x, i) - F.get(mean, i) for i in range(d)]
    terms = [centred[i] * centred[j] * F.get(inverse, i * d + j) * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


@F.pandas_udf(T.StructType([*[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("mean", "cov", "inverse")], T.StructField("logdet", T.DoubleType())]))
def _estimated(moments: pd.Series, means: pd.Series, covs: pd.Series) -> pd.DataFrame:
    """From sums over core rows (count, sums, sums of products), and a prior's mean and cov or null: mean, cov, inverse and log determinant."""
    d, out = len(STATS), []
    upper = np.triu_indices(d)
    for m, mean0, cov0 in zip(moments, means, covs):
        n, s, p = m[0], np.array(m[1 : d + 1]), np.zeros((d, d))
        p[upper] = m[d + 1 :]
        p = p + p.T - np.diag(np.diag(p))
        if mean0 is not None:
            mean0, cov0 = np.array(mean0), np.array(cov0).reshape(d, d)
            n, s, p = n + LEAN, s + LEAN * mean0, p + LEAN * (cov0 + np.outer(mean0, mean0))
        cov = p / n - np.outer(s / n, s / n)
        wide = cov + np.diag(np.square(FLOOR))
        out.append(((s / n).tolist(), cov.ravel().tolist(), np.linalg.inv(wide).ravel().tolist(), float(np.linalg.slogdet(wide)[1])))
    return pd.DataFrame(out, columns=["mean", "cov", "inverse", "logdet"])


def _sent(params: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(params) if groups <= BROADCAST else params


def _moments(rows: DataFrame, keys: list[str], priors: DataFrame | None, groups: int) -> DataFrame:
    """mean, cov, inverse and logdet by the keys: sums that combine before the shuffle, one small row for each group."""
    d = len(STATS)
    parts = [F.count("*").cast("double")] + [F.sum(F.get("x", i)) for i in range(d)]
    parts += [F.sum(F.get("x", i) * F.get("x", j)) for i in range(d) for j in range(i, d)]
    found = rows.groupBy(*keys).agg(F.array(*parts).alias("m"))
    none = F.lit(None).cast("array<double>")
    found = found.withColumns({"mean0": none, "cov0": none}) if priors is None else found.join(_sent(priors, groups), keys, "left")
    return found.select(*keys, _estimated("m", "mean0", "cov0").alias("e")).select(*keys, "e.*")


def _spread(rows: DataFrame, groups: int) -> DataFrame:
    """group, mean, cov, inverse from medians and median deviations."""
    d = len(STATS)
    middle = rows.groupBy("group").agg(*[F.percentile_approx(F.get("x", i), 0.5, 1000).alias(f"m{i}") for i in range(d)])
    spread = rows.join(_sent(middle, groups), "group").groupBy("group").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(d)],
        *[(1.4826 * F.percentile_approx(F.abs(F.get("x", i) - F.col(f"m{i}")), 0.5, 1000)).alias(f"s{i}") for i in range(d)],
    )
    wide = [F.col(f"s{i}") * F.col(f"s{i}") for i in range(d)]
    diagonal = lambda values: F.array(*[values[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    return spread.select("group", F.array(*[F.col(f"m{i}") for i in range(d)]).alias("mean"), diagonal(wide).alias("cov"), diagonal([1.0 / (w + FLOOR[i] ** 2) for i, w in enumerate(wide)]).alias("inverse"))


def _leaned(spots: DataFrame, tree: DataFrame, groups: int) -> DataFrame:
    """root (the CORE quantile) and fence of each group, leaning on those of its parent, level by level from the top."""
    both = tree.join(_sent(spots, groups), "group")
    level = both.filter("parent is null").select("group", "root", "fence")
    out = level
    for _ in range(2):  # languages, then their sources
        given = level.select(F.col("group").alias("parent"), F.col("root").alias("root0"), F.col("fence").alias("fence0"))
        lean = lambda own, top: ((F.col("n") * F.col(own) + LEAN * F.col(top)) / (F.col("n") + LEAN)).alias(own)
        level = both.join(_sent(given, groups), "parent").select("group", lean("root", "root0"), lean("fence", "fence0"))
        out = out.unionByName(level)
    return out


def estimates(rows: DataFrame, tree: DataFrame, groups: int) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group of rows (group, x): group, mean, inverse, scale, cutoff.

    `tree` (group, parent) says which group's estimate counts as LEAN rows in which other's; null: none, two levels below that
    at most. Concentration starts from medians and median deviations, and from a tenth of the rows by a hash of their
    statistics: distances under the estimate, the CORE share of least distances, the estimate anew from these and the
    parent's estimate, until no determinant moves by FALL; the start with the least determinant is taken. Every step is a sum
    over all rows, for all groups, levels and starts at once. Distances are scaled down where their CORE quantile is above
    that of a chi-square variable; quantile and fence lean on the parent's too.
    """
    some = rows.filter(F.pmod(F.xxhash64("x"), F.lit(10)) == 0)
    columns = ("group", "start", "mean", "cov", "inverse", "logdet")
    first = _spread(rows, groups).withColumns({"start": F.lit(0)})
    second = _moments(some, ["group"], None, groups).withColumns({"start": F.lit(1)})
    now = written(first.withColumns({"logdet": F.lit(None).cast("double")}).select(*columns).unionByName(second.withColumns({"logdet": F.lit(None).cast("double")}).select(*columns)), "mcd")
    for _ in range(STEPS):
        given = _sent(now.select("group", "start", "mean", "inverse"), groups)
        far = rows.join(given, "group").select("group", "start", "x", _distance(F.col("x"), F.col("mean"), F.col("inverse")).alias("far"))
        edge = far.groupBy("group", "start").agg(F.percentile_approx("far", CORE, 10_000).alias("edge"))
        core = far.join(_sent(edge, groups), ["group", "start"]).filter("far <= edge")
        above = now.select(F.col("group").alias("parent"), "start", F.col("mean").alias("mean0"), F.col("cov").alias("cov0"))
        priors = tree.join(_sent(above, groups), "parent").select("group", "start", "mean0", "cov0")
        new = written(_moments(core, ["group", "start"], priors, groups).select(*columns), "mcd")
        before = now.select("group", "start", F.col("logdet").alias("before"))
        moves = new.join(before, ["group", "start"]).agg(F.max(F.coalesce(F.abs(F.col("before") - F.col("logdet")), F.lit(1.0)))).first()[0]
        discard(now)
        now = new
        if moves is None or moves < FALL:
            break
    best = written(now.groupBy("group").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("e")).select("group", "e.*"), "mcd")
    far = rows.join(_sent(best, groups), "group").select("group", F.sqrt(F.greatest(_distance(F.col("x"), F.col("mean"), F.col("inverse")), F.lit(0.0))).alias("far"))
    spots = far.groupBy("group").agg(F.count("*").alias("n"), F.percentile_approx("far", [CORE, 0.25, 0.75], 10_000).alias("q"))
    high, wide = F.get("q", 2), F.get("q", 2) - F.get("q", 1)
    spots = written(spots.select("group", "n", F.get("q", 0).alias("root"), (high + FENCE * wide).alias("fence")), "mcd")
    scale = F.lit(CHI_CORE) / F.greatest(F.col("root") * F.col("root"), F.lit(CHI_CORE))
    cutoff = F.greatest(F.col("fence") * F.col("fence") * F.col("scale"), F.lit(LEAST_CUTOFF))
    leaned = _leaned(spots, tree, groups)
    found = best.join(_sent(leaned, groups), "group").withColumns({"scale": scale}).withColumns({"cutoff": cutoff})
    return written(found.select("group", "mean", "inverse", "scale", "cutoff"), "mcd")


def _placed(base: DataFrame) -> DataFrame:
    """Rows with base_failed, the names of their language and group, and their statistics x."""
    lang, source = F.coalesce("lang", F.lit("\x1e")), F.coalesce("source", F.lit("\x1e"))
    names = {"__lang": lang, "__own": F.concat_ws("\x1f", lang, source), "__x": _vector(base)}
    return base.withColumns({"base_failed": failed(base)}).withColumns(names)


def _parameters(placed: DataFrame) -> DataFrame:
    """__own, mean, inverse, scale, cutoff: the estimate that the rows of each lang and source are judged by."""
    fit = written(placed.filter("not base_failed").select("__lang", "__own", F.col("__x").alias("x")), "vectors")
    names = written(fit.select("__lang", "__own").distinct(), "groups")
    groups = 2 * names.count() + 1
    top = "\x1d"  # the group of all rows
    tree = names.select(F.col("__own").alias("group"), F.concat(F.lit(top), "__lang").alias("parent")).unionByName(names.select(F.concat(F.lit(top), "__lang").alias("group"), F.lit(top).alias("parent")))
    tree = tree.unionByName(names.select(F.lit(top).alias("group"), F.lit(None).cast("string").alias("parent"))).distinct()
    each = F.explode(F.array(F.col("__own"), F.concat(F.lit(top), "__lang"), F.lit(top))).alias("group")
    found = estimates(fit.select(each, "x"), tree, groups)
    return _sent(found.select(F.col("group").alias("__own"), "mean", "inverse", "scale", "cutoff"), groups)


def _judged(placed: DataFrame, params: DataFrame) -> DataFrame:
    joined = placed.join(params.withColumnRenamed("__own", "__key"), F.col("__own") == F.col("__key"), "left")
    distance = F.when(~F.col("base_failed"), _distance(F.col("__x"), F.col("mean"), F.col("inverse")) * F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    return joined.withColumns({"distance": distance}).withColumns({"kept": kept})


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance of every row of `docs` (doc_id, text, lang, source).

    Rows that the base rules fail take no part in the estimates. The others are grouped by lang and source, null being a
    value of its own; a group's estimate counts that of its language as LEAN rows, and that one the estimate of all rows, so
    there is no size at which the rule changes. A row whose scaled squared distance is over its group's cutoff is rejected.
    Null and empty texts have no words and fail. Repeated rows count and come out once each. An empty table gives an empty
    result; other columns are ignored.
    """
    placed = _placed(written(measured(docs, "doc_id", "lang", "source"), "measured"))
    return _judged(placed, _parameters(placed)).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that judge() keeps, with their columns as they were. Texts are read twice rather than shuffled."""
    params = _parameters(_placed(written(measured(docs, "lang", "source"), "measured")))
    names = {f"__c{i}": name for i, name in enumerate(docs.columns)}
    coded = docs.select(*[F.col(c).alias(n) for n, c in names.items()], "lang", "source", "text")
    again = _placed(measured(coded, *names, "lang", "source"))
    return _judged(again, params).filter("kept").select(*[F.col(n).alias(c) for n, c in names.items()])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() over all documents: base counts, whether the base rules fail, the verdict and the distance."""
    return judge(documents(spark, sf_dir, "lang", "source"))
