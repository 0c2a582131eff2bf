"""Robust multivariate quality rules: minimum covariance determinant by language and source.

Each document has a vector of transformed statistics.  For every (lang, source)
with enough documents the half of them with the smallest covariance determinant
is sought from several starts: the half nearest to the medians, the half by the
covariance of the spatial signs, and the half by the covariance of the squashed
scores.  From each, concentration steps (mean and covariance of the half choose
the next half) go on until no group's determinant falls any more; of the starts
the one that ends with the smallest determinant is the group's fit.  A document
is rejected if its Mahalanobis distance from that fit is beyond a limit, or by
the base rules.  Groups of fewer than least_group documents use the fit of their
language, and where that is small as well the fit of all documents.

Everything is DataFrame and SQL functions.  A fit is one aggregation with
map-side sums; quantiles are mergeable sketches; no group is ever collected.

Contract.  Null texts and texts without words have no words and fail the base
rule of ten words.  Null lang and source are values of their own.  Equal rows
get equal verdicts.  Extra columns are kept by keep_clean(), whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, written

SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
FEATURES = ("symbols", "word_length", "capitals", "marks")
#: Least spread of each feature, in its own unit: less is no evidence.
FLOORS = {"symbols": 0.06, "word_length": 0.05, "capitals": 0.03, "marks": 0.03}
#: Words that pull a short document towards its group.
PULL = 60.0
LEAST_GROUP, CUT = 60, 7.5
#: Steps go on until no group's log determinant falls by more than SETTLED, MAX_STEPS at most.
MAX_STEPS, SETTLED = 8, 0.02
STARTS = ("medians", "signs", "squashed")
#: Median of the chi-squared distribution with as many degrees of freedom as features.
CHI2_MEDIAN = 3.3567
#: Groups whose fits may be broadcast (a few hundred bytes each).
BROADCAST_GROUPS = 50_000


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is not inlined, as a column may be."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _windows(w: Column) -> Column:
    """64-bit hashes of the windows of five words, in order; for fewer than six words none can repeat."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))
    return F.when(F.size(w) < 6, F.array().cast("array<bigint>")).otherwise(hashes)


def _repeated(h: Column) -> Column:
    """From window hashes in order: how many words those that are found twice or more cover."""
    none = F.lit(0).cast("long")
    return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_bound(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _covered))


def _covered(ranked: Column) -> Column:
    again = F.filter(ranked, lambda x, k: F.coalesce(x["h"] == F.get(ranked, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ranked, k + 1)["h"], F.lit(False)))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(5), i - s["last"])).alias("n")))["n"]


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features."""
    t = F.coalesce(F.col(text), F.lit(""))
    p = prefix
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_words = _bound(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _bound(_windows(w), _repeated).alias("again")))
    of_lines = _bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    df = docs.withColumn(f"{p}of_words", of_words).withColumns(
        {
            f"{p}n_words": F.col(f"{p}of_words.n"),
            f"{p}n_repeat_words": F.col(f"{p}of_words.again"),
            f"{p}word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            f"{p}n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            f"{p}n_dup_lines": of_lines,
            f"{p}letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("double"),
            f"{p}capital": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("double"),
        }
    )
    n, chars = F.greatest(F.col(f"{p}n_words"), F.lit(1)), F.greatest(F.col(f"{p}word_chars"), F.lit(1))
    return df.withColumns(
        {
            f"{p}symbols": F.sqrt(F.col(f"{p}n_symbols") / n),
            f"{p}word_length": F.log(F.greatest(F.col(f"{p}word_chars") / n, F.lit(1.0))),
            f"{p}capitals": F.sqrt(F.col(f"{p}capital") / F.greatest(F.col(f"{p}letters"), F.lit(1.0))),
            f"{p}marks": F.sqrt((F.col(f"{p}word_chars") - F.col(f"{p}letters")) / chars),
            f"{p}base_failed": (F.col(f"{p}n_words") < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * F.col(f"{p}n_words")),
        }
    ).drop(f"{p}of_words", f"{p}letters", f"{p}capital")


LEVELS = (("lang", "source"), ("lang",), ())


def _keys(df: DataFrame) -> DataFrame:
    """One row per document and level, with the level's key as text that tells null from empty."""
    part = {c: F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\x1f")) for c in ("lang", "source")}
    key = [F.concat(F.lit(f"{k}:"), *(part[c] for c in level)) if level else F.lit(f"{k}:") for k, level in enumerate(LEVELS)]
    return df.withColumn("level_keys", F.array(*key))


def _distance(x: dict[str, Column]) -> Column:
    """Squared Mahalanobis distance: forward substitution in the Cholesky factor of the fit's columns."""
    z: list[Column] = []
    total = F.lit(0.0)
    for i, a in enumerate(FEATURES):
        rest = x[a] - F.col(f"m_{a}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * z[j]
        z.append(rest / F.col(f"l_{i}{i}"))
        total = total + z[-1] * z[-1]
    return total


def _factor(df: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance columns c_ij, with floors added to the diagonal."""
    for i, a in enumerate(FEATURES):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}")
            if i == j:
                rest = rest + F.lit(FLOORS[a] ** 2)
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            df = df.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}{j}"))
    return df


def _pulled(center: str) -> dict[str, Column]:
    """Features drawn towards the group's middle where there are few words to measure them."""
    weight = F.sqrt(F.col("n_words") / (F.col("n_words") + F.lit(PULL)))
    return {a: F.col(f"{center}_{a}") + (F.col(a) - F.col(f"{center}_{a}")) * weight for a in FEATURES}


def _log_determinant() -> Column:
    """Of the covariance whose Cholesky factor the columns l_ij are."""
    out = F.lit(0.0)
    for i in range(len(FEATURES)):
        out = out + 2 * F.log(F.col(f"l_{i}{i}"))
    return out


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _started(rows: DataFrame, centres: DataFrame, few: bool) -> DataFrame:
    """A fit per group and start: the medians with three covariances that outliers hardly move."""
    spread = rows.groupBy("group_key").agg(*(F.percentile_approx(F.abs(F.col(a) - F.col(f"q_{a}")), 0.5, 2000).alias(f"s_{a}") for a in FEATURES))
    spread = written(spread.join(centres, "group_key").select("group_key", *(F.greatest(F.col(f"s_{a}") * 1.4826, F.lit(FLOORS[a])).alias(f"s_{a}") for a in FEATURES), *(F.col(f"q_{a}").alias(f"m_{a}") for a in FEATURES)))
    z = {a: (F.col(a) - F.col(f"m_{a}")) / F.col(f"s_{a}") for a in FEATURES}
    norm = F.greatest(F.sqrt(sum((x * x for x in z.values()), F.lit(0.0))), F.lit(1e-9))
    kinds = {"signs": [z[a] / norm for a in FEATURES], "squashed": [F.tanh(z[a]) for a in FEATURES]}
    scores = _beside(rows, spread, few).select("group_key", *(x.alias(f"{kind}_{i}") for kind, v in kinds.items() for i, x in enumerate(v)))
    sums = scores.groupBy("group_key").agg(*(F.avg(F.col(f"{kind}_{i}") * F.col(f"{kind}_{j}")).alias(f"{kind}_{i}{j}") for kind in kinds for i, j in _PAIRS))
    both = spread.join(sums, "group_key")
    out = None
    for kind in STARTS:
        entry = lambda i, j, kind=kind: F.lit(float(i == j)) if kind == "medians" else F.col(f"{kind}_{i}{j}")
        covariance = {f"c_{i}{j}": entry(i, j) * F.col(f"s_{FEATURES[i]}") * F.col(f"s_{FEATURES[j]}") for i, j in _PAIRS}
        own = _factor(both.withColumns(covariance)).select("group_key", F.lit(kind).alias("start"), *_fitted())
        out = own if out is None else out.unionByName(own)
    result = written(out)
    discard(spread)
    return result


def fits(statistics: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """A row per group of each level: key, start, log determinant, mean, Cholesky factor and scale of its fit.

    statistics is read a few times for every step; it should be a table of a few numbers per document.
    """
    wanted = statistics.where(F.col("n_words") >= 10).select("lang", "source", "n_words", *FEATURES)
    rows = _keys(wanted).withColumn("group_key", F.explode("level_keys")).drop("level_keys", "lang", "source")
    middle = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(a, 0.5, 2000).alias(f"q_{a}") for a in FEATURES))
    centres = written(middle.where(F.col("n") >= least_group))
    few = centres.count() <= BROADCAST_GROUPS
    rows = _beside(rows, centres.drop("n"), few).withColumns(_pulled("q"))
    fit = _started(rows, centres, few)
    rows = rows.select("group_key", *FEATURES)
    for step in range(MAX_STEPS):
        near = _beside(rows, fit, few).withColumn("d2", _distance({a: F.col(a) for a in FEATURES})).select("group_key", "start", "d2", *FEATURES)
        half = near.groupBy("group_key", "start").agg(F.percentile_approx("d2", 0.5, 2000).alias("half"))
        inner = near.join(F.broadcast(half) if few else half, ["group_key", "start"]).where(F.col("d2") <= F.col("half"))
        sums = inner.groupBy("group_key", "start").agg(*(F.avg(a).alias(f"m_{a}") for a in FEATURES), *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}{j}") for i, j in _PAIRS))
        after = written(_factor(sums).select("group_key", "start", *_fitted()).withColumn("log_determinant", _log_determinant()))
        before = fit.select("group_key", "start", F.col("log_determinant").alias("last")) if step else None
        fell = after.join(before, ["group_key", "start"]).agg(F.max(F.col("last") - F.col("log_determinant"))).first()[0] if step else None
        discard(fit)
        fit = after
        if step and (fell is None or fell < SETTLED):
            break
    best = fit.groupBy("group_key").agg(F.min_by(F.struct(*fit.columns[1:]), F.struct("log_determinant", "start")).alias("best")).select("group_key", "best.*")
    best = written(best)
    near = _beside(rows, best, few).withColumn("d2", _distance({a: F.col(a) for a in FEATURES}))
    # The half's covariance is too small for all; its scale makes the median distance right.
    half = near.groupBy("group_key").agg(F.percentile_approx("d2", 0.5, 2000).alias("half"))
    out = best.join(half, "group_key").withColumn("scale", F.greatest(F.col("half") / CHI2_MEDIAN, F.lit(1.0))).drop("half")
    out = written(out.join(centres, "group_key"))
    discard(fit, best, centres)
    return out


def _fitted() -> list[str]:
    return [f"m_{a}" for a in FEATURES] + [f"l_{i}{j}" for i, j in _PAIRS]


def _beside(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their group; groups go to all executors only if they are few."""
    return rows.join(F.broadcast(groups) if few else groups, "group_key")


def with_verdict(statistics: DataFrame, fit: DataFrame, cut: float = CUT) -> DataFrame:
    """statistics with distance (root of the scaled square) and kept."""
    few = fit.count() <= BROADCAST_GROUPS
    rows = _keys(statistics)
    fit = fit.drop("n", "start", "log_determinant")
    names = [c for c in fit.columns if c != "group_key"]
    packed = fit.select("group_key", F.struct(*names).alias("fit"))
    for k in range(len(LEVELS)):
        own = packed.select(F.col("group_key").alias(f"key_{k}"), F.col("fit").alias(f"fit_{k}"))
        rows = rows.withColumn(f"key_{k}", F.element_at("level_keys", k + 1)).join(F.broadcast(own) if few else own, f"key_{k}", "left").drop(f"key_{k}")
    rows = rows.withColumn("fit", F.coalesce(*(F.col(f"fit_{k}") for k in range(len(LEVELS))))).drop("level_keys", *(f"fit_{k}" for k in range(len(LEVELS))))
    rows = rows.withColumns({c: F.col(f"fit.{c}") for c in names}).drop("fit")
    d = F.sqrt(_distance(_pulled("q")) / F.col("scale"))
    return rows.withColumn("distance", d).drop(*names).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut))


def _texts(docs: DataFrame, *extra: Column) -> DataFrame:
    return docs.select(*extra, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def quality_report(docs: DataFrame, cut: float = CUT, least_group: int = LEAST_GROUP) -> DataFrame:
    """Statistics and verdict of every document; equal rows each get theirs, extra columns are not read."""
    statistics = written(with_statistics(_texts(docs, F.col("doc_id"))).drop("text"))
    return with_verdict(statistics, fits(statistics, least_group), cut).drop("lang", "source", *FEATURES)


def keep_clean(docs: DataFrame, cut: float = CUT, least_group: int = LEAST_GROUP) -> DataFrame:
    """docs that are kept, with their own columns only, whatever these are called.

    Statistics are written once beside the rows that they are of.
    """
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    statistics = written(with_statistics(_texts(docs, row)).drop("text"))
    judged = with_verdict(statistics, fits(statistics, least_group), cut)
    return judged.where("kept").select(*(F.col("row").getField(c).alias(c) for c in columns))


__all__ = ["fits", "keep_clean", "quality_report", "with_statistics", "with_verdict"]
