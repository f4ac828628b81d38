"""Quality rules: base counts of each text, then robust multivariate outliers per language and source.

DataFrame functions only. ``text_statistics`` counts over whole texts. ``mcd_verdicts`` turns the counts into a vector
of transformed statistics and estimates its centre and scatter in each (lang, source) by minimum covariance
determinant. From two starts (medians with absolute deviations, and the plain moments), concentration steps keep the
nearer SUPPORT share of the rows and estimate again; after TRIAL steps the start with the smaller determinant goes on,
until no determinant falls by more than TOLERANCE in logarithm (MAX_STEPS at most). The scatter is corrected for the share
kept, rows within the REWEIGHT quantile estimate once more, and rows beyond the QUANTILE of the chi-squared
distribution in squared Mahalanobis distance are rejected.

- Estimates are tables keyed by group, factored in columns and joined with the rows; Spark broadcasts them only below
  its size threshold. Every group of MIN_GROUP rows has its own, however many groups there are; smaller ones share a
  pool. A pool of fewer than MIN_POOL rows gives no verdict against anything: its rows pass.
- Medians and quantiles are read from counts in narrow bins (an eighth of a statistic's floor; 1/BINS_PER_OCTAVE of an octave
  of squared distance), which add up map-side, so a large group sends a row per bin and task.
- Scatter gets a floor on its diagonal (FLOORS), so a statistic that is constant in a group isn't divided by zero.
- Null text counts as empty, null lang and source are values of their own, repeated rows are judged each by itself,
  an empty table gives an empty table, very long texts are counted whole, and names of columns to keep that clash with
  the added ones are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Work
from .text import UPPER, table, words

SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\f\r"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
MIN_GROUP, MIN_POOL = 40, 20
SUPPORT, TRIAL, MAX_STEPS, TOLERANCE, BINS_PER_OCTAVE = 0.75, 2, 12, 0.02, 32
#: Chi-squared quantiles. Statistics of real texts have heavier tails than a normal law, so the last one is far out.
REWEIGHT, QUANTILE = 0.975, 1 - 1e-7
#: Standard deviations below which a statistic's spread isn't trusted.
FLOORS = {"word_length": 0.05, "symbols": 0.15, "dup_lines": 0.05, "repeats": 0.05, "capitals": 0.03, "shouts": 0.15, "echoes": 0.05}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_capitals", "n_shouts", "n_echoes", "base_failed"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("bigint")


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds the counts (BASE), n_lines, n_capitals, n_shouts, n_echoes and base_failed."""
    t = F.coalesce(F.col("text"), F.lit(""))
    w = words(t)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    docs = docs.withColumns({"_t": t, "_w": F.transform(w, lambda x: F.xxhash64(x)), "_lines": lines})
    n = F.size("_w")
    at = [lambda i, k=k: F.get("_w", i + k) for k in range(WINDOW)]
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(*[f(i) for f in at])))
    # Texts without a repeated window, nearly all, skip the sort.
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    docs = docs.withColumn("_pairs", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(pairs)).otherwise(F.slice(pairs, 1, 0)))
    twice = F.filter("_pairs", lambda x, k: (F.get("_pairs", k - 1)["h"] == x["h"]) | F.coalesce(F.get("_pairs", k + 1)["h"] == x["h"], F.lit(False)))
    docs = docs.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - i, F.lit(WINDOW))))
    chars = F.length("_t").cast("bigint")
    n_words = n.cast("bigint")
    docs = docs.withColumns(
        {
            "n_words": n_words,
            "word_chars": _without(F.col("_t"), SPACE_CHARS),
            "n_symbols": chars - _without(F.col("_t"), SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_capitals": chars - _without(F.col("_t"), UPPER),
            "n_shouts": chars - _without(F.col("_t"), "!"),
            "n_echoes": F.size(F.filter("_w", lambda x, i: x == F.get("_w", i - 1))).cast("bigint"),
        }
    ).drop("_t", "_w", "_lines", "_h", "_pairs", "_at")
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def vector() -> dict[str, Column]:
    """Transformed statistics. The constants pull short texts to the middle, where few words say little."""
    n = F.col("n_words")
    return {
        "word_length": F.log((F.col("word_chars") + 250.0) / (n + 50.0)),
        "symbols": F.log1p(20.0 * F.col("n_symbols") / (n + 20.0)),
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + 3.0),
        "repeats": F.col("n_repeat_words") / (n + 20.0),
        "capitals": F.col("n_capitals") / (F.col("word_chars") + 100.0),
        "shouts": F.log1p(20.0 * F.col("n_shouts") / (n + 20.0)),
        "echoes": F.col("n_echoes") / (n + 20.0),
    }


NAMES = list(FLOORS)
CELLS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def chi_squared_beyond(x: float, k: int) -> float:
    """Probability above x for an odd number k of degrees of freedom."""
    q = math.erfc(math.sqrt(x / 2))
    return q + sum((x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1) for j in range(1, k, 2))


def chi_squared_quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_squared_beyond(mid, k) > 1 - share else (lo, mid)
    return hi


def consistency(share: float, k: int) -> float:
    """By how much the scatter of the nearest share of normal rows falls short of the whole."""
    return share / (1 - chi_squared_beyond(chi_squared_quantile(share, k), k + 2))


CUTOFF = chi_squared_quantile(QUANTILE, len(NAMES))


def factored(moments: DataFrame, scale: float = 1.0) -> DataFrame:
    """grp, start, centre _c, inverse Cholesky factor _l (flat lower triangle) and log determinant of m0.. and c0_0...

    One level of columns after the other, as SQL text: it is analysed once."""
    p = range(len(NAMES))

    def less(first: str, terms: list[str]) -> str:
        return " - ".join([first, *terms])

    def cov(i, j):
        return f"coalesce(c{i}_{j}, 0D) * {scale!r}D" + (f" + {FLOORS[NAMES[i]] ** 2!r}D" if i == j else "")

    levels = []
    for j in p:
        levels.append([f"sqrt(greatest({less(cov(j, j), [f'L{j}_{k} * L{j}_{k}' for k in range(j)])}, 1e-12D)) as L{j}_{j}"])
        levels.append([f"({less(cov(i, j), [f'L{i}_{k} * L{j}_{k}' for k in range(j)])}) / L{j}_{j} as L{i}_{j}" for i in p if i > j])
    for i in p:
        levels.append([f"({less('0D', [f'L{i}_{k} * I{k}_{j}' for k in range(j, i)])}) / L{i}_{i} as I{i}_{j}" for j in range(i)] + [f"1 / L{i}_{i} as I{i}_{i}"])
    source = "{moments}"
    for level in filter(None, levels):
        source = f"(select *, {', '.join(level)} from {source})"
    centre, inverse = ", ".join(f"m{i}" for i in p), ", ".join(f"I{i}_{j}" for i, j in CELLS)
    det = " + ".join(f"2 * ln(L{i}_{i})" for i in p)
    return moments.sparkSession.sql(f"select grp, start, array({centre}) as _c, array({inverse}) as _l, {det} as det from {source}", moments=moments)


def _squared_distance() -> Column:
    rows = [" + ".join(f"({NAMES[j]} - get(_c, {j})) * get(_l, {CELLS.index((i, j))})" for j in range(i + 1)) for i in range(len(NAMES))]
    return F.aggregate(F.expr(f"array({', '.join(rows)})"), F.lit(0.0), lambda a, z: a + z * z)


def _moments(rows: DataFrame) -> DataFrame:
    aggs = [f"avg({x}) as m{i}" for i, x in enumerate(NAMES)] + [f"covar_samp({NAMES[i]}, {NAMES[j]}) as c{i}_{j}" for i, j in CELLS]
    return rows.groupBy("grp", "start").agg(*map(F.expr, aggs))


def _quantile_bin(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys and the first bin up to which at least that share of the key's rows (keys, bin) lie."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*keys, "bin", (upto >= share * F.sum("n").over(w)).alias("_in")).filter("_in").groupBy(*keys).agg(F.min("bin").alias("bound"))


def _medians(vectors: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """grp and the medians m0.. of the statistics, or of their absolute deviations from `about` (grp, m0..)."""
    values = vectors if about is None else vectors.join(about, "grp")
    cells = []
    for i, x in enumerate(NAMES):
        value = F.col(x) if about is None else F.abs(F.col(x) - F.col(f"m{i}"))
        cells.append(F.struct(F.lit(i).alias("i"), F.floor(value / (FLOORS[x] / 8)).alias("bin")))
    found = _quantile_bin(values.select("grp", F.explode(F.array(*cells)).alias("x")).select("grp", "x.i", "x.bin"), ["grp", "i"], 0.5)
    return found.groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, (F.col("bound") + 0.5) * (FLOORS[x] / 8))).alias(f"m{i}") for i, x in enumerate(NAMES)])


def fit_mcd(vectors: DataFrame, work: Work) -> DataFrame:
    """Per group, the corrected estimate (factored). vectors: grp and NAMES, saved."""
    middle = work.save(_medians(vectors), "medians")
    spread = _medians(vectors, middle).select("grp", *[F.col(f"m{i}").alias(f"d{i}") for i in range(len(NAMES))])
    robust = middle.join(spread, "grp").selectExpr("*", *[f"power(1.4826 * d{i}, 2) as c{i}_{j}" if i == j else f"0D as c{i}_{j}" for i, j in CELLS])
    fits = work.save(factored(robust.withColumn("start", F.lit(0))).unionByName(factored(_moments(vectors.withColumn("start", F.lit(1))))), "fits")

    def near(fits: DataFrame) -> DataFrame:
        d = vectors.join(fits.select("grp", "start", "_c", "_l"), "grp").withColumn("_d", _squared_distance()).drop("_c", "_l")
        return d.withColumn("bin", F.floor(F.log2(F.col("_d") + 1e-9) * BINS_PER_OCTAVE))

    for step in range(MAX_STEPS):
        bounds = work.save(_quantile_bin(near(fits).select("grp", "start", "bin"), ["grp", "start"], SUPPORT), f"bounds-{step}")
        inside = near(fits).join(bounds, ["grp", "start"]).filter("bin <= bound")
        new = work.save(factored(_moments(inside)), f"fits-{step}")
        old = fits.select("grp", "start", F.col("det").alias("_old"))
        fall = new.join(old, ["grp", "start"]).agg(F.max(F.col("_old") - F.col("det"))).first()[0]
        fits = new
        if step + 1 == TRIAL:
            best = F.min_by(F.struct("start", "_c", "_l", "det"), F.struct("det", "start")).alias("x")
            fits = work.save(fits.groupBy("grp").agg(best).select("grp", "x.*"), "best")
        if step + 1 >= TRIAL and (fall is None or fall <= TOLERANCE):
            break
    p = len(NAMES)
    inside = near(fits).filter(F.col("_d") <= consistency(SUPPORT, p) * chi_squared_quantile(REWEIGHT, p))
    return work.save(factored(_moments(inside), consistency(REWEIGHT, p)), "final")


def mcd_verdicts(stats: DataFrame, work: Work) -> DataFrame:
    """Adds distance (null without an estimate) and outlier. stats come from text_statistics and are read several times."""
    own = F.to_json(F.struct("lang", "source"))
    stats = stats.drop("grp", "distance", "outlier").withColumns(vector() | {"_own": own})
    sizes = stats.groupBy("_own").agg(F.count("*").alias("n"))
    known = work.save(sizes.filter(F.col("n") >= MIN_GROUP).select("_own", F.col("_own").alias("grp")), "groups")
    v = work.save(stats.join(known, "_own", "left").withColumn("grp", F.coalesce("grp", F.lit(""))).drop("_own"), "vectors")
    pool = v.filter("grp = ''").limit(MIN_POOL).count() >= MIN_POOL
    fits = fit_mcd(v.select("grp", *NAMES) if pool else v.filter("grp <> ''").select("grp", *NAMES), work)
    out = v.join(fits.select("grp", "_c", "_l"), "grp", "left").withColumn("distance", _squared_distance())
    return out.withColumn("outlier", F.coalesce(F.col("distance") > CUTOFF, F.lit(False))).drop("grp", "_c", "_l", *NAMES)


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns of docs, the base counts, base_failed, distance and kept."""
    docs = docs.withColumns({c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")})
    cols = list(dict.fromkeys([*keep, "lang", "source"]))
    if clash := {*cols} & {*COUNTS}:
        raise ValueError(f"columns to keep have names of added ones: {sorted(clash)}")
    stats = text_statistics(docs.select(*dict.fromkeys([*cols, "text"]))).select(*cols, *COUNTS)
    work = Work(docs.sparkSession, "rules")
    v = mcd_verdicts(work.save(stats, "counts"), work)
    work.drop("counts")
    return v.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier")).select(*keep, *BASE, "base_failed", "distance", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, ["doc_id"]).select("doc_id", *BASE, "base_failed", "kept", "distance")
