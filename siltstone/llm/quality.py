"""Quality rules: fixed limits plus robust multivariate outliers.

Per language and source, the minimum-covariance-determinant (MCD) estimate of centre and scatter of a vector
of transformed text statistics is found by concentration steps; documents whose Mahalanobis distance to
that centre is beyond a chi-square quantile are rejected. DataFrame functions only.

The steps (all over every row, by aggregates that combine map-side):
  two starts: medians with median absolute deviations; mean and covariance of the half nearest to these;
  concentration, for both starts: the share COVERAGE of a cell's rows that is nearest gives the next mean and covariance, until
  no cell's determinant falls any more; the smaller determinant wins;
  consistency: the scatter is scaled to what a normal law of that core has;
  reweighting: mean and covariance of the rows within the 0.975 quantile, made consistent again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

COVERAGE = 0.75
#: A step must lower the logarithm of a determinant by so much, else the estimate has settled.
SETTLED = 1e-3
#: Rows that a (language, source) cell needs for its own estimate; smaller ones are pooled: per language, then over
#: languages, then with all rows.
MIN_CELL = 60
#: Cells of the small languages together, and of all rows; others are JSON objects.
REST, ALL = "rest", "all"
#: The vector's statistics, each with the standard deviation of the prior scatter and the least one that counts. The prior weighs as much
#: as PRIOR_ROWS rows, so it matters in small cells only. Shares that are zero in nearly all documents have no scatter of
#: their own: the least one stands for it, and the scatter can be inverted.
FEATURES = {"mean_word": (0.03, 1e-4), "symbol_share": (0.0, 0.25), "dup_share": (0.0, 0.15), "repeat_share": (0.0, 0.15), "upper_share": (0.012, 1e-4)}
PRIOR_ROWS = 20
#: Words of 5.1 letters, and letters of which 0.0165 are capitals, that are added to each document, so that its rates scatter alike whether it is short or long.
USUAL_WORDS, WORD_CHARS, USUAL_CHARS, UPPER = 60, 5.1, 300, 0.0165
#: Of chi-square with 5 degrees of freedom: the 0.975 quantile, and the consistency factors of a core of 0.75 and of 0.975.
CHI_975, FACTOR_CORE, FACTOR_975 = 12.8325, 1.4117, 1.0554
#: Squared distance beyond which a document is rejected: the quantile at 1 - 1e-6.
CUTOFF = 35.888


def _strip(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words_of(text: Column) -> Column:
    """ASCII-white-space separated words of a non-null text."""
    return F.array_remove(F.split(text, "[ \t-\r]+"), "")


def _window_hashes(words: Column) -> Column:
    n = F.size(words)
    at = F.when(n >= WINDOW, F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more; equal windows are found by their whole text."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("g"), i.alias("i")),
    )
    ordered = F.array_sort(windows)

    def starts(a: Column) -> Column:
        same = lambda x, k, step: F.coalesce(F.get(a, k + step)["g"] == x["g"], F.lit(False))
        twice = F.filter(a, lambda x, k: same(x, k, F.lit(1)) | same(x, k, F.lit(-1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        gaps = F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    # one-element arrays bind intermediate results to a name, so each is computed once
    return F.get(F.transform(F.transform(F.array(ordered), starts), covered), F.lit(0))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the transformed statistics.

    A null or empty text has no words: all counts 0 and base_failed true. Whole texts are read, whatever their length.
    """
    rows = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words_of(F.col("_t")))
    rows = rows.withColumn("_h", _window_hashes(F.col("_w")))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)
    rows = rows.withColumn("_l", lines)
    n, chars = F.col("n_words").cast("double"), F.greatest(F.col("word_chars").cast("double"), F.lit(1.0))
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), n), F.lit(0.0))
    out = rows.select(
        *[F.col(c) for c in df.columns],
        F.size("_w").cast("long").alias("n_words"),
        F.length(_strip(F.col("_t"), SPACE)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_strip(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _repeat_words(F.col("_w"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("_lines"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))).cast("long").alias("_upper"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.select(
        "*",
        F.log((F.col("word_chars") + USUAL_WORDS * WORD_CHARS) / (n + USUAL_WORDS)).alias("mean_word"),
        F.log1p(100.0 * F.col("n_symbols") / chars).alias("symbol_share"),
        F.sqrt(F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("_lines").cast("double")), F.lit(0.0))).alias("dup_share"),
        F.sqrt(per_word("n_repeat_words")).alias("repeat_share"),
        F.sqrt((F.col("_upper") + USUAL_CHARS * UPPER) / (F.col("word_chars") + USUAL_CHARS)).alias("upper_share"),
    ).drop("_lines", "_upper")


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _moments(features: list[str]) -> list[Column]:
    return [F.count("*").alias("_n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in _pairs(len(features))]]


def _factor(cells: DataFrame, features: dict[str, tuple[float, float]], scale: float = 1.0) -> DataFrame:
    """Replaces _n and the covariances c{i}_{j} (times scale) by the lower Cholesky factor l{i}_{j} of the scatter, prior and least deviations included,
    and by logdet, the logarithm of its determinant."""
    p, out, n = len(features), cells, F.col("_n")
    for i, (prior, least) in enumerate(features.values()):
        for j in range(i + 1):
            rest = F.coalesce(F.col(f"c{i}_{j}"), F.lit(0.0)) * scale * n / (n + PRIOR_ROWS)
            if i == j:
                rest = rest + F.lit(PRIOR_ROWS * prior**2) / (n + PRIOR_ROWS) + F.lit(least**2)
            rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), rest)
            # rounding may leave a little less than the least
            value = F.sqrt(F.greatest(rest, F.lit(least**2 * 0.5))) if i == j else rest / F.col(f"l{j}_{j}")
            out = out.withColumn(f"l{i}_{j}", value)
    logdet = reduce(lambda a, i: a + 2 * F.log(f"l{i}_{i}"), range(p), F.lit(0.0))
    return out.withColumn("logdet", logdet).drop("_n", *[f"c{i}_{j}" for i, j in _pairs(p)])


def _distance(rows: DataFrame, cells: DataFrame, features: list[str], *more: str) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their cell's estimate (null without one), and more columns of cells.
    cells is a stored table of few rows per cell: Spark knows its size, and broadcasts it or not by that."""
    p, out = len(features), rows.join(cells, ["cell"], "left")
    for i, f in enumerate(features):
        rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"_y{k}"), range(i), F.col(f) - F.col(f"m{i}"))
        out = out.withColumn(f"_y{i}", rest / F.col(f"l{i}_{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(p)])
    return out.select(*[F.col(c) for c in rows.columns], d2.alias("d2"), *more)


def fit_cells(rows: DataFrame, features: dict[str, tuple[float, float]], coverage: float = COVERAGE) -> DataFrame:
    """MCD estimate of every cell: (cell, m*, l*_*, logdet). rows: stored, with cell and the features.

    Each step is two aggregates by cell over all rows, combined map-side, so a cell with a third of the rows
    costs no more than others. Estimates are stored after each step; one row per cell and start. Steps end, since a determinant
    that doesn't fall by SETTLED keeps its estimate and none falls below that of the least deviations.
    """
    names = list(features)
    p = len(names)
    state = [*[f"m{i}" for i in range(p)], *[f"l{i}_{j}" for i, j in _pairs(p)], "logdet"]
    middle = materialize(rows.groupBy("cell").agg(*[F.percentile_approx(f, 0.5, 2000).alias(f"m{i}") for i, f in enumerate(names)]), "mcd")
    spread = rows.join(middle, "cell").groupBy("cell").agg(
        F.count("*").alias("_n"), *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 2000).alias(f"_s{i}") for i, f in enumerate(names)]
    )
    plain = middle.join(spread, "cell").select(
        "cell", "_n", *[f"m{i}" for i in range(p)], *[(F.pow(1.4826 * F.col(f"_s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _pairs(p)],
    )
    plain = materialize(_factor(plain, features).select("cell", F.lit(0).alias("start"), *state), "mcd")

    def step(now: DataFrame, share: float) -> DataFrame:
        """The estimates from the nearest share of each cell's rows."""
        cut = _distance(rows, now, names, "start").groupBy("cell", "start").agg(F.percentile_approx("d2", share, 2000).alias("_cut"))
        # estimates and their cuts are stored together, so that rows meet them in one join with a small table and aren't moved
        both = materialize(now.join(cut, ["cell", "start"]), "mcd")
        inside = _distance(rows, both, names, "start", "_cut").where(F.col("d2") <= F.col("_cut"))
        return _factor(inside.groupBy("cell", "start").agg(*_moments(names)), features).select("cell", "start", *state)

    half = materialize(step(plain, 0.5), "mcd").withColumn("start", F.lit(1))
    # the first determinants aren't of a core, so the first step counts whatever it does to them
    now = materialize(step(materialize(plain.unionByName(half), "mcd"), coverage), "mcd")
    moved = True
    while moved:
        new = step(now, coverage).select("cell", "start", F.struct(*state).alias("_new"))
        falls = F.col("_new.logdet") < F.col("logdet") - SETTLED
        pick = lambda c: F.when(F.col("falls"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        both = now.join(new, ["cell", "start"]).withColumn("falls", falls)
        both = materialize(both.select("cell", "start", *[pick(c) for c in state], "falls"), "mcd")
        moved, now = not both.where("falls").isEmpty(), both.drop("falls")
    best = now.groupBy("cell").agg(F.min(F.struct("logdet", "start", *[c for c in state if c != "logdet"])).alias("b")).select("cell", *[F.col(f"b.{c}").alias(c) for c in state])
    best = materialize(best, "mcd")
    core = _distance(rows, best, names).where(F.col("d2") <= CHI_975 * FACTOR_CORE)
    return materialize(_factor(core.groupBy("cell").agg(*_moments(names)), features, FACTOR_975).select("cell", *state), "mcd")


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", id_column: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: id, the statistics, base_failed, d2 (robust squared distance; null only where
    base_failed and nothing of the cell passed), kept, and the columns carry as they are.

    kept is false where base_failed or d2 > CUTOFF; equal rows have equal verdicts. Estimates are made from the rows that pass the base rule, per
    language and source; cells with fewer than MIN_CELL such rows are pooled per language, languages whose pool is smaller
    still are pooled together, and if that is too small all rows stand for it, however few they are: every document
    that passes the base rule has a distance. A null language or source is a value of its own. Repeated
    rows count each. A null or empty text fails the base rule; texts of any length are read whole. An empty df gives no rows. Columns beyond
    those named aren't read, whatever their names.
    """
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text"), *carry)
    stats = materialize(text_statistics(narrow, "_text").drop("_text"), "quality")
    key = lambda *c: F.to_json(F.struct(*[F.coalesce(F.col(x), F.lit("\x00")).alias(x) for x in c]))
    good = stats.where(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    small = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    own = sizes.withColumn("_pool", F.col("_n") < MIN_CELL)
    own = materialize(own.withColumn("_rest", F.col("_pool") & (small(F.col("_pool")).over(Window.partitionBy("lang")) < MIN_CELL)), "quality-cells")
    left = own.where("_rest").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    cells = materialize(
        own.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                   F.when(~F.col("_pool"), key("lang", "source")).when(~F.col("_rest"), key("lang")).otherwise(F.lit(REST if left >= MIN_CELL else ALL)).alias("cell")),
        "quality-cells",
    )
    both = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = stats.join(cells, both, "left").drop("_lang", "_source")
    passed = rows.where(~F.col("base_failed")).select("cell", *FEATURES)
    if not cells.where(F.col("cell") == ALL).isEmpty():  # that cell is made from the rows of all others too
        passed = passed.unionByName(passed.where(F.col("cell") != ALL).withColumn("cell", F.lit(ALL)))
    fitted = fit_cells(materialize(passed, "quality-rows"), FEATURES)
    out = _distance(rows, fitted, list(FEATURES))
    far = F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("cell")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", *FEATURES)
