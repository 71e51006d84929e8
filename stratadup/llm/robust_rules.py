"""Quality rules with robust multivariate outliers, in DataFrame and SQL functions only.

Every document gets counts; counts become a vector of transformed statistics, rounded to whole
thousandths so that all sums over documents are exact and do not depend on their order. Every
language, and every source of it, has a minimum-covariance-determinant estimate: from several
starts (the coordinatewise medians, and the parts of the documents with the same remainder of a
number made from the vector) concentration steps keep the `core` share of documents nearest in
Mahalanobis distance and take their mean and covariance. After `trial` steps the start whose
covariance has the least determinant goes on until no group's core changes, `steps` steps at
most. A document is rejected when its distance from its group's estimate exceeds `cutoff`,
scaled so that the core's covariance is consistent for normal data.

A source's mean and covariance are shrunk towards its language's, which counts for `prior`
documents: a small source leans on its language, a large one on itself, with no step between.
Languages do not mix. Documents of a language with fewer than `least` documents, five for each
statistic, get no verdict beyond the base rules.

Distances are ranked on a fixed logarithmic grid, so the size of the core is met to within one
grid cell and no group of any size is sorted or gathered in one task. Estimates, one row per
group and start, are broadcast when they are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratadup.llm.durable import Scratch, durable
from stratadup.llm.textkit import pick

WORD = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
VECTOR = ("v_length", "v_symbol", "v_line", "v_repeat")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the base rules, and the estimator's parameters.

    `consistency` scales the core's covariance: the core share over the probability that a
    chi-square of six degrees of freedom lies below the core quantile of one of four.
    `cutoff` is the 99.9 % point of chi-square of four degrees of freedom. `floor` is added to
    each variance (thousandths squared), so that coordinates that are constant in most documents
    have a scale: about one step of the statistic in a long document, which is 1 % of the mean
    word length, a symbol in 2,500 characters, a repeated line or word in 280. Alone, 1.1 % of
    symbols, 10 % of repeated lines or 10 % of repeated words reject, where most have none.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    core: float = 0.75
    parts: int = 3
    trial: int = 2
    steps: int = 10
    cutoff: float = 18.467
    consistency: float = 1.485
    floor: tuple[float, float, float, float] = (10.0**2, 20.0**2, 60.0**2, 60.0**2)
    prior: float = 10.0
    least: int = 20
    grid: int = 16
    broadcast_rows: int = 100_000
    single_task: int = 1_000
    rows_a_task: int = 50_000


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Window hashes are sorted with their positions; neighbours with equal hashes repeat. The
    sort is skipped when all hashes differ.
    """
    return F.expr(
        """
        case when size(h) = size(array_distinct(h)) then 0L
        else cast(size(array_distinct(flatten(transform(
            transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
                filter(s, (e, k) -> (k > 0 and s[k - 1].x = e.x) or (k + 1 < size(s) and s[k + 1].x = e.x)))[0],
            e -> array(e.i, e.i + 1, e.i + 2))))) as long) end
        """
    )


def measure(docs: DataFrame, rules: Rules, keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every document, its language and group, and the columns `keep` as keep0,
    keep1 and so on; null texts have no words. Null languages and sources are values like others."""
    docs = pick(docs, "doc_id", "text", "lang", "source", *keep)
    docs = docs.toDF("doc_id", "text", "lang", "source", *[f"keep{i}" for i in range(len(keep))])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [f"keep{i}" for i in range(len(keep))]
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("lang", "source"))
    rows = docs.select("doc_id", lang.alias("language"), F.concat(F.length(lang), lang, source).alias("pool"), text.alias("t"), *kept)
    rows = rows.withColumn("w", F.filter(F.split(F.col("t"), SPACE), lambda x: x != ""))
    rows = rows.withColumn("h", F.expr("case when size(w) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(WORD))
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.regexp_replace("t", SPACE, "")),
        "n_symbols": F.length("t") - F.length(F.translate("t", "#*$%&|<>", "")),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0],
        "n_lines": F.size(lines),
        "n_repeat_words": _repeat_words(),
    }
    # a generator of one row, so that no later filter or column repeats the counting
    once = F.explode(F.array(F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])))
    rows = rows.select("doc_id", "language", "pool", *kept, once.alias("c")).select("doc_id", "language", "pool", *kept, "c.*")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vector(rows: DataFrame) -> DataFrame:
    """Transformed statistics in whole thousandths: mean word length (logarithm), and the square
    roots of symbols per character, of repeated lines and of repeated words."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    out = {
        "v_length": F.log(chars / words),
        "v_symbol": F.sqrt(F.col("n_symbols") / chars),
        "v_line": F.sqrt(F.col("n_dup_lines") / lines),
        "v_repeat": F.sqrt(F.col("n_repeat_words") / words),
    }
    return rows.withColumns({k: F.floor(v * 1000 + 0.5).cast("long") for k, v in out.items()})


def _moments() -> list[Column]:
    """Exact sums of coordinates and of their products, over weighted vectors."""
    w, out = F.col("weight"), [F.sum("weight").alias("n")]
    for i, a in enumerate(VECTOR):
        out.append(F.sum(w * F.col(a)).alias(f"s{i}"))
        out += [F.sum(w * F.col(a) * F.col(b)).alias(f"q{i}{j}") for j, b in enumerate(VECTOR[: i + 1])]
    return out


D = range(len(VECTOR))
PAIRS = [(i, j) for i in D for j in range(i + 1)]
MEANS, COVARIANCES, FACTOR = [f"m{i}" for i in D], [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]
KEY = ["pool", "start"]


def _factor(rules: Rules) -> list[str]:
    """The Cholesky factor of the floored covariance, and the root of its determinant; a column may
    use those before it in the list."""
    out = []
    for i, j in PAIRS:
        cov = f"(c{i}{j} + {rules.floor[i] if i == j else 0.0}D)"
        for k in range(j):
            cov = f"({cov} - l{i}{k} * l{j}{k})"
        out.append(f"{f'sqrt({cov})' if i == j else f'{cov} / l{j}{j}'} as l{i}{j}")
    return [*out, f"{' * '.join(f'l{i}{i}' for i in D)} as root"]


def _estimated(moments: DataFrame, priors: DataFrame | None, rules: Rules) -> DataFrame:
    """Means, covariances and factors from moments, shrunk towards the language's where there are priors."""
    means = [f"cast(s{i} as double) / cast(n as double) as m{i}" for i in D]
    # n q - s s is a whole number; decimals hold it exactly
    whole = lambda c: f"cast({c} as decimal(19,0))"
    cov = [f"cast({whole('n')} * {whole(f'q{i}{j}')} - {whole(f's{i}')} * {whole(f's{j}')} as double) / cast(n as double) / cast(n as double) as c{i}{j}" for i, j in PAIRS]
    rows = moments.selectExpr(*KEY, "n", *means, *cov)
    if priors is not None:
        shrunk = [f"(cast(n as double) * {c} + {rules.prior}D * p_{c}) / (cast(n as double) + {rules.prior}D) as {c}" for c in MEANS + COVARIANCES]
        rows = rows.join(priors, "pool").selectExpr(*KEY, "n", *shrunk)
    return rows.selectExpr(*KEY, "n", *MEANS, *COVARIANCES, *_factor(rules))


def _medians(slim: DataFrame, rules: Rules) -> DataFrame:
    """Coordinatewise medians and quartile ranges. Values lie on a bounded grid of whole numbers,
    so the exact percentiles need memory for the grid only."""
    quartiles = [F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("weight")).alias(f"p{i}") for i, v in enumerate(VECTOR)]
    rows = slim.groupBy("pool").agg(F.sum("weight").alias("n"), *quartiles)
    scale = [f"((p{i}[2] - p{i}[0]) / 1.349D)" for i in D]
    cov = [f"{scale[i]} * {scale[i]} as c{i}{j}" if i == j else f"0.0D as c{i}{j}" for i, j in PAIRS]
    rows = rows.selectExpr("pool", "0 as start", "n", *[f"p{i}[1] as m{i}" for i in D], *cov)
    return rows.selectExpr(*KEY, "n", *MEANS, *COVARIANCES, *_factor(rules))


def _distance() -> Column:
    """The squared Mahalanobis distance, by forward substitution."""
    z: list[str] = []
    for i, name in enumerate(VECTOR):
        v = f"({name} - m{i})"
        for k in range(i):
            v = f"({v} - l{i}{k} * {z[k]})"
        z.append(f"({v} / l{i}{i})")
    return F.expr(" + ".join(f"{x} * {x}" for x in z))


def _small(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows


def _few(rows: DataFrame, limit: int) -> bool:
    return rows.limit(limit + 1).count() <= limit


def _concentrate(slim: DataFrame, estimate: DataFrame, priors: DataFrame | None, rules: Rules, groups: int) -> DataFrame:
    """One step: the moments of the documents nearest to the present estimate.

    Moments are summed for every cell of the grid of distances; a group's cells up to the one that
    completes the core are summed once more."""
    cell = F.floor(F.log(_distance() + 0.001) * rules.grid).cast("long")
    present = _small(estimate.select(*KEY, *MEANS, *FACTOR), groups <= rules.broadcast_rows)
    cells = slim.join(present, "pool").select(*KEY, *VECTOR, "weight", cell.alias("cell")).groupBy(*KEY, "cell").agg(*_moments())
    by_pool = Window.partitionBy(*KEY)
    before = F.sum("n").over(by_pool.orderBy("cell")) - F.col("n")
    cells = cells.withColumn("before", before).withColumn("all", F.sum("n").over(by_pool))
    core = cells.where(F.col("before") < F.ceil(rules.core * F.col("all")))
    sums = ["n"] + [f"s{i}" for i in D] + [f"q{i}{j}" for i, j in PAIRS]
    after = _estimated(core.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in sums]), priors, rules)
    return durable(after.coalesce(1) if groups <= rules.single_task else after)


def _digest(estimate: DataFrame) -> tuple:
    """Tells estimates apart: their number, and the sums of two hashes."""
    sums = [F.sum(F.xxhash64(F.lit(k), *KEY, "n", *MEANS, *COVARIANCES).cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(estimate.agg(F.count("*"), *sums).first())


def _determinant(slim: DataFrame, priors: DataFrame | None, rules: Rules) -> DataFrame:
    """Every pool's estimate of least determinant, from rows (pool, statistics, weight)."""
    residue = F.pmod(F.col("v_length") + 3 * F.col("v_symbol") + 5 * F.col("v_line") + 7 * F.col("v_repeat"), F.lit(rules.parts))
    parts = slim.withColumn("start", (residue + 1).cast("int")).groupBy(*KEY).agg(*_moments())
    estimate = durable(_medians(slim, rules).unionByName(_estimated(parts, priors, rules)))
    groups = estimate.count()
    for _ in range(rules.trial):
        estimate = _concentrate(slim, estimate, priors, rules, groups)
    best = estimate.groupBy("pool").agg(F.min(F.struct("root", "start")).alias("b")).select("pool", F.col("b.start").alias("start"))
    estimate = durable(estimate.join(best, KEY))
    mark = None
    for step in range(rules.trial, rules.steps):
        if (step - rules.trial) % 2 == 0:
            before, mark = mark, _digest(estimate)
            if mark == before:
                break
        estimate = _concentrate(slim, estimate, priors, rules, groups)
    return estimate


def estimate_pools(measured: DataFrame, rules: Rules) -> DataFrame:
    """Every (language, source)'s estimate, from measured documents that pass the base rules.
    Equal vectors fold into one weighted row before the steps."""
    good = vector(measured.where(~F.col("base_failed")))
    slim = durable(good.groupBy("language", "pool", *VECTOR).agg(F.count("*").alias("weight")))
    enough = slim.groupBy("language").agg(F.sum("weight").alias("n")).where(F.col("n") >= rules.least).select("language")
    enough = durable(enough)
    slim = durable(slim.join(_small(enough, _few(enough, rules.broadcast_rows)), "language"))
    slim = slim.coalesce(max(1, slim.count() // rules.rows_a_task))
    of_language = _determinant(slim.drop("pool").withColumnRenamed("language", "pool"), None, rules)
    names = MEANS + COVARIANCES
    priors = slim.select("pool", "language").distinct().join(of_language.select(F.col("pool").alias("language"), *[F.col(c).alias(f"p_{c}") for c in names]), "language").drop("language")
    return _determinant(slim.drop("language"), durable(priors), rules)


def apply_estimates(measured: DataFrame, estimate: DataFrame, rules: Rules) -> DataFrame:
    """Measured documents with `distance` and `kept`."""
    rows = vector(measured).join(_small(estimate.select("pool", *MEANS, *FACTOR), _few(estimate, rules.broadcast_rows)), "pool", "left")
    rows = rows.withColumn("distance", _distance() / F.lit(rules.consistency))
    far = F.coalesce(F.col("distance") > rules.cutoff, F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far).drop(*MEANS, *FACTOR)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measured documents with `distance` (scaled squared robust distance; null without a verdict)
    and `kept`.

    A row is a document, rows that repeat an id or have none included; null and empty texts fail
    the base rules, long texts are measured whole. Null languages and sources are values like
    others. Documents at the same distance have the same verdict. An empty table gives an empty
    result. Further columns of the table are ignored, whatever their names.
    """
    measured = durable(measure(docs, rules))
    return apply_estimates(measured, estimate_pools(measured, rules), rules)


def accepted(docs: DataFrame, keep: tuple[str, ...], rules: Rules = Rules()) -> DataFrame:
    """The columns `keep` of the documents that are kept, row by row. They are written with the
    counts once, so that texts are measured once and travel through no shuffle; the result reads
    that table in the shared folder."""
    measured = Scratch(docs.sparkSession).keep(measure(docs, rules, keep))
    rows = apply_estimates(measured, estimate_pools(measured, rules), rules).where("kept")
    return rows.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])


def report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The counts and the verdict of every document."""
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
