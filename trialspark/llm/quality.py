"""Quality rules with risk-controlled thresholds.

Counts per text are built-in array functions. Each metric may reject a text at or above a cutoff. Cutoffs come from
labelled holdouts: per stratum (a class of text length) and metric, those of a fixed grid whose false rejection rate
among good texts is proven to be small by the exact binomial tail. False rejections only grow as a cutoff falls, so cutoffs
are tested from the highest down to the first failure, which needs no correction among them; the error is shared out
over strata and metrics (Bonferroni), and the risk over metrics, as one text may break any of their rules. Of the
proven cutoffs the one with most bad less good texts rejected is taken. Without proof nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, let, prepare, restored, words, written

#: Most of the good texts that the rules together may reject falsely, and how sure that must be.
RISK, ERROR = 0.04, 0.05
#: Strata: texts of fewer words than each bound, and the rest.
LENGTHS = (200, 1000)
#: Each metric is a ratio; the cutoffs tried are 1/STEPS, 2/STEPS, ...
STEPS = 50
METRICS = ("symbols", "shouts", "capitals", "repeats")


def _counted(text: Column, drop: str) -> Column:
    """Characters that remain when runs of the class `drop` go."""
    return F.length(F.regexp_replace(text, drop, ""))


def repeat_words(ws: Column) -> Column:
    """Words inside three-word windows met twice or more in the text, the first meeting included.

    Windows sorted by their hash lie next to their equals; places of repeated ones, sorted, cover up to three words each.
    """
    def covered(windows: Column) -> Column:
        n = F.size(windows)
        twice = F.filter(windows, lambda x, i: ((i > 0) & (F.get(windows, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(windows, i + 1)["h"] == x["h"])))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])),
                   lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
                                          F.lit(0).cast("long"), lambda a, b: a + b))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows(ws)), covered))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct `_q` of counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more for the metrics."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of(ws: Column) -> Column:
        dup_lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _counted(t, r"[^#*$%&|<>]+").cast("long").alias("n_symbols"), repeat_words(ws).alias("n_repeat_words"),
            dup_lines.cast("long").alias("n_dup_lines"), _counted(t, r"[^!]+").alias("shouts"), _counted(t, r"[^A-Z]+").alias("capitals"))

    return docs.withColumn("_q", let(words(F.col(text)), of))


def _metrics(q: Column) -> dict[str, Column]:
    chars, n = F.greatest(q["word_chars"], F.lit(1)), F.greatest(q["n_words"], F.lit(1))
    return {"symbols": q["n_symbols"] / chars, "shouts": q["shouts"] / n, "capitals": q["capitals"] / chars, "repeats": q["n_repeat_words"] / n}


def _steps(q: Column) -> Column:
    """Per metric, the highest cutoff that the text reaches, in 1/STEPS."""
    return F.array(*[F.least(F.floor(v * STEPS), F.lit(STEPS)).cast("int") for v in _metrics(q).values()])


def _stratum(q: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for k in range(len(LENGTHS) - 1, -1, -1):
        out = F.when(q["n_words"] < LENGTHS[k], F.lit(k)).otherwise(out)
    return out


def ln_factorial(n: Column) -> Column:
    """ln n!: exact to n = 20, Stirling's series beyond."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * F.lit(3.141592653589793) * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, for k below its mean; 1 from there on.

    Below the mean each term is smaller than the next, so summing downward from k ends within about 40 standard
    deviations: what is left out is below the last digit of a double.
    """
    top = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * F.lit(p))) + 40).cast("long")
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1))), start, add)["sum"]).otherwise(1.0)
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(top * total)


def cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, metric, cutoff) of the rules that are proven, at most one per stratum and metric; ties go to the higher cutoff.

    stats: (id, _q). labels: id and 1 for good, 0 for bad; ids with null or contradicting labels are not used, repeats count once.
    At most strata x metrics x STEPS rows are ever compared, whatever the corpus.
    """
    tests = (len(LENGTHS) + 1) * len(METRICS)
    each = risk / len(METRICS)  # rejections by different metrics add up to at most `risk`
    known = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label).alias("_good"), F.max(label).alias("_most")).where("_good = _most").select("_id", "_good"))
    reached = stats.select(F.col(id_col).alias("_id"), _stratum(F.col("_q")).alias("stratum"), _steps(F.col("_q")).alias("_steps")).join(known, "_id")
    counts = (reached.select("stratum", "_good", F.posexplode("_steps").alias("metric", "_step")).groupBy("stratum", "metric", "_step")
              .agg(F.sum(F.col("_good").cast("long")).alias("_g"), F.sum(1 - F.col("_good").cast("long")).alias("_b")))
    by_rule = counts.groupBy("stratum", "metric").agg(F.sum("_g").alias("n"), F.collect_list(F.struct("_step", "_g", "_b")).alias("_seen"))
    tried = by_rule.select("stratum", "metric", "n", "_seen", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("cutoff"))

    def rejected(what: str) -> Column:
        return F.aggregate("_seen", F.lit(0).cast("long"), lambda a, x: a + F.when(x["_step"] >= F.col("cutoff"), x[what]).otherwise(0))

    judged = tried.select("stratum", "metric", "cutoff", "n", rejected("_g").alias("k"), rejected("_b").alias("caught"))
    passes = (F.col("n") > 0) & (binomial_tail(F.col("k"), F.col("n"), each) <= error / tests)
    # A lower cutoff rejects all that a higher one does, so the tail grows downward: those that pass are the tested ones.
    gain = F.struct((F.col("caught") - F.col("k")).alias("gain"), "cutoff")
    best = judged.where(passes & (F.col("caught") > F.col("k"))).groupBy("stratum", "metric").agg(F.max(gain).alias("_best"))
    return best.select("stratum", "metric", F.col("_best.cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", risk: float = RISK, error: float = ERROR,
           carry: bool = False) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), or with `carry` all columns and those.

    A text fails the base rules with fewer than 50 words or with over half of its words inside repeated three-word windows;
    a text that passes is kept unless it reaches a proven cutoff. A null or empty text has no words and fails. Ties at a
    cutoff reject. Repeated rows are judged alike. Without labels only the base rules decide. With `carry`, columns of `docs` that
    bear the names of results are replaced.
    """
    prepare(docs.sparkSession)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows, named = aside(docs)
    keep = {c: n for c, n in named.items() if (c not in new if carry else c == id_col)}
    stats = written(counted(rows, named[text]).select(*keep.values(), "_q"), "quality")
    # A row per stratum at most: bounded by the number of strata.
    rules = (cutoffs(stats.select(F.col(named[id_col]).alias(id_col), "_q"), labels, id_col, label, risk, error).groupBy("stratum")
             .agg(F.map_from_entries(F.collect_list(F.struct("metric", "cutoff"))).alias("_rules")))
    q = F.col("_q")
    met = stats.withColumn("stratum", _stratum(q)).join(F.broadcast(rules), "stratum", "left")
    base = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    breaks = F.exists(F.transform(_steps(q), lambda s, m: s >= F.coalesce(F.try_element_at(F.col("_rules"), m), F.lit(STEPS + 1))), lambda b: b)
    told = met.select(*keep.values(), *[q[c].alias(c) for c in new[:5]], base.alias("base_failed"), (~base & ~F.coalesce(breaks, F.lit(False))).alias("kept"))
    return restored(told, keep, new)
