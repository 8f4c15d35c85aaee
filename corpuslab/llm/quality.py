"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Every rule is a ratio in 0..1 that is high for junk. For each stratum (language) and rule, the
good documents of a labelled holdout bound the share of good documents that a cutoff rejects:
with n good documents, a cutoff that rejects x of them is allowed if
``P(Binomial(n, alpha) <= x) <= delta / tests``, the exact (Clopper-Pearson) test; ``tests`` is
the number of strata times rules (Bonferroni). Cutoffs lie on a fixed grid, so counting is one
partial aggregation, and among the allowed cutoffs the one with most rejected bad documents
less ``penalty`` times the rejected good ones is taken, on ties the most lenient.
A stratum with too few good documents to prove any cutoff keeps its documents, unless such strata
are pooled (``pool``): then they are tested together, as one stratum, at the level of every other
test. The pool makes one test per rule where its strata would make one each, so the total error
share still holds; for the pool's strata ``alpha`` bounds the good documents of the pool, not of each.

Defined results: a null or blank text has no words and fails the base rules; a null stratum is
the stratum ''; labels that are null or of unknown documents are ignored; a document labelled
twice is good only if no label calls it bad; without labels only the base rules decide.
Extra columns pass through; input columns named _s, base_failed or kept are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from corpuslab.llm.common import SPACES, numbered, word_array
from corpuslab.plans.scale import compute_once, cut_lineage, measured

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "capitals", "exclaims", "dup_lines", "repeats")
GRID = 200
#: Per rule and stratum: at most this share of good documents, with this total error probability.
ALPHA, DELTA, PENALTY = 0.01, 0.05, 10
MIN_WORDS = 50
#: Up to so many different repeated windows a scan finds their places, beyond it a sort.
FEW = 16


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_s``, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    the further counts that the rules use. No shuffle: everything is computed within the row.

    Repeated windows: hashes of 3-word windows are sorted with their position, neighbours with
    equal hashes are repeated, and the covered words follow from the gaps between positions;
    n log n in the words of one text."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    rows, back = numbered(docs.drop("_s"))
    rows = rows.withColumn("_text", F.col(back[text]))
    step = compute_once(rows, _words=word_array("_text"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = compute_once(
        step, _grams=_window_hashes("_words"), _lines=lines, _n=F.size("_words").cast("long"),
        _chars=F.length(F.array_join("_words", "")).cast("long"),
    ).drop("_words")
    step = compute_once(step, _pairs=F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array("_grams")))
    step = compute_once(step, _twice=F.array_distinct(F.filter(
        "_pairs", lambda g, i: F.coalesce(F.get("_pairs", i + 1) == g, F.lit(False))))).drop("_pairs")
    few = F.size("_twice") <= FEW
    step = compute_once(step, _sorted=F.when(~few, F.sort_array(
        F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    hit = lambda x, i, d: F.coalesce(F.get("_sorted", i + d)["g"] == x["g"], F.lit(False))
    by_scan = F.filter(
        F.transform("_grams", lambda g, i: F.when(F.array_contains("_twice", g), i)), lambda i: i.isNotNull())
    by_sort = F.sort_array(F.transform(
        F.filter("_sorted", lambda x, i: hit(x, i, -1) | hit(x, i, 1)), lambda x: x["i"]))
    step = compute_once(step, _starts=F.when(few, by_scan).otherwise(by_sort)).drop("_sorted", "_twice", "_grams")
    covered = F.aggregate(
        F.transform("_starts", lambda s, i: F.least(
            F.lit(3), F.coalesce(F.get("_starts", i + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    step = compute_once(step, _s=F.struct(
        F.col("_n").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(body, F.lit("!")).cast("long").alias("n_exclaims"),
    ))
    return step.select(*(F.col(n).alias(c) for c, n in back.items()), "_s")


def _window_hashes(words: str) -> Column:
    """A hash of every 3-word window, in order."""
    n = F.size(words)
    windows = F.arrays_zip(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))), F.slice(words, 2, F.greatest(n - 2, F.lit(0))),
        F.slice(words, 3, F.greatest(n - 2, F.lit(0))))
    return F.transform(windows, lambda w: F.xxhash64(w))


def base_failed(s: str = "_s") -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def rule_bins(s: str = "_s") -> Column:
    """One grid value 0..GRID per rule, in the order of RULES."""
    ratio = lambda x, of: F.floor(F.lit(GRID) * F.col(f"{s}.{x}") / F.greatest(F.col(f"{s}.{of}"), F.lit(1))).cast("int")
    return F.array(
        ratio("n_symbols", "word_chars"), ratio("n_capitals", "word_chars"), ratio("n_exclaims", "word_chars"),
        ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"))


def allowed_rejections(n: Column, alpha: float, level: Column) -> Column:
    """The largest x with P(Binomial(n, alpha) <= x) <= level, -1 if there is none: a fold over
    x that adds exp(log pmf), so that it does not underflow for large n."""
    log_odds = F.log(F.lit(alpha)) - F.log1p(F.lit(-alpha))
    start = F.struct((n * F.log1p(F.lit(-alpha))).alias("lp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(a, i):
        cdf = a["cdf"] + F.exp(a["lp"])
        following = a["lp"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double")) + log_odds
        return F.struct(
            F.coalesce(following, F.lit(-1e300)).alias("lp"), cdf.alias("cdf"),
            F.when(cdf <= level, i).otherwise(a["k"]).alias("k"))

    reach = F.sequence(F.lit(0).cast("long"), F.ceil(n * F.lit(alpha)).cast("long"))
    return F.aggregate(reach, start, step, lambda a: a["k"])


def fit_cutoffs(
    scored: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", quality: str = "quality",
    alpha: float = ALPHA, delta: float = DELTA, penalty: float = PENALTY, pool: bool = False,
) -> DataFrame:
    """(stratum, cutoffs array<int> in the order of RULES; GRID + 1 rejects nothing).

    ``scored`` has the key, the stratum and ``_s``. Rows of a stratum exist only where it has
    holdout documents; there are at most (labels) / (least n that proves a cutoff) strata with
    a cutoff of their own. With ``pool`` every stratum with a label can have one: ``judge``
    counts the table before it is broadcast.
    """
    truth = labels.filter(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.min(quality).alias("_good"))
    held = scored.filter(~base_failed()).select(
        key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), rule_bins().alias("_bins"))
    held = held.join(truth, key)
    counts = cut_lineage(held.select("stratum", "_good", F.posexplode("_bins").alias("rule", "bin")).groupBy(
        "stratum", "rule", "bin").agg(  # a row per grid value, read several times below
        F.sum(F.when(F.col("_good") > 0, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_good") > 0, 0).otherwise(1)).alias("bad")))
    limit = lambda n, tests: allowed_rejections(F.col(n), alpha, F.lit(delta) / F.col(tests))
    groups = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"))
    tests = groups.agg(F.count("*").alias("tests"))
    limits = groups.crossJoin(F.broadcast(tests)).select(  # one row beside one row
        "stratum", "rule", "tests", limit("n", "tests").alias("k"))
    members = limits.select("stratum", F.col("stratum").alias("group"), "rule", "k")
    if pool:
        small = F.col("k") < 0  # by the number of its good documents alone, so alike for all rules
        together = groups.join(limits.filter(small), ["stratum", "rule"]).groupBy("rule").agg(
            F.sum("n").alias("n"), F.max("tests").alias("tests")).select("rule", limit("n", "tests").alias("pk"))
        members = limits.join(F.broadcast(together), "rule", "left").select(  # a row per rule
            "stratum", F.when(~small, F.col("stratum")).alias("group"), "rule",
            F.when(small, F.col("pk")).otherwise(F.col("k")).alias("k"))
    members = cut_lineage(members)
    bins = counts.join(members, ["stratum", "rule"]).groupBy("group", "rule", "bin").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("k").alias("k"))
    down = W.Window.partitionBy("group", "rule").orderBy(F.desc("bin")).rowsBetween(W.Window.unboundedPreceding, 0)
    ladder = bins.select(
        "group", "rule", "bin", "k", F.sum("good").over(down).alias("x"), F.sum("bad").over(down).alias("y"))
    best = ladder.filter((F.col("x") <= F.col("k")) & (F.col("bin") > 0)).withColumn(
        "gain", F.col("y") - penalty * F.col("x")).filter("gain > 0").groupBy("group", "rule").agg(
        F.max(F.struct("gain", "bin")).alias("b"))
    cutoffs = best.groupBy("group").agg(F.array(*(
        F.coalesce(F.max(F.when(F.col("rule") == i, F.col("b.bin"))), F.lit(GRID + 1)) for i in range(len(RULES))
    )).alias("cutoffs"))
    named = members.select("stratum", "group").distinct().withColumnRenamed("group", "_group")
    return named.join(cutoffs, F.col("_group").eqNullSafe(F.col("group"))).select("stratum", "cutoffs")


def judge(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add base_failed and kept."""
    rows, back = numbered(scored.drop("base_failed", "kept"))
    rows = rows.withColumn("_stratum", F.coalesce(F.col(back[stratum]).cast("string"), F.lit("")))
    rows = rows.join(
        measured(cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cut"))),
        "_stratum", "left")
    over = F.exists(
        F.zip_with(rule_bins(back["_s"]), "_cut", lambda b, c: b >= c), lambda x: F.coalesce(x, F.lit(False)))
    failed = base_failed(back["_s"])
    return rows.select(
        *(F.col(n).alias(c) for c, n in back.items()), failed.alias("base_failed"),
        (~failed & ~F.coalesce(over, F.lit(False))).alias("kept"))
