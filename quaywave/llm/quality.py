"""Quality rules whose cutoffs are set by labelled holdouts with exact binomial bounds. DataFrame functions only."""

from __future__ import annotations

from math import log, log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import let
from .common import WORD, materialize, spread_join, text_of

#: Signs that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: The rules: what they measure, as whole numbers from 0 to 1000 of which larger ones are worse.
RULES = {
    "symbols": "least(1000, 1000 * n_symbols div greatest(word_chars, 1))",
    "repeated_words": "1000 * n_repeat_words div greatest(n_words, 1)",
    "repeated_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "capitals": "1000 * n_upper div greatest(word_chars, 1)",
    "long_words": "least(1000, 10 * word_chars div greatest(n_words, 1))",
    "short_words": "1000 - least(1000, 10 * word_chars div greatest(n_words, 1))",
}
#: Strata with over 1 / STRATA of the labelled texts have cutoffs of their own: they are fewer than STRATA.
STRATA = 1024


def _repeated(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more. Windows are told by 64-bit hashes of their words.

    Windows are sorted by hash, which brings equal ones together; the positions of those, sorted, add the
    words that the one before didn't cover. Time is n log n in the length of a text, however much it repeats."""

    def among(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        beside = lambda t: F.filter(t, lambda x, i: (x["h"] == F.get(t, i - 1)["h"]) | (x["h"] == F.get(t, i + 1)["h"]))
        at = F.sort_array(F.transform(let(placed, beside), lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"))
        covered = F.aggregate(at, zero, step, lambda acc: acc["sum"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(windows(words), among))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum, text (a hash of it), the counts of a text, and base_failed. Nothing is exchanged.

    n_words and word_chars (code points in words); n_symbols; n_lines with a word, n_dup_lines that equal an
    earlier one; n_repeat_words; n_upper (capital letters). A null text counts as empty."""
    text, size = F.col("text"), lambda c: F.size(c).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    without = lambda what: F.length(F.regexp_replace(text, what + "++", ""))

    counted = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(size(w).alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(size(x).alias("n_lines"), (size(x) - size(F.array_distinct(x))).alias("n_dup_lines")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), text_of(text_col).alias("text"))
    rows = rows.select(
        "id", "stratum", F.xxhash64(text).alias("text"), counted.alias("w"), lined.alias("l"), without(r"[\x20\x09-\x0D]").cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"), (F.length(text) - without(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    rows = rows.select("id", "stratum", "text", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "n_upper")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def most_failures(n: Column, risk: float, doubt: Column) -> Column:
    """The largest k with P(Bin(n, risk) <= k) <= doubt, -1 if none: with so many failures in n or fewer, the exact
    (Clopper-Pearson) upper bound of the true rate at confidence 1 - doubt stays within risk. Sums are kept as logarithms."""
    first = n * F.lit(log1p(-risk))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(log(risk) - log1p(-risk))
        whole = F.greatest(acc["whole"], term) + F.log1p(F.exp(-F.abs(acc["whole"] - term)))
        return F.struct(term.alias("term"), whole.alias("whole"), F.when(whole <= F.log(doubt), i).otherwise(acc["k"]).alias("k"))

    zero = F.struct(first.alias("term"), first.alias("whole"), F.when(first <= F.log(doubt), 0).otherwise(-1).cast("long").alias("k"))
    upto = F.greatest(F.ceil(n * F.lit(risk)), F.lit(1)).cast("long")  # k lies below the mean
    return F.aggregate(F.sequence(F.lit(1).cast("long"), upto), zero, step, lambda acc: acc["k"])


def _measures() -> Column:
    return F.array(*(F.expr(rule).cast("int") for rule in RULES.values()))


def fit_cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, doubt: float = 0.05, price: float = 50.0) -> DataFrame:
    """stratum (null and named: pooled false; the rest: pooled true), rule, cutoff, good, allowed, lost, bad, caught, own_lost, own_caught.

    Good texts among the labelled ones that pass the base are the holdout of a stratum. All whole numbers are
    candidate cutoffs of a rule, tested from the mildest on until one loses more than the exact bound allows:
    such a fixed sequence needs no correction of its own, and what it passes holds at once. The rules of a stratum share
    `risk`, all rules of all strata share `doubt` (Bonferroni): with probability 1 - doubt no stratum loses
    more than `risk` of its good texts. Of the cutoffs that pass, the one with the largest share of bad texts caught less
    `price` times the share of good ones lost is taken, the mildest of equals. A rule that gains nothing has none,
    nor has one that gains nothing by the texts which no better rule of the stratum catches (own_lost, own_caught).

    Equal texts count once, since copies are no independent witnesses; one that has both labels is good. Labels
    may repeat, lack an id or a value. Strata of under 1 / STRATA of the labelled texts are judged together, as
    are documents of strata without labels; too few labels prove nothing, so that nothing is rejected."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) == 1).alias("good"))
    held = spread_join(stats.where(~F.col("base_failed")).withColumn("id", F.col("id").cast("long")), told, ["id"], ["text"])
    held = held.groupBy("stratum", "text").agg(F.max("good").alias("good"), F.first(_measures()).alias("measures"))
    held = materialize(held, "quality-held")
    total = held.count()
    named = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(total // STRATA)).select(F.col("stratum").alias("_named"))
    own = held.join(F.broadcast(named), F.col("stratum").eqNullSafe(F.col("_named")), "left_semi").withColumn("pooled", F.lit(False))  # fewer than STRATA rows
    rest = held.join(F.broadcast(named), F.col("stratum").eqNullSafe(F.col("_named")), "left_anti").withColumn("pooled", F.lit(True)).withColumn("stratum", F.lit(None).cast("string"))
    texts = own.unionByName(rest)
    each = texts.select("pooled", "stratum", "good", F.posexplode("measures").alias("rule", "cutoff"))
    good = F.col("good").cast("long")
    counts = each.groupBy("pooled", "stratum", "rule", "cutoff").agg(F.sum(good).alias("g"), F.sum(1 - good).alias("b"))  # at most 1001 a rule
    group = Window.partitionBy("pooled", "stratum", "rule")
    beyond = group.orderBy(F.desc("cutoff"))
    tried = counts.select("*", F.sum("g").over(beyond).alias("lost"), F.sum("b").over(beyond).alias("caught"), F.sum("g").over(group).alias("good"), F.sum("b").over(group).alias("bad"))
    sizes = tried.groupBy("pooled", "stratum").agg(F.max("good").alias("good"))
    tests = sizes.agg((F.count(F.lit(1)) * F.lit(len(RULES))).alias("tests"))
    limits = sizes.crossJoin(tests)  # one row
    limits = limits.select(F.col("pooled").alias("_p"), F.col("stratum").alias("_s"), most_failures(F.col("good"), risk / len(RULES), F.lit(doubt) / F.col("tests")).alias("allowed"))
    tried = tried.join(F.broadcast(limits), (F.col("pooled") == F.col("_p")) & F.col("stratum").eqNullSafe(F.col("_s"))).drop("_p", "_s")  # STRATA rows at most
    worth = F.col("caught") / F.greatest("bad", F.lit(1)) - F.lit(price) * F.col("lost") / F.greatest("good", F.lit(1))
    tried = tried.where("lost <= allowed").withColumn("worth", worth).where("worth > 0")
    best = F.max_by(F.struct(F.round("worth", 12).alias("worth"), "cutoff", "good", "allowed", "lost", "bad", "caught"), F.struct(F.round("worth", 12), "cutoff"))
    chosen = tried.groupBy("pooled", "stratum", "rule").agg(best.alias("x")).select("pooled", "stratum", "rule", "x.*")
    chosen = materialize(chosen, "quality-chosen")  # a row a rule and stratum

    # A rule that only repeats what better ones catch would cost good texts for nothing: each text counts for the best that it meets.
    order = F.array_sort(F.collect_list(F.struct((-F.col("worth")).alias("minus"), "rule", "cutoff"))).alias("order")
    named_order = chosen.groupBy("pooled", "stratum").agg(order).select(F.col("pooled").alias("_p"), F.col("stratum").alias("_s"), "order")
    met = texts.join(F.broadcast(named_order), (F.col("pooled") == F.col("_p")) & F.col("stratum").eqNullSafe(F.col("_s")))
    met = met.withColumn("first", F.get(F.filter("order", lambda x: F.get("measures", x["rule"]) >= x["cutoff"]), F.lit(0))["rule"])
    first = met.where("first IS NOT NULL").groupBy("_p", "_s", "first").agg(F.sum(good).alias("own_lost"), F.sum(1 - good).alias("own_caught"))
    adds = F.col("own_caught") / F.greatest("bad", F.lit(1)) - F.lit(price) * F.col("own_lost") / F.greatest("good", F.lit(1))
    out = chosen.join(F.broadcast(first), (F.col("pooled") == F.col("_p")) & F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("rule") == F.col("first"))).where(adds > 0)
    names = F.array(*(F.lit(r) for r in RULES))
    return out.select("pooled", "stratum", names[F.col("rule")].alias("rule"), "cutoff", "good", "allowed", "lost", "bad", "caught", "own_lost", "own_caught")


def apply_cutoffs(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """stats with kept and reason (`base`, or the first rule whose cutoff the text reaches; null if kept).

    A stratum that has no cutoffs of its own has the pooled ones. cutoffs has fewer than (STRATA + 1) x rules rows."""
    at = lambda r: F.max(F.when(F.col("rule") == r, F.col("cutoff")))
    wide = cutoffs.groupBy("pooled", "stratum").agg(F.array(*(at(r) for r in RULES)).alias("cutoffs"))
    own = wide.where("NOT pooled").select(F.col("stratum").alias("_s"), F.col("cutoffs").alias("_own"))
    rest = wide.where("pooled").agg(F.first("cutoffs").alias("_rest"))  # one row
    rows = stats.join(F.broadcast(own), F.col("stratum").eqNullSafe(F.col("_s")), "left").crossJoin(F.broadcast(rest))
    hits = F.filter(F.arrays_zip(_measures().alias("m"), F.coalesce("_own", "_rest").alias("c"), F.array(*(F.lit(r) for r in RULES)).alias("rule")), lambda x: x["m"] >= x["c"])
    reason = F.when(F.col("base_failed"), "base").otherwise(F.get(hits, F.lit(0))["rule"])
    return rows.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("_s", "_own", "_rest")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **settings) -> DataFrame:
    """One row per document: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason.

    Texts of under 50 words, or with over half of their words in repeated 3-word windows, fail the base; the
    others are judged by the rules with the cutoffs of fit_cutoffs (settings are its own). Null texts are empty. A
    null stratum is a stratum; ids may be null or repeat; other columns are ignored; an empty table gives an empty
    result, and without labels only the base rejects. Texts are read once, whole."""
    stats = materialize(text_stats(docs, id_col, text_col, stratum_col), "quality-stats")
    cutoffs = materialize(fit_cutoffs(stats, labels, id_col=id_col, **settings), "quality-cutoffs")
    out = apply_cutoffs(stats, cutoffs)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")
