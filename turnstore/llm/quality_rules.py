"""Quality rules with risk-controlled thresholds (operator 2); DataFrame operations only.

Each rule rejects a text if one measure exceeds a cutoff. Cutoffs come from a fixed grid and are chosen on labelled
holdout rows, for each stratum (a band of text length) by itself. The cutoffs of a rule are tested from the most lenient
on: one passes if the exact binomial test rejects that it falsely rejects more than ALPHA of the good texts of the
stratum, at the level DELTA divided by the number of chains (strata times rules, Bonferroni), and the first failure ends
the chain. A stricter cutoff rejects whatever a more lenient one does, so testing each at the chain's level is that very
sequence, and a chain costs its level once however many cutoffs it has. Of those that pass, the one is taken whose
rejected bad texts, less PRICE for each good one, are most, the most lenient of equals; where no cutoff gains anything,
the rule doesn't apply. So with probability 1 - DELTA no rule falsely rejects more than ALPHA of the good texts of any
stratum.

Defined cases: a null text has no words; a text without words fails the base rules; an unlabelled table gives no
cutoffs and the base rules, if they are asked for, decide alone; of contradictory labels of one document the worse
counts; labels of unknown documents are ignored; repeated rows are judged alike; an empty table gives an empty result;
the input's columns all stay as they are, as working columns take names that no column has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstore.llm.common import SENT_IDS, SPACE_CLASS, every, text_or_empty, unused

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Greatest share of a stratum's good texts that one rule may reject, and the chance that any rule of any stratum does.
ALPHA, DELTA = 0.05, 0.05
#: Bad texts that must be rejected to make up for a good one.
PRICE = 5
#: Least numbers of words of the strata.
STRATA = (0, 100, 300)
#: Rules: a whole number for each text, and the cutoffs that it may be held to.
RULES = {
    "symbols": [20, 50, 100, 200, 300, 500, 800],  # symbols for each 1000 words
    "dup_lines": [20, 50, 100, 200, 300, 500, 800],  # repeated lines for each 1000 words
    "repeats": [20, 50, 100, 150, 200, 250, 300, 400, 600],  # words in repeated windows for each 1000 words
    "upper": [100, 200, 300, 400, 500, 600],  # capitals A-Z for each 1000 characters of words
    "stale": [500, 600, 700, 800, 900],  # words that the text has had before, for each 1000 words
    "word_chars": [7000, 8000, 9000, 10000, 12000, 15000],  # characters for each 1000 words
}
#: Chains of tests: the level of each is DELTA divided by their number.
CHAINS = len(STRATA) * len(RULES)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stale_words"]


def with_measures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows with the measures of every whole text (a struct of MEASURES, long, and base_failed), and that column's name."""
    own = every(docs)
    text = text_or_empty(F.col(text_col))
    h, w, s, lines, out = unused(docs, "h", "w", "s", "lines", "measures")
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    df = docs.withColumn(h, F.transform(words, lambda x: F.xxhash64(x)))
    n = F.size(h)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    df = df.withColumn(w, F.when(n >= WINDOW, windows))
    # only texts that repeat a window are sorted
    repeats = F.size(F.array_distinct(w)) < F.size(w)
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn(s, F.when(repeats, placed))
    again = F.filter(s, lambda e, k: (e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + F.lit(WINDOW) - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    df = df.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")))
    found = {
        "n_words": n,
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE_CLASS}]")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "n_stale_words": n - F.size(F.array_distinct(h)),
    }
    df = df.select(*own, F.struct(*(v.cast("long").alias(k) for k, v in found.items())).alias(out))
    m = F.col(out)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return df.withColumn(out, m.withField("base_failed", failed)), out


def stratum(m: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA[1:], 1):
        out = F.when(m["n_words"] >= least, k).otherwise(out)
    return out


def rule_values(m: Column) -> dict[str, Column]:
    """Each rule's value of a text, from its measures."""
    words = F.greatest(m["n_words"], F.lit(1))
    of = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "stale": "n_stale_words", "word_chars": "word_chars"}
    out = {rule: F.call_function("div", 1000 * m[c], words) for rule, c in of.items()}
    return out | {"upper": F.call_function("div", 1000 * m["n_upper"], F.greatest(m["word_chars"], F.lit(1)))}


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, taken back by the recurrence."""
    z = x + 8
    product = F.lit(0.0)
    for k in range(8):
        product = product + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - product


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X for k < p * n, else 1.

    The terms are summed from that of k downwards, each a little smaller than the last. Those that lie more than
    40 + 7 * sqrt(n) below k are left out: together they are less than e^-90 of the sum, which no double shows.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    ratio = lambda i: i * (1 - p) / ((nd - i + 1) * p)  # noqa: E731  of the term of i - 1 to that of i
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(kd, 40 + 7 * F.sqrt(nd)).cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * ratio(kd - j)).alias("term")),
        lambda acc: acc["sum"],
    )
    return F.when(kd < p * nd, top * summed).otherwise(F.lit(1.0))


def known(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and good of all labelled documents."""
    return labels.where("quality is not null").groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("good"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col of the documents that cutoffs are chosen on: all that are needed of a corpus.

    If the labels are too many to be sent to all tasks, the other documents stay too: cutoffs() leaves them out by the
    ids, and deals only measures for that, no texts.
    """
    rows, ids = docs.select(F.col(id_col), F.col(text_col)), known(labels, id_col).select("id")
    return rows.join(F.broadcast(ids), F.col(id_col) == F.col("id"), "left_semi") if ids.count() <= SENT_IDS else rows


def cutoffs(measured: DataFrame, name: str, labels: DataFrame, base: bool = True, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """One row for each stratum that has any: `stratum`, and a cutoff column for each rule (null: none).

    measured, name: rows with a column of measures, and its name; labels: rows of id_col and quality. With base, texts
    that fail the base rules don't count.
    """
    m = F.col("m")
    rows = measured.select(F.col(id_col).alias("id"), F.col(name).alias("m")).join(known(labels, id_col), "id")
    # no filter on the measures: it would be pushed down, and they would be computed twice
    good = F.when(~m["base_failed"], F.col("good")) if base else F.col("good")
    rows = rows.select(good.alias("good"), stratum(m).alias("stratum"), *(v.alias(r) for r, v in rule_values(m).items()))
    counts = [F.sum("good").alias("n")]
    for rule, grid in RULES.items():
        for c in grid:
            counts += [F.sum(F.when(F.col(rule) > c, F.col("good")).otherwise(0)).alias(f"g_{rule}_{c}"), F.sum(F.when(F.col(rule) > c, 1 - F.col("good")).otherwise(0)).alias(f"b_{rule}_{c}")]
    counted = rows.groupBy("stratum").agg(*counts)
    tried = counted.select(
        "stratum",
        "n",
        F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"g_{r}_{c}").alias("k"), F.col(f"b_{r}_{c}").alias("bad")) for r, g in RULES.items() for c in g))),
    )
    gain = F.col("bad") - PRICE * F.col("k")
    safe = tried.where((gain > 0) & (F.col("n") > 0)).where(binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / CHAINS)
    best = safe.groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", [*RULES]).agg(F.first("cutoff"))


def judge(measured: DataFrame, name: str, chosen: DataFrame, base: bool = True) -> tuple[DataFrame, str]:
    """The rows with the verdict (true: keep), and that column's name; `chosen` has a row for each stratum at most."""
    m, own = F.col(name), every(measured)
    of, mine, out, *cuts = unused(measured, "of", "stratum", "kept", *(f"cut_{r}" for r in RULES))
    limits = chosen.select(F.col("stratum").alias(of), *(F.col(r).alias(c) for r, c in zip(RULES, cuts)))
    df = measured.withColumn(mine, stratum(m)).join(F.broadcast(limits), F.col(mine) == F.col(of), "left")
    over = F.lit(False)
    for value, cut in zip((rule_values(m)[r] for r in RULES), cuts):
        over = over | F.coalesce(value > F.col(cut), F.lit(False))
    failed = m["base_failed"].cast("int") if base else F.lit(0)
    kept = failed + over.cast("int") == 0  # one expression: half of it isn't pushed down alone
    return df.select(*own, kept.alias(out)), out


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the cutoffs keep, all columns as they are; nothing is rejected without labelled evidence."""
    evidence, name = with_measures(labelled(docs, labels, id_col, text_col), text_col)
    chosen = cutoffs(evidence, name, labels, base=False, id_col=id_col)
    measured, name = with_measures(docs, text_col)
    judged, kept = judge(measured, name, chosen, base=False)
    return judged.where(F.col(kept)).select(*every(docs))
