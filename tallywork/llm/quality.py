"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Each rule is a measure of a document, a side and a ladder of cutoffs fixed beforehand, the mildest first. As the ladders do not
depend on the data, all labelled documents are holdouts. Per stratum and rule the ladder is climbed: a cutoff is certified if
the exact binomial probability of seeing as few good documents rejected as were seen, were the true share `alpha` or more, is
at most `delta` divided by the number of rules and strata; the climb ends at the first cutoff that fails, so climbing costs
no further correction. With probability 1 - `delta` no certified cutoff anywhere rejects more than `alpha` of its stratum's
good documents, and all rules together no more than `alpha` times the number of rules. Of the certified cutoffs the one with
the best balance of poor and good documents rejected is used. A stratum with too few labels has none and keeps its documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import WHITE, forget, staged

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# False rejections allowed per rule and stratum, the chance that any certificate is wrong, and how many poor documents have
# to go for a good one that goes.
ALPHA = 0.01
DELTA = 0.05
COST = 10
# Terms of the binomial tail that are summed one by one; what follows is bounded from above by a geometric series.
TERMS = 20_000


@dataclass(frozen=True)
class Rule:
    """A document fails if `part` / `whole`, two of the features, is above (`above`) or below the cutoff; not if `whole` is 0."""

    name: str
    part: str
    whole: str
    above: bool
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", True, (2.0, 1.0, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    Rule("long_words", "word_chars", "n_words", True, (12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.75, 6.5, 6.25, 6.0)),
    Rule("short_words", "word_chars", "n_words", False, (1.5, 2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeated_words", "n_repeat_words", "n_words", True, (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06)),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, stratum: str = "lang", carried: tuple[Column, ...] = ()) -> DataFrame:
    """`doc_id`, `stratum`, the `carried` columns and the counts of whole texts; a null text has no words and no lines.

    `_at` numbers the rows. A filter that asks for it stays above the counts; it would otherwise be pushed below them and count
    again for every rule.

    `n_repeat_words` counts words that lie in a window of five words found twice or more in the text. Windows are compared by
    64-bit hashes; the exact work is done only for texts in which some window repeats.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    given = docs.select("doc_id", docs[stratum].alias("stratum"), *carried).columns
    rows = docs.select(
        "doc_id",
        docs[stratum].alias("stratum"),
        *carried,
        F.length(F.regexp_replace(text, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.array_remove(F.split(text, WHITE), "").alias("_words"),
        lines.alias("_lines"),
    )
    at = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(WINDOW)]))
    rows = rows.select(
        *given,
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.when(repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_placed", placed).drop("_hashes")

    def again(entry: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_placed", i - 1)["h"] == entry["h"]).otherwise(False)
        return before | F.coalesce(F.get("_placed", i + 1)["h"] == entry["h"], F.lit(False))

    found = F.array_sort(F.transform(F.filter("_placed", again), lambda entry: entry["i"]))
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda seen, i: F.struct((seen["total"] + F.least(F.lit(WINDOW), i - seen["last"])).alias("total"), i.alias("last")),
        lambda seen: seen["total"],
    )
    rows = rows.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"), "_at": F.monotonically_increasing_id()})
    return rows.drop("_placed")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _fails(rule: Rule, cutoff: Column | float) -> Column:
    measure = F.try_divide(F.col(rule.part), F.col(rule.whole))
    return measure > cutoff if rule.above else measure < cutoff


def _log_gamma(x: Column) -> Column:
    """Of numbers from 1, by Stirling's series behind a shift by eight."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return series - reduce(lambda a, b: a + b, [F.log(x + F.lit(float(k))) for k in range(8)])


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """The probability of at most `k` of `n` at the given share, never too low; 1 from the mean upwards."""
    kd, nd = k.cast("double"), n.cast("double")
    odds = (1 - share) / share
    top = F.exp(
        _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(share)) + (nd - kd) * F.log1p(F.lit(-share))
    )
    down = F.sequence(F.lit(1).cast("bigint"), F.least(k, F.lit(TERMS).cast("bigint")))
    summed = F.aggregate(
        F.when(k > 0, down).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, j: F.struct(
            (s["term"] * (kd - j + 1) * odds / (nd - kd + j)).alias("term"),
            (s["total"] + s["term"] * (kd - j + 1) * odds / (nd - kd + j)).alias("total"),
        ),
    )
    left = kd - TERMS
    ratio = left * odds / (nd - left + 1)
    rest = F.when(left > 0, summed["term"] * ratio / (1 - ratio)).otherwise(F.lit(0.0))
    return F.when(n == 0, F.lit(1.0)).when(kd >= nd * share, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * (summed["total"] + rest)))


def ladders(feats: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The certificate of every stratum, rule and cutoff: `stratum`, `rule`, `step`, `cutoff`, `n_good`, `good_out`, `poor_out`,
    `p_value`, `certified`.

    Labelled documents that fail the base rules are out anyway and are not counted. Labels without a document or a quality say
    nothing, nor do the labels of a document that disagree. Null strata are one stratum. The bound needs one trial per document, so
    repeated labels count once, and of the rows of one doc_id the one of the lowest counts and stratum.
    """
    counted_once = F.col("_at") >= 0 if "_at" in feats.columns else F.lit(True)
    agreed = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    agreed = agreed.filter("quality = _other").drop("_other")
    measures = [*MEASURES, "stratum"]
    judged = feats.filter(~base_failed() & counted_once).select("doc_id", *measures).join(agreed, "doc_id")
    judged = judged.groupBy("doc_id", "quality").agg(F.min(F.struct(*measures)).alias("row")).select("quality", "row.*")
    good, poor = F.col("quality") == 1, F.col("quality") == 0
    counted = [F.count_if(good).alias("n_good")]
    for rule in rules:
        for step, cutoff in enumerate(rule.cutoffs):
            fails = F.coalesce(_fails(rule, cutoff), F.lit(False))
            counted += [F.count_if(good & fails).alias(f"{rule.name}_{step}_good"), F.count_if(poor & fails).alias(f"{rule.name}_{step}_poor")]
    sums = judged.groupBy("stratum").agg(*counted)
    rungs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.lit(step).alias("step"),
                    F.lit(cutoff).alias("cutoff"),
                    F.col(f"{rule.name}_{step}_good").alias("good_out"),
                    F.col(f"{rule.name}_{step}_poor").alias("poor_out"),
                )
                for rule in rules
                for step, cutoff in enumerate(rule.cutoffs)
            ]
        )
    )
    rows = sums.withColumn("n_strata", F.count("*").over(Window.partitionBy())).select("stratum", "n_good", "n_strata", rungs.alias("rung"))
    rows = rows.select("stratum", "n_good", "n_strata", "rung.*")
    rows = rows.withColumn("p_value", binomial_tail(F.col("good_out"), F.col("n_good"), alpha))
    passes = F.col("p_value") <= delta / (len(rules) * F.col("n_strata"))
    climb = Window.partitionBy("stratum", "rule").orderBy("step")
    return rows.withColumn("certified", F.min(passes.cast("int")).over(climb) == 1).drop("n_strata")


def select_cutoffs(ladder: DataFrame, cost: int = COST) -> DataFrame:
    """One row per stratum with a map `cutoffs` from rule to cutoff: of the certified ones, the best balance, the mildest of equals."""
    worth = F.col("poor_out") - cost * F.col("good_out")
    certified = ladder.filter("certified").withColumn("worth", worth).filter("worth > 0")
    best = certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("worth"), -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All features, `base_failed`, `kept` and `failed_rules` of every row of `docs` (doc_id, text and the stratum's column).

    A text that is null or empty fails the base. Without labels nothing is certified and the base decides alone. Features are
    written once, as both the certificates and the verdicts read them. Strata are as many as the column has values; their
    cutoffs are joined by an ordinary join.
    """
    feats = staged(features(docs, stratum).drop("_at"), "quality-features")
    return _verdicts(feats, select_cutoffs(ladders(feats, labels, rules)), rules)


def _verdicts(feats: DataFrame, chosen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    chosen = chosen.withColumnRenamed("stratum", "_stratum")
    rows = feats.join(chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    failed = F.array(*[F.when(_fails(rule, F.col("cutoffs")[rule.name]), F.lit(rule.name)) for rule in rules])
    rows = rows.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(failed)).drop("cutoffs")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept_only(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs`, whatever their columns, that the rules keep.

    The counts are taken twice, once to be joined with the labels and once with the rows in hand, so that no text is shuffled.
    """
    feats = staged(features(docs, stratum).drop("_at"), "quality-features")
    chosen = staged(select_cutoffs(ladders(feats, labels, rules)), "quality-cutoffs")
    forget(feats)
    rows = features(docs, stratum, (F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"),))
    rows = _verdicts(rows, chosen, rules).filter("kept AND _at >= 0")
    return rows.select(*[F.col(f"_row.c{i}").alias(name) for i, name in enumerate(docs.columns)])
