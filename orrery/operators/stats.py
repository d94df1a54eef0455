"""Classification metrics, paired statistics, correlations and resampling as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import PART, attach, running, segmented, written

THRESHOLD = 0.5


def _safe(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def confusion(scores: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Counts and rates of predictions p >= threshold; ratios without a base are 0, specificity and false-alarm rate null."""
    hit, truth = F.col("p") >= threshold, F.col("y") == 1
    c = scores.groupBy(*by).agg(
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"), F.count_if(~hit & ~truth).alias("tn"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    recall, specificity = _safe(tp, tp + fn), _safe(tn, tn + fp, None)
    margin = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return c.select(
        *by, "tp", "fp", "fn", "tn", "brier",
        _safe(tp, tp + fp).alias("precision"), recall.alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), specificity.alias("specificity"),
        _safe(fp, tn + fp, None).alias("false_alarm_rate"), ((recall + F.coalesce(specificity, F.lit(0.0))) / 2).alias("balanced_accuracy"),
        F.when(margin > 0, (tp * tn - fp * fn) / F.sqrt(margin)).otherwise(0.0).alias("mcc"),
    )


def by_score(scores: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score, so that ranking works on distinct scores and not on rows."""
    return scores.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))


def _ranked(scores: DataFrame, by: list[str], descending: bool, inclusive: bool, values: dict[str, str]) -> DataFrame:
    """Distinct scores with running sums of the named counts, from the lowest or the highest score, in ranges of any number."""
    order = [F.desc("p") if descending else F.asc("p")]
    cut = segmented(by_score(scores, by), by, order)
    return running(cut, by, order, {n: ("sum", F.col(c)) for n, c in values.items()}, inclusive)


def roc_auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve as the share of ordered pairs, ties one half; null with one class only."""
    rows = _ranked(scores, by, False, False, {"_below": "neg"})
    out = rows.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("_below") + 0.5 * F.col("neg"))).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def _curve(scores: DataFrame, by: list[str]) -> DataFrame:
    rows = _ranked(scores, by, True, True, {"_tp": "pos", "_fp": "neg"})
    return attach(rows, rows.groupBy(*by).agg(F.sum("pos").alias("_np"), F.sum("neg").alias("_nn")), by)


def _rate(count: Column, base: str) -> Column:
    return _safe(count, F.col(base), None)


def curve(scores: DataFrame, by: list[str]) -> DataFrame:
    """One point for each distinct score, from the highest: true and false positive rate, precision."""
    tp, fp = F.col("_tp"), F.col("_fp")
    return _curve(scores, by).select(*by, "p", _rate(tp, "_np").alias("tpr"), _rate(fp, "_nn").alias("fpr"), (tp / (tp + fp)).alias("precision"))


def average_precision(scores: DataFrame, by: list[str]) -> DataFrame:
    """Sum over distinct scores of precision times the step in recall."""
    step = _rate(F.col("pos"), "_np")
    return _curve(scores, by).groupBy(*by).agg(F.sum(step * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("average_precision"))


def trapezoid_auc(scores: DataFrame, by: list[str]) -> DataFrame:
    width, height = _rate(F.col("neg"), "_nn"), _rate(F.col("_tp"), "_np") + _rate(F.col("_tp") - F.col("pos"), "_np")
    return _curve(scores, by).groupBy(*by).agg(F.sum(width * height / 2).alias("auc_trapezoid"))


def pair_margins(scores: DataFrame, by: list[str], pair: str = "pair_id") -> DataFrame:
    """Mean score of y = 1 less that of y = 0 in each pair that has both."""
    made = scores.groupBy(*by, pair).agg(F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("pre"), F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("far"))
    return made.where("pre IS NOT NULL AND far IS NOT NULL").withColumn("margin", F.col("pre") - F.col("far"))


def concordance(scores: DataFrame, by: list[str], pair: str = "pair_id") -> DataFrame:
    """Share of pairs whose y = 1 side scores strictly higher."""
    return pair_margins(scores, by, pair).groupBy(*by).agg(F.avg((F.col("margin") > 0).cast("double")).alias("pairwise_concordance"), F.count(F.lit(1)).alias("n_pairs"))


def unpivoted(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Long form (keys, feature, x); nulls stay."""
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in names], "feature", "x")


def pair_deltas(records: DataFrame, names: list[str], pair: str = "pair_id") -> DataFrame:
    """(feature, pair, delta) of y = 1 against y = 0, means where a side has several rows, incomplete pairs left out."""
    made = unpivoted(records, names, [pair, "y"]).groupBy("feature", pair).agg(F.avg(F.when(F.col("y") == 0, F.col("x"))).alias("far"), F.avg(F.when(F.col("y") == 1, F.col("x"))).alias("pre"))
    return made.where("far IS NOT NULL AND pre IS NOT NULL").withColumn("delta", F.col("pre") - F.col("far"))


def delta_summary(deltas: DataFrame, consistent: float = 0.6) -> DataFrame:
    d = F.col("delta")
    q = F.percentile(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    up, down = F.avg((d > 0).cast("double")), F.avg((d < 0).cast("double"))
    out = deltas.groupBy("feature").agg(F.count(F.lit(1)).alias("n_pairs"), q.alias("_q"), up.alias("share_up"), down.alias("share_down"))
    quarter, median, three = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    return out.select("feature", "n_pairs", median.alias("median_delta"), quarter.alias("q25"), three.alias("q75"), (three - quarter).alias("iqr"), "share_up", "share_down", (F.greatest("share_up", "share_down") >= consistent).alias("direction_consistent"))


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """(by, value, out) of the distinct values: their rank from 1 within the group, ties at their mean.

    Values are counted before they are ordered, so a value that many rows share is one row.
    """
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(segmented(counted, by, [value]), by, [value], {"_below": ("sum", F.col("_n"))}, inclusive=False)
    return ranked.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(out))


def signed_ranks(deltas: DataFrame, by: str = "feature") -> DataFrame:
    """Rank sums of positive and negative differences, zeros left out; the smaller sum and the rank-biserial correlation.

    ``tie_term`` is the sum of t^3 - t over groups of t equal differences.
    """
    rows = deltas.where("delta <> 0").withColumn("_a", F.abs("delta"))
    counted = rows.groupBy(by, "_a").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("delta") > 0).alias("_up"))
    ranked = running(segmented(counted, [by], ["_a"]), [by], ["_a"], {"_below": ("sum", F.col("_n"))}, inclusive=False)
    rank, n = F.col("_below") + (F.col("_n") + 1) / 2.0, F.col("_n")
    sums = [F.sum(n).alias("n_used"), F.sum(F.col("_up") * rank).alias("t_plus"), F.sum((n - F.col("_up")) * rank).alias("t_minus")]
    out = ranked.groupBy(by).agg(*sums, F.sum(n * n * n - n).alias("tie_term"), (F.max(n) > 1).alias("ties"))
    return out.select(by, "n_used", "t_plus", "t_minus", F.least("t_plus", "t_minus").alias("wilcoxon_w"), ((F.col("t_plus") - F.col("t_minus")) / (F.col("t_plus") + F.col("t_minus"))).alias("rank_biserial"), "ties", "tie_term")


def wilcoxon_p(deltas: DataFrame, by: str = "feature", most_exact: int = 50) -> DataFrame:
    """``signed_ranks`` with ``p_value``: two-sided, exact up to ``most_exact`` differences, ties included.

    Doubled mean ranks are whole numbers. One fold of the JVM over a group's at most ``most_exact`` of them counts, for
    every sum, the sign choices that reach it; the probability is that of a sum at most the smaller one seen, doubled.
    Larger groups take the normal approximation with the variance lessened for ties.
    """
    found = signed_ranks(deltas, by)
    rows = deltas.where("delta <> 0").withColumn("_a", F.abs("delta"))
    few = attach(rows, found.where(F.col("n_used") <= most_exact).select(by), [by])
    counted = few.groupBy(by, "_a").agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(by).orderBy("_a")) - F.col("_n")
    doubled = counted.select(by, "_n", (2 * below + F.col("_n") + 1).cast("int").alias("_r"))
    ranks = doubled.groupBy(by).agg(F.flatten(F.collect_list(F.array_repeat("_r", F.col("_n").cast("int")))).alias("_ranks"))
    ways = F.aggregate(
        F.col("_ranks"), F.array(F.lit(1.0)), lambda ways, r: F.zip_with(F.concat(ways, F.array_repeat(F.lit(0.0), r)), F.concat(F.array_repeat(F.lit(0.0), r), ways), lambda a, b: a + b)
    )
    out = attach(found, ranks, [by], "left").withColumn("_ways", ways)
    low = F.aggregate(F.slice("_ways", F.lit(1), F.floor(2 * F.col("wilcoxon_w")).cast("int") + 1), F.lit(0.0), lambda s, w: s + w)
    exact = F.least(F.lit(1.0), 2.0 * low / F.pow(F.lit(2.0), F.col("n_used")))
    n = F.col("n_used").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_term") / 48.0)
    normal = F.least(F.lit(1.0), normal_tail(F.abs(F.col("wilcoxon_w") - n * (n + 1) / 4.0) / spread))
    return out.withColumn("p_value", F.when(F.col("_ways").isNotNull(), exact).otherwise(normal)).drop("_ranks", "_ways")


def normal_tail(z: Column) -> Column:
    """Two-sided probability of a standard normal value beyond z >= 0, to 1e-12: a series near 0, a continued fraction beyond 3."""
    terms = F.sequence(F.lit(1), F.lit(80))
    series = F.aggregate(terms, F.struct(z.alias("term"), z.alias("sum")), lambda a, k: F.struct((a["term"] * z * z / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * z * z / (2 * k + 1)).alias("sum")))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    fraction = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(120))), z, lambda a, k: z + k / a)
    return F.when(z < 3, 1 - 2 * density * series["sum"]).otherwise(2 * density / fraction)


def spearman(records: DataFrame, names: list[str], key: str = "record_id", by: list[str] | None = None) -> DataFrame:
    """(by, a, b, rho, n) for each pair of features: correlation of average ranks over rows that have both, within ``by``; null where one is constant."""
    if not by:
        return _spearman_shared(records.where(F.col(key).isNotNull()), names, key, None).select("a", "b", "rho", "n")
    order = {c: i for i, c in enumerate(names)}
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    long = unpivoted(records, names, [key, *by]).where("x IS NOT NULL")
    left, right = long.select(key, *by, F.col("feature").alias("a"), F.col("x").alias("xa")), long.select(key, *by, F.col("feature").alias("b"), F.col("x").alias("xb"))
    both = left.join(right, [key, *by]).where(rank_of[F.col("a")] < rank_of[F.col("b")])
    both = written(both)
    keys = [*by, "a", "b"]
    for x, r in (("xa", "ra"), ("xb", "rb")):
        both = both.join(average_ranks(both, keys, x, r), [*keys, x])
    return both.groupBy(*by, "a", "b").agg(_rank_correlation().alias("rho"), F.count(F.lit(1)).alias("n"))


def _rank_correlation() -> Column:
    """Correlation of the ranks ra and rb, null where one side is constant: by its extremes, since variances of equal values may be rounding."""
    varied = (F.min("ra") < F.max("ra")) & (F.min("rb") < F.max("rb"))
    return F.when(varied, F.try_divide(F.covar_pop("ra", "rb"), F.sqrt(F.var_pop("ra")) * F.sqrt(F.var_pop("rb"))))


def components(names: list[str], pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Connected groups of a fixed, short list of feature names, members and groups in the list's order."""
    parent = {c: c for c in names}

    def root(c: str) -> str:
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in pairs:
        x, y = sorted((root(a), root(b)), key=names.index)
        parent[y] = x
    groups: dict[str, list[str]] = {}
    for c in names:
        groups.setdefault(root(c), []).append(c)
    return list(groups.values())


class CorrelationPruner:
    """Keeps the feature of highest priority of each group of strongly correlated ones, as seen in the fitting rows.

    Priority is the order of ``priority`` (features not listed come last, in their own order).
    """

    def __init__(self, names: list[str], threshold: float = 0.9, priority: list[str] | None = None):
        rank = {c: i for i, c in enumerate(priority or [])}
        self.names = sorted(names, key=lambda c: (rank.get(c, len(rank)), names.index(c)))
        self.given, self.threshold = list(names), threshold
        self.kept: list[str] = []
        self.groups: list[list[str]] = []

    def fit(self, records: DataFrame) -> CorrelationPruner:
        strong = spearman(records, self.names).where(F.abs(F.round("rho", 4)) >= self.threshold).select("a", "b").collect()
        return self.fit_pairs([(r["a"], r["b"]) for r in strong])

    def fit_pairs(self, pairs: list[tuple[str, str]]) -> CorrelationPruner:
        self.groups = components(self.names, pairs)
        best = {g[0] for g in self.groups}
        self.kept = [c for c in self.given if c in best]
        return self

    def transform(self, records: DataFrame) -> DataFrame:
        return records.drop(*[c for c in self.given if c not in self.kept])

    @property
    def n_selected(self) -> int:
        return len(self.kept)

    @property
    def n_dropped(self) -> int:
        return len(self.given) - len(self.kept)


def spearman_outside_folds(rows: DataFrame, names: list[str], fold: str = "fold", key: str = "record_id") -> DataFrame:
    """(model, a, b, rho): ``spearman`` of the rows outside each fold, of which there are few; every value is ordered once for all folds."""
    return _spearman_shared(rows, names, key, fold).select("model", "a", "b", "rho")


def _spearman_shared(rows: DataFrame, names: list[str], key: str, fold: str | None) -> DataFrame:
    """(model, a, b, rho, n): correlations of the rows outside each fold, or of all rows as model 0, from one order of every value.

    Distinct values have counts by fold, so one running sum for each fold gives the ranks of all models. Features that
    miss the same rows share the orders of their partners.
    """
    rows = written(rows.select(F.col(key).alias("_key"), (F.col(fold) if fold else F.lit(0).cast("long")).alias("_fold"), *[F.col(c).cast("double").alias(c) for c in names]), "correlated")
    all_folds = [r["_fold"] for r in rows.select("_fold").distinct().orderBy("_fold").collect()] if fold else [0]
    unlike = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    facts = rows.agg(*[F.coalesce(F.bool_or(F.col(a).isNull() != F.col(b).isNull()), F.lit(False)).alias(f"{i}") for i, (a, b) in enumerate(unlike)]).head()
    differ = {pair for i, pair in enumerate(unlike) if facts[i]}
    first = {c: next(a for a in names if a == c or ((a, c) not in differ and names.index(a) < names.index(c))) for c in names}
    slots = {s: i for i, s in enumerate(dict.fromkeys(s for a, b in unlike for s in ((a, first[b]), (b, first[a]))))}
    if not all_folds or not slots:
        return rows.select(F.col("_fold").alias("model"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("rho"), F.lit(0).cast("long").alias("n")).where("false")
    cells = F.array(*[F.when(F.col(c).isNotNull() & F.col(partner).isNotNull(), F.struct(F.lit(i).alias("_slot"), F.col(c).alias("_x"))) for (c, partner), i in slots.items()])
    long = written(rows.select("_key", "_fold", F.inline(F.filter(cells, lambda s: s.isNotNull()))), "correlated")
    counts = [F.count_if(F.col("_fold") == f).alias(f"_n{j}") for j, f in enumerate(all_folds)]
    counted = long.groupBy("_slot", "_x").agg(*counts)
    ranked = running(segmented(counted, ["_slot"], ["_x"]), ["_slot"], ["_x"], {f"_b{j}": ("sum", F.col(f"_n{j}")) for j in range(len(all_folds))}, inclusive=False)
    below, same = (sum((F.col(f"{k}{j}") for j in range(1, len(all_folds))), F.col(f"{k}0")) for k in ("_b", "_n"))
    others = [(below - F.col(f"_b{j}"), same - F.col(f"_n{j}")) for j in range(len(all_folds))] if fold else [(below, same)]
    ranks = F.array(*[lower + (equal + 1) / 2.0 for lower, equal in others])
    placed = long.join(ranked.select("_slot", "_x", ranks.alias("_r")), ["_slot", "_x"])
    wide = placed.groupBy("_key", "_fold").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_r"))).alias("_r"))
    tried = [(f, j + 1, a, b, slots[a, first[b]], slots[b, first[a]]) for j, f in enumerate(all_folds) for a, b in unlike]
    # one row for each model and pair of a short list of features
    tried = rows.sparkSession.createDataFrame(tried, "model long, _j int, a string, b string, _sa int, _sb int")
    rank = lambda s: F.try_element_at(F.try_element_at("_r", F.col(s)), F.col("_j"))
    pairs = wide.join(F.broadcast(tried), F.col("_fold") != F.col("model") if fold else F.lit(True)).select("model", "a", "b", rank("_sa").alias("ra"), rank("_sb").alias("rb"))
    return pairs.where("ra IS NOT NULL AND rb IS NOT NULL").groupBy("model", "a", "b").agg(_rank_correlation().alias("rho"), F.count(F.lit(1)).alias("n"))


def kept_in_folds(rows: DataFrame, names: list[str], threshold: float = 0.9, priority: list[str] | None = None, fold: str = "fold", key: str = "record_id") -> dict[int, list[str]]:
    """Features that ``CorrelationPruner`` keeps of the training rows of each fold; one job correlates all folds."""
    held = [r["_model"] for r in rows.select(F.col(fold).alias("_model")).distinct().collect()]
    strong = spearman_outside_folds(rows, names, fold, key).where(F.abs(F.round("rho", 4)) >= threshold)
    pairs: dict[int, list[tuple[str, str]]] = {m: [] for m in held}
    for r in strong.select("model", "a", "b").collect():
        pairs[r["model"]].append((r["a"], r["b"]))
    return {m: CorrelationPruner(names, threshold, priority).fit_pairs(p).kept for m, p in sorted(pairs.items())}


def pruning_stability(kept: DataFrame, folds: int) -> DataFrame:
    """Percentage of folds in which each feature of (fold, feature) was kept."""
    return kept.groupBy("feature").agg(F.round(100.0 * F.count_distinct("fold") / folds, 2).alias("pct_folds"))


def numbered_from_0(rows: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """The rows numbered in order, range by range."""
    ranked = running(segmented(rows, [], order), [], order, {out: ("sum", F.lit(1).cast("long"))})
    return ranked.withColumn(out, F.col(out) - 1).drop(PART)


def block_differences(summary: DataFrame, pairs: list[tuple[str, str]], keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of block b less those of block a for each named pair of blocks with equal keys, at four decimals."""
    named = summary.sparkSession.createDataFrame(pairs, "a string, b string")
    a = summary.select(*keys, F.col("block").alias("a"), *[F.col(m).alias(f"_a{m}") for m in metrics])
    b = summary.select(*keys, F.col("block").alias("b"), *[F.col(m).alias(f"_b{m}") for m in metrics])
    both = a.join(F.broadcast(named), "a").join(b, [*keys, "b"])
    return both.select(*keys, "a", "b", *[F.round(F.col(f"_b{m}") - F.col(f"_a{m}"), 4).alias(f"delta_{m}") for m in metrics])
