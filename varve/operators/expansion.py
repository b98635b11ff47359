"""Cell tables over several binnings in one pass: ranks by distributed sorts, GROUPING SETS for the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import edges, running


def sized(df: DataFrame, group: str, tie: list[str], size: str, source: DataFrame | None = None) -> DataFrame:
    """df with size_rank, a label by descending size in the group (ties by tie): its first, second, third to fifth row, and the rest. source: as in ``edges``."""
    x = F.coalesce(F.when(F.isnan(size), F.lit(float("-inf"))).otherwise(-F.col(size)), F.lit(float("inf")))  # ascends as size descends, nulls last
    df = edges(df.withColumn("_x", x), [group], "_x", tie, lambda n: [F.least(F.lit(k), n) for k in (1, 2, 5)], "_at", None if source is None else source.withColumn("_x", x)).drop("_x")
    label = F.when(F.col("_at") == 3, "1_leader").when(F.col("_at") == 2, "2_second").when(F.col("_at") == 1, "3_third_fifth").otherwise("4_rest")
    return df.withColumn("size_rank", label).drop("_at")


def binned(df: DataFrame, group: str, tie: list[str], columns: dict[str, str], size: str, bins: int = 5, places: list[str] | None = None) -> DataFrame:
    """df with, for each column (tag -> name), its equal-count bin over all rows (q_<tag>_pooled) and in its group (q_<tag>_within) and its
    share of ranks there (pct_<tag>_within), by first-come ranks in the order of tie; and size_rank, a label by descending size in the group.
    A bin is ceil(bins * rank / n). places: the tags whose shares of ranks are wanted (all by default).

    Bins and labels come from the rows at their edges; rows are sorted whole once for each share of ranks. df is read several times, so it should be cheap to read."""
    order, base = [F.col(c) for c in tie], df
    cut = lambda n: [F.floor(n * j / bins) for j in range(1, bins)]
    places = list(columns) if places is None else places
    for tag in places:
        df = running(df, [group], [F.col(columns[tag]), *order])
        df = df.withColumns({f"q_{tag}_within": F.ceil(bins * F.col("rank") / F.col("rank_total")).cast("int"), f"pct_{tag}_within": F.col("rank") / F.col("rank_total")}).drop("rank", "rank_total")
    for tag, c in columns.items():
        for scheme, keys in (("pooled", []), ("within", [group])):
            if scheme == "pooled" or tag not in places:
                df = edges(df, keys, c, tie, cut, "_at", base).withColumn(f"q_{tag}_{scheme}", bins - F.col("_at")).drop("_at")
    return sized(df, group, tie, size, base)


def plans(df: DataFrame, planners: dict[str, tuple[str, str, str]]) -> DataFrame:
    """A row for each planner (name -> its columns of cost, sales and share): planner, tc_pl, sales_pl, share_pl beside the market's columns."""
    made = F.explode(F.array(*(F.struct(F.lit(n).alias("planner"), F.col(a).alias("tc_pl"), F.col(b).alias("sales_pl"), F.col(c).alias("share_pl")) for n, (a, b, c) in planners.items())))
    drop = {c for cs in planners.values() for c in cs}
    return df.select(*(c for c in df.columns if c not in drop), made.alias("_p")).select(*(c for c in df.columns if c not in drop), "_p.*")


def cell_tables(df: DataFrame, tables: dict[tuple[str, str], list[str]]) -> DataFrame:
    """One row for each table (name, scheme) -> [one or two bin columns], planner and cell, from df as ``plans`` gives it: all tables and each planner's totals in
    one aggregation.

    Columns: table, scheme, planner, var1, bin1, var2, bin2, counts, means, sums, shares of the planner's totals, ratios, gain_share (of the total change of
    cost; null if there is none), and cost-weighted means of log markup and of the log change of cost."""
    bins = list(dict.fromkeys(c for cs in tables.values() for c in cs))
    log_ratio = F.ln(F.col("tc_pl") / F.col("tc_mkt"))
    df = df.select("planner", *bins, "alpha", "mu_mkt", "share_mkt", "share_pl", "tc_mkt", "tc_pl", "sales_mkt", "sales_pl", "pct_a_within", "pct_v_within", F.ln("v").alias("log_v"), F.ln("mu_mkt").alias("log_mu"), log_ratio.alias("log_ratio"))
    w = lambda c: F.sum(F.col("tc_mkt") * F.col(c))
    aggregates = [
        F.count("*").alias("n_firms"), *(F.avg(c).alias(n) for c, n in (("alpha", "mean_alpha"), ("log_v", "mean_log_v"), ("pct_a_within", "mean_pct_alpha_within"), ("pct_v_within", "mean_pct_v_within"), ("share_mkt", "mean_share_mkt"), ("share_pl", "mean_share_pl"))),
        *(F.sum(c).alias(c) for c in ("tc_mkt", "tc_pl", "sales_mkt", "sales_pl")), w("mu_mkt").alias("_mu"), w("log_mu").alias("_lmu"), w("log_ratio").alias("_lr"), F.grouping_id().alias("_set"),
    ]
    sets = [["planner", *cs] for cs in tables.values()] + [["planner"]]
    got = df.groupingSets([[F.col(c) for c in s] for s in sets], "planner", *bins).agg(*aggregates)
    # grouping_id has a bit for each column, the first column's the highest, set where the column is rolled up.
    number = lambda cs: sum(1 << (len(bins) - 1 - i) for i, b in enumerate(bins) if b not in cs)
    cells = None
    for (table, scheme), cs in tables.items():
        name: Column = F.struct(F.lit(table).alias("table"), F.lit(scheme).alias("scheme"), F.lit(cs[0]).alias("var1"), F.col(cs[0]).cast("string").alias("bin1"), F.lit(cs[1] if len(cs) > 1 else "").alias("var2"), (F.col(cs[1]).cast("string") if len(cs) > 1 else F.lit("")).alias("bin2"))
        cells = F.when(F.col("_set") == number(cs), name) if cells is None else cells.when(F.col("_set") == number(cs), name)
    sums = ["n_firms", "tc_mkt", "tc_pl"]
    totals = F.broadcast(got.where(F.col("_set") == number([])).select("planner", *(F.col(c).alias(f"_t_{c}") for c in sums)))  # a row a planner
    out = got.where(F.col("_set") != number([])).withColumn("_cell", cells).join(totals, "planner")
    change = F.col("_t_tc_pl") - F.col("_t_tc_mkt")
    return out.select(
        "_cell.table", "_cell.scheme", "planner", "_cell.var1", "_cell.bin1", "_cell.var2", "_cell.bin2", "n_firms", "mean_alpha", "mean_log_v", "mean_pct_alpha_within", "mean_pct_v_within", "mean_share_mkt", "mean_share_pl",
        "tc_mkt", "tc_pl", "sales_mkt", "sales_pl", (F.col("n_firms") / F.col("_t_n_firms")).alias("firm_share"), (F.col("_mu") / F.col("tc_mkt")).alias("mu_cw_mkt"), (F.col("tc_mkt") / F.col("_t_tc_mkt")).alias("share_tc_mkt"), (F.col("tc_pl") / F.col("_t_tc_pl")).alias("share_tc_pl"),
        (F.col("tc_pl") / F.col("tc_mkt")).alias("tc_ratio"), F.when(F.abs(change) > 1e-9 * F.col("_t_tc_mkt"), (F.col("tc_pl") - F.col("tc_mkt")) / change).alias("gain_share"), (F.col("sales_pl") / F.col("sales_mkt")).alias("sales_ratio"), (F.col("_lmu") / F.col("tc_mkt")).alias("wmean_log_mu_mkt"), (F.col("_lr") / F.col("tc_mkt")).alias("wmean_log_tc_ratio"),
    )


def support(df: DataFrame, bound: float = 1.0) -> DataFrame:
    """Per planner, how much stands on firms whose alpha is bound or more, and at its greatest value: of firms, market leaders, costs and the change of cost."""
    top = df.groupBy("planner").agg(F.max("alpha").alias("_top"))
    df = df.join(F.broadcast(top), "planner")  # a row a planner
    over, at, leader = F.col("alpha") >= bound, F.col("alpha") == F.col("_top"), F.col("size_rank") == "1_leader"
    share = lambda c: F.avg(c.cast("double"))
    part = lambda c: F.sum(F.when(over, c).otherwise(0.0)) / F.sum(c)
    gain = F.col("tc_pl") - F.col("tc_mkt")
    change = F.sum(gain)
    return df.groupBy("planner").agg(
        F.count("*").alias("n"), F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"), share(over).alias("firms_over"), share(at).alias("firms_at_max"), F.avg(F.when(leader, over.cast("double"))).alias("leaders_over"),
        F.avg(F.when(leader, at.cast("double"))).alias("leaders_at_max"), part(F.col("tc_mkt")).alias("tc_mkt_over"), part(F.col("tc_pl")).alias("tc_pl_over"), F.when(F.abs(change) > 1e-9 * F.sum("tc_mkt"), F.sum(F.when(over, gain).otherwise(0.0)) / change).alias("gain_over"),
    )


def ratio_check(df: DataFrame, tolerance: float) -> DataFrame:
    """Per planner: its cost over the market's, the correlation of alpha and v, the cost-weighted markup, the largest gap of shares that should sum to one in
    each market, and whether that is within tolerance and every log is defined."""
    shares = df.groupBy("planner", "market_id").agg(F.sum("share_mkt").alias("a"), F.sum("share_pl").alias("b"))
    gap = shares.groupBy("planner").agg(F.max(F.greatest(F.abs(F.col("a") - 1), F.abs(F.col("b") - 1))).alias("gap"), F.count("*").alias("n_markets"))
    sound = (F.col("alpha") > 0) & (F.col("v") > 0) & (F.col("mu_mkt") > 0) & (F.col("tc_pl") > 0) & (F.col("tc_mkt") > 0)
    made = df.groupBy("planner").agg(F.count("*").alias("n_active"), (F.sum("tc_pl") / F.sum("tc_mkt")).alias("tc_ratio"), F.corr("alpha", "v").alias("corr_alpha_v"), (F.sum(F.col("mu_mkt") * F.col("tc_mkt")) / F.sum("tc_mkt")).alias("mu_cw"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("unsound"))
    return made.join(gap, "planner").select("planner", "n_active", "n_markets", "tc_ratio", "corr_alpha_v", "mu_cw", ((F.col("gap") < tolerance) & (F.col("unsound") == 0)).alias("passed"))
