"""Request metrics, rollups and savings (inventory rows 33, 34, 90, 91, 95-97, 100-102, 105, 106, 108, 111, 115, 116, 118, 120, 128-130, 136, 150, 171)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.numbers import percent


def filtered(requests: DataFrame, start=None, end=None, model: str | None = None, mode: str | None = None) -> DataFrame:
    """Rows 33 and 96: an inclusive time range, a model, a mode; what is None filters nothing."""
    out = requests
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    if model is not None:
        out = out.where(F.col("model") == model)
    if mode is not None:
        out = out.where(F.col("mode") == mode)
    return out


def page(requests: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows 34 and 171: the newest first; equal times by id."""
    return requests.orderBy(F.desc("ts"), "id").offset(offset).limit(limit)


def summary(requests: DataFrame) -> DataFrame:
    """Row 95: one row of totals; averages of nothing are 0."""
    saved = F.col("before") - F.col("after")
    return requests.agg(
        F.count("*").alias("total_requests"), F.coalesce(F.sum("before"), F.lit(0)).alias("total_before"), F.coalesce(F.sum("after"), F.lit(0)).alias("total_after"), F.coalesce(F.sum(saved), F.lit(0)).alias("total_saved"),
        F.round(F.coalesce(F.avg(saved), F.lit(0.0)), 4).alias("avg_saved"), F.count_if(F.col("mode") == "audit").alias("audit_count"), F.count_if(F.col("mode") == "optimize").alias("optimize_count"),
    )


def waste_histogram(waste: DataFrame, kinds: list[str], saved: str) -> DataFrame:
    """Row 97: sums of each kind of waste and what none of them explains, with percent of the largest."""
    sums = waste.agg(*(F.sum(k).alias(k) for k in kinds), F.sum(saved).alias("_saved"))
    rest = F.greatest(F.lit(0).cast("long"), F.col("_saved") - sum((F.col(k) for k in kinds), F.lit(0)))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("tokens")) for k in kinds), F.struct(F.lit("history_bloat").alias("kind"), rest.cast("long").alias("tokens")))).alias("p")
    rows = sums.select(pairs).select("p.*")
    top = F.max("tokens").over(Window.partitionBy(F.lit(1)))  # a row a kind
    return rows.select("kind", "tokens", F.when(top > 0, F.round(100.0 * F.col("tokens") / top, 1)).otherwise(F.lit(0.0)).alias("pct"))


def beacon_rollup(beacon: DataFrame, unit: str, counters: list[str]) -> DataFrame:
    """Rows 100 and 101: cumulative counters: the last state of an instance in a bucket, summed over instances."""
    each = beacon.groupBy(F.date_trunc(unit, "ts").alias("bucket"), "instance").agg(*(F.max(c).alias(c) for c in counters))
    return each.groupBy("bucket").agg(F.count("instance").alias("instances"), *(F.sum(c).alias(c) for c in counters))


def top_instances(beacon: DataFrame, counter: str, limit: int = 20) -> DataFrame:
    """Row 102: instances by the sum of their daily maxima."""
    daily = beacon.groupBy("instance", F.date_trunc("day", "ts").alias("day")).agg(F.max(counter).alias("m"))
    return daily.groupBy("instance").agg(F.sum("m").alias(counter), F.count("*").alias("days")).orderBy(F.desc(counter), "instance").limit(limit)


def savings_rollup(history: DataFrame, unit: str) -> DataFrame:
    """Rows 108 and 150: steps of a cumulative counter, never negative, by bucket; the last total is kept."""
    order = Window.partitionBy("instance").orderBy("ts", "id")
    step = F.greatest(F.col("total") - F.coalesce(F.lag("total").over(order), F.lit(0)), F.lit(0))
    steps = history.withColumn("step", step)
    return steps.groupBy("instance", F.date_trunc(unit, "ts").alias("bucket")).agg(F.sum("step").alias("saved"), F.max_by("total", F.struct("ts", "id")).alias("total"))


def ledger(events: DataFrame) -> DataFrame:
    """Rows 105, 106 and 115: totals over everything, each model and each mode."""
    return events.groupingSets([[], [F.col("model")], [F.col("mode")]], F.col("model"), F.col("mode")).agg(F.count("*").alias("requests"), F.sum(F.col("before") - F.col("after")).alias("saved"))


def latency(requests: DataFrame, value: str, *by: str) -> DataFrame:
    """Row 116: mean, exact interpolated percentiles, maximum."""
    p = F.expr(f"percentile({value}, array(0.5, 0.95, 0.99))")
    out = requests.groupBy(*by).agg(F.avg(value).alias("avg"), p.alias("p"), F.max(value).alias("max"))
    return out.select(*by, F.round("avg", 6).alias("avg"), *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), "max")


def throughput(requests: DataFrame, seconds: int) -> DataFrame:
    """Row 118: requests and tokens of the window that ends at the last request."""
    last = requests.agg(F.max("ts").alias("last"))
    recent = requests.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))  # the other side is one row
    return recent.agg(F.count("*").alias("requests"), F.coalesce(F.sum("before"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("before"), F.lit(0)) / F.lit(float(seconds)), 4).alias("tokens_per_s"))


def histogram(values: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Row 120: cumulative counts up to each bound."""
    return values.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_").replace("-", "m")) for b in bounds), F.count(value).alias("le_inf"))


def best_strategy(outcomes: DataFrame, least: int) -> DataFrame:
    """Row 128: the strategy with the lowest rate, below 1, among those with enough cases; the first one wins a tie."""
    rated = outcomes.groupBy("tool", "strategy").agg(F.count("*").alias("n"), F.avg("retrieved").alias("rate"), F.min("id").alias("first"))
    return rated.where((F.col("n") >= least) & (F.col("rate") < 1)).groupBy("tool").agg(F.min_by("strategy", F.struct("rate", "first")).alias("strategy"))


def holdout_savings(outcomes: DataFrame) -> DataFrame:
    """Rows 90, 129, 130: treated against control in the strata that have both; percent saved with a 95 % interval."""
    arms = outcomes.groupBy("stratum").agg(*(f(F.when(F.col("arm") == a, F.col("tokens"))).alias(f"{a}_{n}") for a in ("control", "treatment") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    both = arms.where((F.col("control_n") > 0) & (F.col("treatment_n") > 0))
    variance = lambda a: F.coalesce(F.col(f"{a}_var"), F.lit(0.0)) / F.col(f"{a}_n")
    n = F.col("treatment_n")
    total = both.agg(F.sum(n * (F.col("control_mean") - F.col("treatment_mean"))).alias("saved"), F.sum(n * F.col("control_mean")).alias("baseline"), F.sum(n * n * (variance("control") + variance("treatment"))).alias("var"), F.sum(n).alias("requests"))
    pct, half = F.col("saved") / F.col("baseline"), 1.96 * F.sqrt("var") / F.col("baseline")
    return total.select("requests", F.round("saved", 2).alias("saved"), F.round(100 * pct, 6).alias("pct"), F.round(100 * (pct - half), 6).alias("low"), F.round(100 * (pct + half), 6).alias("high"))


def baseline_backoff(requests: DataFrame, strata: DataFrame) -> DataFrame:
    """Row 91: a stratum's own mean, else that of the first stratum with its leading part, else the overall one.

    ``strata``: ``stratum, mean, place``, place telling which came first.
    """
    lead = F.substring_index("stratum", "|", 1)
    exact = strata.select("stratum", F.col("mean").alias("own"))
    by_lead = strata.groupBy(lead.alias("lead")).agg(F.min_by("mean", "place").alias("kin"))
    overall = strata.agg(F.avg("mean").alias("overall"))
    joined = requests.withColumn("lead", lead).join(exact, "stratum", "left").join(by_lead, "lead", "left").crossJoin(F.broadcast(overall))
    return joined.withColumns({"baseline": F.coalesce("own", "kin", "overall"), "level": F.when(F.col("own").isNotNull(), "exact").when(F.col("kin").isNotNull(), "lead").otherwise("overall")}).drop("own", "kin", "overall", "lead")


def period_cost(requests: DataFrame, prices: DataFrame, unit: str) -> DataFrame:
    """Rows 111 and 136: tokens times price by period; unknown models cost the default, the price of ``*``."""
    default = prices.where("model = '*'").select(F.col("price").alias("default_price"))
    known = prices.where("model != '*'")
    priced = requests.join(F.broadcast(known), "model", "left").crossJoin(F.broadcast(default))  # dimension tables of a row a model
    cost = F.col("before") * F.coalesce("price", "default_price") / 1e6
    return priced.groupBy(F.date_trunc(unit, "ts").alias("period"), "model").agg(F.round(F.sum(cost), 6).alias("cost"))


def share(part: Column, whole: Column) -> Column:
    """Row 120: a hit rate, null where there was nothing."""
    return F.when(whole != 0, part / whole)


def savings_snapshot(requests: DataFrame, by: str) -> DataFrame:
    """Row 109: tokens saved and sent by ``by`` with the share saved, the largest savings first."""
    each = requests.groupBy(by).agg(F.sum(F.col("before") - F.col("after")).alias("saved"), F.sum("after").alias("input"))
    return each.withColumn("percent", percent(F.col("saved"), F.col("saved") + F.col("input"), 2)).orderBy(F.desc("saved"), by)
