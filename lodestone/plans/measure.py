"""Estimators, roll-ups, scoring and episodes over draws and ledgers derived from the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import classify, stats
from lodestone.operators import episodes, measures, rollup, scoring
from lodestone.plans.base import frame, register

LEDGER = """
SELECT event_id AS row_id, concat('m', CAST(user_id % 7 AS STRING)) AS model, concat('t', CAST(user_id % 3 AS STRING)) AS target, event_id % 5 AS draw, event_id % 4 * 100 AS tokens,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'end_turn' WHEN 'view' THEN 'max_tokens' ELSE 'stop' END AS stop_reason,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok, round(value, 4) AS usd, user_id % 90 AS seconds, concat('h', CAST(event_id % 6 AS STRING)) AS host,
  CASE event_type WHEN 'view' THEN 'synthesis' ELSE 'direct' END AS call_class
FROM events
"""
DRAWS = """
SELECT event_id AS draw_id, concat('t', CAST(user_id % 3 AS STRING)) AS target, concat('m', CAST(user_id % 7 AS STRING)) AS model, event_id % 5 AS draw, event_id % 4 * 100 AS tokens,
  concat('c', CAST(user_id % 20 AS STRING)) AS cell, event_id AS kind,
  CASE event_type WHEN 'error' THEN 'infra_error' WHEN 'signup' THEN 'raised' WHEN 'purchase' THEN 'silent' ELSE 'ok' END AS outcome,
  CASE WHEN event_type IN ('click', 'view') AND event_id % 3 <> 0 THEN 1 ELSE 0 END AS perfect,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE round(value, 4) END AS usd, user_id % 90 AS seconds,
  CASE event_id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.5e0 ELSE 1e0 END AS recall_min, CASE event_id % 6 WHEN 0 THEN 0.5e0 ELSE 1e0 END AS precision_min
FROM events
"""
CELLS = "SELECT concat(lang, '|', source) AS cell, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS k FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY concat(lang, '|', source)"


def ledger(spark, sf_dir):
    return frame(spark, sf_dir, LEDGER)


def draws(spark, sf_dir):
    return frame(spark, sf_dir, DRAWS)


def cells(spark, sf_dir):
    return frame(spark, sf_dir, CELLS)


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    mid, div = f"({k} * 1.0 / {n} + 3.8416 / (2 * {n}))", f"(1 + 3.8416 / {n})"
    half = f"(1.96 * sqrt({k} * 1.0 / {n} * (1 - {k} * 1.0 / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, ({mid} - {half}) / {div}) END", f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, ({mid} + {half}) / {div}) END"


LO, HI = wilson_sql("k", "n")


@register("k01_wilson", f"WITH c AS ({CELLS}) SELECT cell, n, CAST(k AS BIGINT) AS k, round({LO}, 9) AS lo, round({HI}, 9) AS hi FROM c")
def wilson(spark, sf_dir):
    w = stats.wilson(F.col("k"), F.col("n"))
    return cells(spark, sf_dir).select("cell", "n", "k", F.round(w["lo"], 9).alias("lo"), F.round(w["hi"], 9).alias("hi"))


@register("k02_newcombe", f"""WITH c AS ({CELLS}), w AS (SELECT *, k * 1.0 / n AS p, {LO} AS lo, {HI} AS hi FROM c WHERE n > 0) SELECT a.cell AS a, b.cell AS b, round(a.p - b.p, 9) AS d, round(a.p - b.p - sqrt((a.p - a.lo) ** 2 + (b.hi - b.p) ** 2), 9) AS lo, round(a.p - b.p + sqrt((a.hi - a.p) ** 2 + (b.p - b.lo) ** 2), 9) AS hi FROM w a JOIN w b ON split_part(a.cell, '|', 2) = split_part(b.cell, '|', 2) AND a.cell < b.cell""")
def newcombe(spark, sf_dir):
    c = cells(spark, sf_dir).where("n > 0").withColumn("s", F.split_part("cell", F.lit("|"), F.lit(2)))
    j = c.alias("a").join(c.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.cell") < F.col("b.cell")))
    x = stats.newcombe(F.col("a.k"), F.col("a.n"), F.col("b.k"), F.col("b.n"))
    return j.select(F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), *(F.round(x[f], 9).alias(f) for f in ("d", "lo", "hi")))


@register("k03_nearest_rank", f"WITH l AS ({LEDGER}) SELECT model, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95 FROM l GROUP BY model")
def nearest_rank(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("model").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seconds)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("p95"))


@register("k04_quantile_conventions", f"WITH l AS ({LEDGER}), s AS (SELECT model, list_sort(list(seconds)) AS xs FROM l GROUP BY model) SELECT model, xs[CAST(floor(0.9 * (len(xs) - 1)) AS BIGINT) + 1] AS floor_p90, xs[least(len(xs) - 1, CAST(floor(0.9 * len(xs)) AS BIGINT)) + 1] AS clipped_p90, xs[len(xs) // 2 + 1] AS upper_median, list_aggregate(xs, 'median') AS true_median FROM s")
def quantile_conventions(spark, sf_dir):
    d = ledger(spark, sf_dir)
    found = measures.ranked(d, "model", "seconds", {"floor_p90": measures.floor_90(), "clipped_p90": measures.clipped_90(), "upper_median": measures.upper_half()})
    return found.join(d.groupBy("model").agg(F.median("seconds").alias("true_median")), "model")


@register("k05_pass_at", f"WITH c AS ({CELLS}), t AS (SELECT cell, n, k AS c, u AS k FROM c, unnest([1, 2, 5]) AS x(u)) SELECT cell, k, CASE WHEN k <= n THEN round(1 - (SELECT coalesce(product(greatest(n - c - i, 0) * 1.0 / (n - i)), 1.0) FROM unnest(range(0, k)) AS r(i)), 9) END AS pass_at, CASE WHEN k <= n THEN round((SELECT coalesce(product(greatest(c - i, 0) * 1.0 / (n - i)), 1.0) FROM unnest(range(0, k)) AS r(i)), 9) END AS pass_hat FROM t")
def pass_at(spark, sf_dir):
    d = cells(spark, sf_dir).select("cell", "n", F.col("k").alias("c"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("k"))
    return d.select("cell", "k", F.round(stats.pass_at(F.col("n"), F.col("c"), F.col("k")), 9).alias("pass_at"), F.round(stats.pass_hat(F.col("n"), F.col("c"), F.col("k")), 9).alias("pass_hat"))


@register("k06_mde", f"WITH c AS ({CELLS}) SELECT cell, round((1.959964 + 0.841621) * sqrt(0.25 * (1.0 / n + 0.05)), 9) AS mde FROM c WHERE n > 0")
def mde(spark, sf_dir):
    return cells(spark, sf_dir).where("n > 0").select("cell", F.round(stats.mde(F.lit(0.5), F.col("n"), F.lit(20.0)), 9).alias("mde"))


_S = f"WITH c AS ({CELLS}), r AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS rk FROM c)"


@register("k12_spearman", f"{_S} SELECT round(corr(rn, rk), 9) AS rho FROM r")
def spearman(spark, sf_dir):
    """Over the cells, of which there are as many as pairs of language and source."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    return cells(spark, sf_dir).select(rank("n").alias("rn"), rank("k").alias("rk")).agg(F.round(F.corr("rn", "rk"), 9).alias("rho"))


@register("k15_separable_pairs", f"WITH c AS ({CELLS}), w AS (SELECT cell, {LO} AS lo, {HI} AS hi FROM c) SELECT a.cell, count(*) AS above FROM w a JOIN w b ON a.lo > b.hi GROUP BY a.cell")
def separable_pairs(spark, sf_dir):
    x = stats.wilson(F.col("k"), F.col("n"))
    w = cells(spark, sf_dir).select("cell", x["lo"].alias("lo"), x["hi"].alias("hi"))
    return w.alias("a").join(w.select("hi").alias("b"), F.col("a.lo") > F.col("b.hi")).groupBy("a.cell").agg(F.count("*").alias("above"))


@register("k16_curtailment", f"WITH d AS ({DRAWS}) SELECT cell, count(*) FILTER (WHERE outcome <> 'infra_error') AS scored, CASE WHEN count(*) FILTER (WHERE outcome <> 'infra_error') > 0 AND (min(perfect) FILTER (WHERE outcome <> 'infra_error')) = (max(perfect) FILTER (WHERE outcome <> 'infra_error')) THEN true ELSE false END AS stop FROM d GROUP BY cell")
def curtailment(spark, sf_dir):
    scored = F.when(F.col("outcome") != "infra_error", F.col("perfect"))
    return draws(spark, sf_dir).groupBy("cell").agg(F.count(scored).alias("scored"), F.coalesce(F.min(scored) == F.max(scored), F.lit(False)).alias("stop"))


@register("c13_failure_modes", f"WITH d AS ({DRAWS}) SELECT target, CASE WHEN recall_min = 1 AND precision_min = 1 THEN 'perfect' WHEN outcome = 'infra_error' THEN 'infra_error' WHEN outcome = 'raised' THEN 'loud' WHEN recall_min = 0 THEN 'silent_empty' ELSE 'silent_partial' END AS mode, count(*) AS n FROM d GROUP BY 1, 2")
def failure_modes(spark, sf_dir):
    return draws(spark, sf_dir).withColumn("mode", classify.failure_mode(F.col("outcome"), F.col("recall_min"), F.col("precision_min"))).groupBy("target", "mode").agg(F.count("*").alias("n"))


@register("c15_stop_kinds", f"WITH l AS ({LEDGER}) SELECT host, CASE WHEN stop_reason = 'max_tokens' THEN 'truncated' WHEN stop_reason IN ('end_turn', 'stop') THEN 'natural' WHEN tokens >= 300 THEN 'truncated' ELSE 'host_cut' END AS kind, count(*) AS n FROM l GROUP BY 1, 2")
def stop_kinds(spark, sf_dir):
    return ledger(spark, sf_dir).withColumn("kind", classify.stop_kind(F.col("stop_reason"), F.col("tokens"), F.lit(300))).groupBy("host", "kind").agg(F.count("*").alias("n"))


@register("c18_scored_draws", f"WITH d AS ({DRAWS}) SELECT cell, count(*) AS n FROM d WHERE outcome NOT IN ('not_attempted', 'infra_error') GROUP BY cell")
def scored_draws(spark, sf_dir):
    return draws(spark, sf_dir).where("outcome not in ('not_attempted', 'infra_error')").groupBy("cell").agg(F.count("*").alias("n"))


@register("c23_evidence_score", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 3 ELSE 0 END + CASE WHEN c_nationkey % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END - CASE WHEN c_nationkey > 20 THEN 4 ELSE 0 END AS score FROM customer")
def evidence_score(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer")
    terms = ((F.col("c_acctbal") > 0, 3), (F.col("c_nationkey") % 2 == 0, 3), (F.col("c_mktsegment") == "BUILDING", 2), (F.col("c_nationkey") > 20, -4))
    return d.select("c_custkey", sum((F.when(c, w).otherwise(0) for c, w in terms), F.lit(0)).alias("score"))


# ---- J
_CLAIMS = f"d AS ({DRAWS}), l AS ({LEDGER}), dr AS (SELECT *, row_number() OVER (PARTITION BY model, target, draw, tokens ORDER BY cell, kind) AS r FROM d WHERE outcome <> 'infra_error'), lr AS (SELECT *, row_number() OVER (PARTITION BY model, target, draw, tokens ORDER BY row_id DESC) AS r FROM l WHERE ok = 1)"


def _claimed(spark, sf_dir):
    bought = ledger(spark, sf_dir).where("ok = 1")
    return bought, rollup.purchases(draws(spark, sf_dir).where("outcome <> 'infra_error'").drop("usd"), bought)


@register("j01_purchases", f"WITH {_CLAIMS} SELECT draw_id, row_id, lr.usd FROM dr LEFT JOIN lr USING (model, target, draw, tokens, r)")
def purchases(spark, sf_dir):
    return _claimed(spark, sf_dir)[1].select("draw_id", "row_id", "usd")


@register("j03_unclaimed", f"WITH {_CLAIMS}, c AS (SELECT row_id FROM dr JOIN lr USING (model, target, draw, tokens, r)) SELECT model, count(*) AS n FROM l WHERE ok = 1 AND row_id NOT IN (SELECT row_id FROM c) GROUP BY model")
def unclaimed(spark, sf_dir):
    bought, claimed = _claimed(spark, sf_dir)
    return rollup.unclaimed(bought, claimed).groupBy("model").agg(F.count("*").alias("n"))


@register("j04_long_table", f"WITH d AS ({DRAWS}) SELECT metric, count(value) AS n, round(sum(value), 4) AS total FROM (SELECT draw_id, 'perfect' AS metric, CAST(perfect AS DOUBLE) AS value FROM d UNION ALL SELECT draw_id, 'usd', usd FROM d UNION ALL SELECT draw_id, 'seconds', seconds FROM d UNION ALL SELECT draw_id, 'recall_min', recall_min FROM d) GROUP BY metric")
def long_table(spark, sf_dir):
    d = rollup.unpivot(draws(spark, sf_dir), ["draw_id"], ["perfect", "usd", "seconds", "recall_min"])
    return d.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("j08_aggregate", f"""WITH d AS ({DRAWS}), a AS (SELECT target, model, count(*) FILTER (WHERE outcome <> 'infra_error') AS n, count(*) FILTER (WHERE outcome <> 'infra_error' AND perfect = 1) AS k, count(*) AS attempted, sum(usd) AS usd,
  count(*) FILTER (WHERE usd IS NULL) AS unpriced, count(*) FILTER (WHERE outcome = 'silent' AND perfect = 0) AS silent, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95 FROM d GROUP BY target, model)
SELECT target, model, n, k, attempted, unpriced, p50, p95, round(k * 1.0 / nullif(n, 0), 6) AS rate, round({LO}, 6) AS lo, round({HI}, 6) AS hi, round(usd, 6) AS usd,
  CASE WHEN k > 0 AND unpriced = 0 AND usd > 0 THEN round(usd / k, 6) END AS usd_per_success, round(silent * 1.0 / nullif(n - k, 0), 6) AS silent_share FROM a""")
def aggregate(spark, sf_dir):
    return rollup.aggregate(draws(spark, sf_dir))


#: Draws with all that a run records, and the purchase of those that have one.
WHOLE_DRAWS = f"""
SELECT draw_id, target, model, cell, draw, tokens, usd, draw_id % 1000 AS bytes, draw_id % 17 = 0 AS truncated, draw_id % 19 = 0 AS redrawn, draw_id % 300 AS reasoning_tokens, cell = 'c1' AND draw = 3 AS excluded,
  CASE WHEN outcome = 'infra_error' THEN 'infra_error' WHEN draw_id % 43 = 0 THEN 'not_attempted' WHEN perfect = 1 THEN 'perfect' WHEN outcome = 'raised' THEN 'loud' ELSE 'silent_partial' END AS mode,
  CASE WHEN draw_id % 31 <> 0 THEN round(seconds * 0.01, 4) END AS bought_usd, CASE WHEN draw_id % 31 <> 0 THEN seconds END AS bought_seconds, CASE WHEN draw_id % 31 <> 0 AND draw_id % 5 <> 0 THEN seconds % 7 END AS bought_ttft_s
FROM ({DRAWS})
"""
_SCORED = "NOT excluded AND mode NOT IN ('not_attempted', 'infra_error')"


def whole_draws(spark, sf_dir):
    return frame(spark, sf_dir, WHOLE_DRAWS)


@register("j04_variance_rows", f"""WITH d AS (SELECT *, {_SCORED} AS s, {_SCORED} AND bought_usd IS NOT NULL AS b FROM ({WHOLE_DRAWS})), m AS (
SELECT 'attempted' AS metric, CASE WHEN s THEN 1e0 ELSE 0e0 END AS value FROM d UNION ALL SELECT 'excluded', 1e0 FROM d WHERE excluded UNION ALL SELECT 'infra_error', 1e0 FROM d WHERE NOT excluded AND mode = 'infra_error'
UNION ALL SELECT 'perfect', CASE WHEN mode = 'perfect' THEN 1e0 ELSE 0e0 END FROM d WHERE s UNION ALL SELECT 'silent_failure', CASE WHEN mode LIKE 'silent%' THEN 1e0 ELSE 0e0 END FROM d WHERE s
UNION ALL SELECT 'loud_failure', CASE WHEN mode = 'loud' THEN 1e0 ELSE 0e0 END FROM d WHERE s UNION ALL SELECT 'usd', usd FROM d WHERE s UNION ALL SELECT 'output_tokens', tokens FROM d WHERE s UNION ALL SELECT 'source_bytes', bytes FROM d WHERE s
UNION ALL SELECT 'truncated', CASE WHEN truncated THEN 1e0 ELSE 0e0 END FROM d WHERE s UNION ALL SELECT 'redrawn', CASE WHEN redrawn THEN 1e0 ELSE 0e0 END FROM d WHERE s UNION ALL SELECT 'reasoning_tokens', reasoning_tokens FROM d WHERE s
UNION ALL SELECT 'purchase_unknown', 1e0 FROM d WHERE s AND NOT b UNION ALL SELECT 'usd_purchase', bought_usd FROM d WHERE b UNION ALL SELECT 'seconds', bought_seconds FROM d WHERE b UNION ALL SELECT 'ttft_s', bought_ttft_s FROM d WHERE b
UNION ALL SELECT 'tokens_per_s', round(tokens * 1e0 / (bought_seconds - bought_ttft_s), 1) FROM d WHERE b AND bought_seconds > bought_ttft_s)
SELECT metric, count(*) AS n, round(sum(value), 4) AS total FROM m WHERE value IS NOT NULL GROUP BY metric""")
def variance_rows(spark, sf_dir):
    d = rollup.variance_rows(whole_draws(spark, sf_dir), ["target", "model"])
    return d.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("j08_cell_summary", f"""WITH l AS ({LEDGER}), d AS (SELECT *, {_SCORED} AS s, {_SCORED} AND bought_usd IS NOT NULL AS b FROM ({WHOLE_DRAWS})),
a AS (SELECT target, model, count(*) FILTER (WHERE s) AS attempted, count(*) FILTER (WHERE s) AS n, count(*) FILTER (WHERE s AND mode = 'perfect') AS k, count(*) FILTER (WHERE s AND mode LIKE 'silent%') AS silent,
  count(*) FILTER (WHERE NOT excluded AND mode = 'infra_error') AS infra, count(*) FILTER (WHERE excluded) AS excluded, count(*) FILTER (WHERE s AND truncated) AS truncated, count(*) FILTER (WHERE s AND redrawn) AS redrawn,
  count(*) FILTER (WHERE s AND NOT b) AS unpriced, coalesce(sum(bought_usd) FILTER (WHERE b), 0) AS usd, coalesce(sum(usd) FILTER (WHERE s), 0) AS paid, quantile_disc(CASE WHEN b THEN CAST(bought_seconds AS DOUBLE) END, 0.5) AS p50, quantile_disc(CASE WHEN b THEN CAST(bought_seconds AS DOUBLE) END, 0.95) AS p95,
  quantile_disc(CASE WHEN b AND bought_seconds > bought_ttft_s THEN round(tokens * 1e0 / (bought_seconds - bought_ttft_s), 1) END, 0.5) AS tokens_per_s FROM d GROUP BY target, model),
c AS (SELECT target, model, count(*) AS calls, round(sum(CASE WHEN ok = 0 THEN usd ELSE 0 END), 6) AS usd_failed, round(1 - avg(ok), 9) AS error_rate FROM l GROUP BY target, model)
SELECT target, model, attempted, n, k, silent, infra, excluded, truncated, redrawn, unpriced, p50, p95, tokens_per_s, round(k * 1.0 / nullif(n, 0), 9) AS rate, round({LO}, 4) AS lo, round({HI}, 4) AS hi, round(usd, 6) AS usd, round(paid, 6) AS paid,
  CASE WHEN k > 0 AND usd <> 0 AND unpriced = 0 THEN round(usd / k, 6) END AS usd_per_success, usd <> 0 AND paid < usd AS replayed, round(infra * 1.0 / nullif(n + infra, 0), 9) AS infra_rate,
  CASE WHEN n > k THEN round(silent * 1.0 / (n - k), 4) END AS silent_share, CASE WHEN n > k THEN round({wilson_sql('silent', '(n - k)')[0]}, 4) END AS silent_lo, calls, usd_failed, error_rate FROM a LEFT JOIN c USING (target, model)""")
def cell_summary(spark, sf_dir):
    long = rollup.variance_rows(whole_draws(spark, sf_dir), ["target", "model"])
    return rollup.cell_summary(long, ledger(spark, sf_dir), ["target", "model"], ["target", "model"])


@register("j11_ledger_by_class", f"WITH l AS ({LEDGER}) SELECT call_class, count(*) AS calls, round(sum(usd), 4) AS usd, CAST(sum(tokens) AS BIGINT) AS tokens FROM l GROUP BY call_class")
def ledger_by_class(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("call_class").agg(F.count("*").alias("calls"), F.round(F.sum("usd"), 4).alias("usd"), F.sum("tokens").cast("bigint").alias("tokens"))


PRICES = "SELECT concat('m', CAST(n_nationkey AS STRING)) AS price_model, n_nationkey + 1.0 AS per_token FROM nation WHERE n_nationkey < 7"


@register("j12_list_cost", f"WITH l AS ({LEDGER}), p AS ({PRICES}) SELECT row_id, round((tokens * 0.1 + 10) * per_token / 1000000.0, 12) AS list_usd FROM l LEFT JOIN p ON model = price_model")
def list_cost(spark, sf_dir):
    p = frame(spark, sf_dir, PRICES)
    j = ledger(spark, sf_dir).join(p, F.col("model") == F.col("price_model"), "left")
    return j.select("row_id", F.round((F.col("tokens") * 0.1 + 10) * F.col("per_token") / 1000000.0, 12).alias("list_usd"))


@register("j13_host_mix", f"WITH l AS ({LEDGER}) SELECT model, host, count(*) AS n, sum(CASE WHEN ok = 0 THEN 1 ELSE 0 END) AS failed FROM l GROUP BY model, host")
def host_mix(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("model", "host").agg(F.count("*").alias("n"), F.sum(1 - F.col("ok")).alias("failed"))


@register("j17_spend_by_mode", f"WITH d AS ({DRAWS}) SELECT outcome, count(*) AS n, round(avg(recall_min), 6) AS recall, round(sum(usd), 4) AS usd FROM d GROUP BY outcome")
def spend_by_mode(spark, sf_dir):
    return draws(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("recall_min"), 6).alias("recall"), F.round(F.sum("usd"), 4).alias("usd"))


@register("j18_missing_bounds", f"WITH d AS ({DRAWS}), a AS (SELECT cell, count(*) AS n, count(*) FILTER (WHERE outcome = 'infra_error') AS lost, count(*) FILTER (WHERE outcome <> 'infra_error' AND perfect = 1) AS k FROM d GROUP BY cell) SELECT cell, round(k * 1.0 / n, 9) AS low, round((k + lost) * 1.0 / n, 9) AS high FROM a")
def missing_bounds(spark, sf_dir):
    lost = F.count_if(F.col("outcome") == "infra_error")
    d = draws(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), lost.alias("lost"), F.count_if((F.col("outcome") != "infra_error") & (F.col("perfect") == 1)).alias("k"))
    return d.select("cell", F.round(F.col("k") / F.col("n"), 9).alias("low"), F.round((F.col("k") + F.col("lost")) / F.col("n"), 9).alias("high"))


@register("j21_faulty_models", f"WITH l AS ({LEDGER}), f AS (SELECT DISTINCT model FROM l WHERE ok = 0 AND host = 'h1') SELECT model, count(*) FILTER (WHERE call_class = 'direct') AS direct, count(*) FILTER (WHERE call_class = 'synthesis') AS synthesis FROM l WHERE model IN (SELECT model FROM f) GROUP BY model")
def faulty_models(spark, sf_dir):
    d = ledger(spark, sf_dir)
    j = d.join(d.where("ok = 0 and host = 'h1'").select("model").distinct(), "model", "left_semi")
    return j.groupBy("model").pivot("call_class", ["direct", "synthesis"]).agg(F.count(F.lit(1))).na.fill(0)


@register("j22_draws_left", f"WITH d AS ({DRAWS}), a AS (SELECT cell, count(*) FILTER (WHERE outcome <> 'infra_error') AS n, coalesce(min(perfect) FILTER (WHERE outcome <> 'infra_error') = max(perfect) FILTER (WHERE outcome <> 'infra_error'), false) AS unanimous FROM d GROUP BY cell) SELECT cell, greatest(0, CASE WHEN n < 10 THEN 10 WHEN unanimous THEN 10 ELSE 20 END - n) AS left_over FROM a")
def draws_left(spark, sf_dir):
    scored = F.when(F.col("outcome") != "infra_error", F.col("perfect"))
    d = draws(spark, sf_dir).groupBy("cell").agg(F.count(scored).alias("n"), F.coalesce(F.min(scored) == F.max(scored), F.lit(False)).alias("u"))
    return d.select("cell", F.greatest(F.lit(0), F.when((F.col("n") < 10) | F.col("u"), 10).otherwise(20) - F.col("n")).alias("left_over"))


@register("j24_unanimity", f"WITH l AS ({LEDGER}) SELECT model, count(DISTINCT stop_reason) AS readouts FROM l GROUP BY model HAVING count(DISTINCT stop_reason) > 1")
def unanimity(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("model").agg(F.count_distinct("stop_reason").alias("readouts")).where("readouts > 1")


# ---- H
REFERENCE = "SELECT l_orderkey % 200 AS page, concat('B-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, l_partkey * 1000000 + l_suppkey AS ord, l_returnflag AS flag, concat(' ', l_linestatus, '  x ') AS status FROM lineitem"
CANDIDATE = "SELECT l_orderkey % 200 AS page, CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_orderkey % 37 = 0 THEN concat('Z-', CAST(l_orderkey AS STRING)) ELSE concat(' B-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), ' ') END AS id, l_partkey * 1000000 + l_suppkey AS ord, CASE WHEN l_orderkey % 11 = 0 THEN 'X' ELSE l_returnflag END AS flag, concat(l_linestatus, ' x') AS status FROM lineitem"
_SIDES = f"""r AS (SELECT * FROM (SELECT page, id, flag, trim(regexp_replace(status, '\\s+', ' ', 'g')) AS status, row_number() OVER (PARTITION BY page, id ORDER BY ord) AS n FROM ({REFERENCE})) WHERE n = 1),
c AS (SELECT * FROM (SELECT page, trim(id) AS id, flag, trim(status) AS status, row_number() OVER (PARTITION BY page, trim(id) ORDER BY ord) AS n FROM ({CANDIDATE}) WHERE id IS NOT NULL) WHERE n = 1),
j AS (SELECT coalesce(r.page, c.page) AS page, coalesce(r.id, c.id) AS id, r.id IS NOT NULL AS a, c.id IS NOT NULL AS b, r.flag AS rf, c.flag AS cf, r.status AS rs, c.status AS cs FROM r FULL OUTER JOIN c ON r.page = c.page AND r.id = c.id)"""
FIELDS = ["flag", "status"]


def _compared(spark, sf_dir):
    return scoring.compare(frame(spark, sf_dir, REFERENCE), frame(spark, sf_dir, CANDIDATE), FIELDS)


@register("h01_score", f"WITH {_SIDES} SELECT page, count(*) FILTER (WHERE a) AS n_ref, count(*) FILTER (WHERE b) AS n_cand, count(*) FILTER (WHERE a AND b) AS matched, round(count(*) FILTER (WHERE a AND b) * 1.0 / nullif(count(*) FILTER (WHERE a), 0), 6) AS recall, round(count(*) FILTER (WHERE a AND b) * 1.0 / nullif(count(*) FILTER (WHERE b), 0), 6) AS precision, array_to_string(list_sort(coalesce(list(id) FILTER (WHERE a AND NOT b), []))[1:40], ',') AS missed, array_to_string(list_sort(coalesce(list(id) FILTER (WHERE b AND NOT a), []))[1:40], ',') AS spurious FROM j GROUP BY page")
def score(spark, sf_dir):
    d = scoring.score(_compared(spark, sf_dir))
    return d.withColumns({"missed": F.array_join("missed", ","), "spurious": F.array_join("spurious", ",")})


@register("h02_field_agreement", f"WITH {_SIDES} SELECT field, sum(CASE WHEN x IS NOT DISTINCT FROM y THEN 1 ELSE 0 END) AS agree, count(*) AS compared, round(sum(CASE WHEN x IS NOT DISTINCT FROM y THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS rate FROM (SELECT 'flag' AS field, rf AS x, cf AS y FROM j WHERE a AND b UNION ALL SELECT 'status', rs, cs FROM j WHERE a AND b) WHERE x IS NOT NULL OR y IS NOT NULL GROUP BY field")
def field_agreement(spark, sf_dir):
    return scoring.field_agreement(_compared(spark, sf_dir), FIELDS)


@register("h03_perfect", f"WITH {_SIDES}, s AS (SELECT page, round(count(*) FILTER (WHERE a AND b) * 1.0 / nullif(count(*) FILTER (WHERE a), 0), 6) AS r, round(count(*) FILTER (WHERE a AND b) * 1.0 / nullif(count(*) FILTER (WHERE b), 0), 6) AS p FROM j GROUP BY page) SELECT min(coalesce(r, 0)) AS recall_min, min(coalesce(p, 0)) AS precision_min, min(coalesce(r, 0)) = 1 AND min(coalesce(p, 0)) = 1 AS perfect FROM s")
def perfect(spark, sf_dir):
    return scoring.perfect(scoring.score(_compared(spark, sf_dir)))


@register("h09_confusion", "SELECT lang, count(*) FILTER (WHERE toxic = 0) AS accepted, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS escapes, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS false_rejects, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS caught FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang")
def confusion(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT lang, quality, toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id")
    t, q = F.col("toxic") == 1, F.col("quality") == 1
    return d.groupBy("lang").agg(F.count_if(~t).alias("accepted"), F.count_if(~t & ~q).alias("escapes"), F.count_if(t & q).alias("false_rejects"), F.count_if(t & ~q).alias("caught"))


@register("h12_survival", f"WITH d AS ({DRAWS}), g AS (SELECT model, target, count(*) AS n, sum(perfect) AS k, bool_and(perfect = 1) AS all_survived, grouping(model) AS gm, grouping(target) AS gt FROM d GROUP BY GROUPING SETS ((model, target), (model), (target), ())) SELECT model, target, n, CAST(k AS BIGINT) AS survived, all_survived, gm, gt, round({LO}, 6) AS lo, round({HI}, 6) AS hi FROM g")
def survival(spark, sf_dir):
    """The matrix and its margins in one pass, with intervals."""
    g = draws(spark, sf_dir).cube("model", "target").agg(F.count("*").alias("n"), F.sum("perfect").cast("bigint").alias("survived"), F.bool_and(F.col("perfect") == 1).alias("all_survived"), F.grouping("model").alias("gm"), F.grouping("target").alias("gt"))
    w = stats.wilson(F.col("survived"), F.col("n"))
    return g.select("model", "target", "n", "survived", "all_survived", "gm", "gt", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))


@register("h13_signatures", f"WITH d AS ({DRAWS}), s AS (SELECT model, array_to_string(list_sort(list(DISTINCT outcome)), ',') AS signature FROM d GROUP BY model, cell) SELECT signature, count(*) AS n FROM s GROUP BY signature")
def signatures(spark, sf_dir):
    s = draws(spark, sf_dir).groupBy("model", "cell").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("signature"))
    return s.groupBy("signature").agg(F.count("*").alias("n"))


# ---- L
STEPS = "SELECT conv_id AS episode, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) / 1000.0 AS spent, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'bad' WHEN role = 'assistant' THEN 'good' END AS draft FROM conversations"
_CAP = f"WITH s AS ({STEPS}), b AS (SELECT *, coalesce(lag(spent) OVER (PARTITION BY episode ORDER BY turn), 0) AS before FROM s), a AS (SELECT episode, max_by(draft, CASE WHEN draft IS NOT NULL THEN turn END) AS draft, max(spent) AS spent, count(*) AS turns FROM b WHERE before < 1.5 GROUP BY episode)"


_STOPPED = f"SELECT *, CASE WHEN episode % 5 = 0 THEN 'infra_error' WHEN episode % 5 = 1 THEN NULL ELSE 'submitted' END AS stop FROM ({STEPS})"
_UNSEEN = f"{_CAP}, t AS (SELECT episode, count(*) AS total, max(spent) AS ends FROM s GROUP BY episode), u AS (SELECT a.*, turns = total AND ends < 1.5 AND episode % 5 < 2 AS unobserved FROM a JOIN t USING (episode))"


@register("l01_at_cap", f"{_UNSEEN} SELECT episode, draft, round(spent, 6) AS spent, turns, unobserved FROM u")
def at_cap(spark, sf_dir):
    return episodes.at_cap(frame(spark, sf_dir, _STOPPED), 1.5).withColumn("spent", F.round("spent", 6))


@register("l02_frontier", f"{_UNSEEN}, f AS (SELECT count(*) FILTER (WHERE NOT unobserved) AS n, count(*) FILTER (WHERE NOT unobserved AND draft = 'good') AS k, count(*) FILTER (WHERE unobserved) AS unobserved, round(avg(spent) FILTER (WHERE NOT unobserved), 6) AS mean_spend FROM u) SELECT n, k AS ok, unobserved, mean_spend, round({LO}, 6) AS lo, round({HI}, 6) AS hi FROM f")
def frontier(spark, sf_dir):
    return episodes.frontier_point(episodes.at_cap(frame(spark, sf_dir, _STOPPED), 1.5))


@register("l03_carried_draft", f"WITH s AS ({STEPS}) SELECT episode, turn, last_value(draft IGNORE NULLS) OVER (PARTITION BY episode ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current FROM s")
def carried_draft(spark, sf_dir):
    return episodes.carried_draft(frame(spark, sf_dir, STEPS)).select("episode", "turn", "current")


# ---- N: designed semantics over an append-only log
LOG = "SELECT user_id AS entity, event_id AS seq, event_type AS milestone, ts AS observed_at FROM events"


@register("n05_log_fold", f"WITH o AS ({LOG}) SELECT entity, max_by(milestone, seq) AS milestone FROM o GROUP BY entity")
def log_fold(spark, sf_dir):
    return frame(spark, sf_dir, LOG).groupBy("entity").agg(F.max_by("milestone", "seq").alias("milestone"))


@register("n06_transitions", f"WITH o AS ({LOG}), t AS (SELECT entity, lag(milestone) OVER (PARTITION BY entity ORDER BY seq) AS a, milestone AS b FROM o) SELECT a AS from_state, b AS to_state, count(*) AS n FROM t WHERE a <> b GROUP BY a, b")
def transitions(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("seq")
    d = frame(spark, sf_dir, LOG).withColumn("from_state", F.lag("milestone").over(w)).where("from_state <> milestone")
    return d.groupBy("from_state", F.col("milestone").alias("to_state")).agg(F.count("*").alias("n"))


@register("n07_reporting_lag", f"SELECT l_returnflag, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95 FROM (SELECT l_returnflag, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_returnflag")
def reporting_lag(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT l_returnflag, datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    return d.groupBy("l_returnflag").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY d)").alias("p95"))


@register("n10_cadence_tier", "SELECT c_custkey, ntile(10) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS tier FROM customer")
def cadence_tier(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return frame(spark, sf_dir, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer").select("c_custkey", F.ntile(10).over(w).alias("tier"))
