"""Run-log queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as O
from . import views as V

R = lambda c: F.round((F.col(c) if isinstance(c, str) else c) + 3.3e-10, 6)
NEW, OLD = "1-URGENT", "3-MEDIUM"
KEYS = "PARTITION BY run, dataset ORDER BY epoch"


def log(s, d):
    return V.run_log(s, d).select("run", "dataset", "epoch", "ap")


def best(s, d):
    return O.best_and_final(log(s, d)).select("run", "dataset", R("best_ap").alias("best_ap"), "best_epoch", R("final_ap").alias("final_ap"), "final_epoch")


def verdicts(s, d):
    b = O.best_and_final(log(s, d))
    a, c = b.where(F.col("run") == NEW).select("dataset", F.col("best_ap").alias("a")), b.where(F.col("run") == OLD).select("dataset", F.col("best_ap").alias("b"))
    return a.join(c, "dataset").select("dataset", R("a").alias("newer"), R("b").alias("older"), O.verdict(F.col("a"), F.col("b")).alias("verdict"))


def window(s, d):
    return O.common_window(log(s, d), NEW, OLD).select("dataset", "cap", *[R(c).alias(c) for c in ("newer", "older", "delta")])


def weighted(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderpriority").alias("run"), (F.col("o_totalprice") / 500000.0).alias("v"), (F.col("o_custkey") % 7 + 1).alias("n"))
    return O.weighted_mean(o, "v", "n", ["run"]).select("run", R("mean").alias("mean"))


def smooth(s, d):
    i = O.interpolated(log(s, d).withColumn("ap", F.when(F.col("epoch") % 4 > 0, F.col("ap"))))
    return i.withColumns({"filled": R("filled"), "smooth": R("smooth")})


def pr(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 100 / 100).alias("precision"), (F.col("o_custkey") % 100 / 100).alias("recall"), (F.col("o_totalprice") / 500000.0).alias("score"))
    return O.pr_summary(o, ["run"]).select("run", *[R(c).alias(c) for c in ("precision", "recall", "score", "f1")])


def timing(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderpriority").alias("run"), "o_orderkey", (F.col("o_totalprice") / 1e6 + 0.01).alias("t"))
    return O.timings(o, "t", "o_orderkey", 50, ["run"]).select("run", *[R(c).alias(c) for c in ("mean", "std", "least", "most", "fps")])


def validation(s, d):
    return O.best_validation(log(s, d).withColumnRenamed("ap", "val_loss"), keys=("run", "dataset")).withColumn("val_loss", R("val_loss"))


PLANS = {
    "r1_best_and_final": (best, f"WITH {V.RUN_LOG} SELECT run, dataset, round(max(ap) + 3.3e-10::DOUBLE,6) AS best_ap, min_by(epoch, (-ap, epoch)) AS best_epoch, round(max_by(ap, epoch) + 3.3e-10::DOUBLE,6) AS final_ap, max(epoch) AS final_epoch FROM run_log GROUP BY ALL"),
    "r2_matched_epochs": (lambda s, d: O.compare(log(s, d), NEW, OLD).select("dataset", "epoch", *[R(c).alias(c) for c in ("ap", "baseline", "delta")]), f"WITH {V.RUN_LOG} SELECT a.dataset, a.epoch, round(a.ap + 3.3e-10::DOUBLE,6) AS ap, round(b.ap + 3.3e-10::DOUBLE,6) AS baseline, round(a.ap-b.ap + 3.3e-10::DOUBLE,6) AS delta FROM run_log a LEFT JOIN run_log b ON a.dataset=b.dataset AND a.epoch=b.epoch AND b.run='{OLD}' WHERE a.run='{NEW}'"),
    "r3_sampled": (lambda s, d: O.sampled(log(s, d), [30, 40, 50]).withColumn("ap", R("ap")), f"WITH {V.RUN_LOG} SELECT run, dataset, epoch, round(ap + 3.3e-10::DOUBLE,6) AS ap FROM run_log QUALIFY epoch IN (30,40,50) OR epoch = max(epoch) OVER (PARTITION BY run, dataset)"),
    "r4_verdict": (verdicts, f"WITH {V.RUN_LOG}, b AS (SELECT run, dataset, max(ap) AS m FROM run_log GROUP BY ALL) SELECT a.dataset, round(a.m + 3.3e-10::DOUBLE,6) AS newer, round(b.m + 3.3e-10::DOUBLE,6) AS older, CASE WHEN a.m-b.m > 0.01 THEN 'WIN' WHEN a.m-b.m > -0.01 THEN 'tie' ELSE 'behind' END AS verdict FROM b a JOIN b ON a.dataset=b.dataset WHERE a.run='{NEW}' AND b.run='{OLD}'"),
    "r5_common_window": (window, f"WITH {V.RUN_LOG} SELECT a.dataset, max(a.epoch) AS cap, round(max(a.ap) + 3.3e-10::DOUBLE,6) AS newer, round(max(b.ap) + 3.3e-10::DOUBLE,6) AS older, round(max(a.ap)-max(b.ap) + 3.3e-10::DOUBLE,6) AS delta FROM run_log a JOIN run_log b ON a.dataset=b.dataset AND a.epoch=b.epoch WHERE a.run='{NEW}' AND b.run='{OLD}' GROUP BY 1"),
    "r6_best_validation": (validation, f"WITH {V.RUN_LOG} SELECT run, dataset, min_by(epoch, (ap, epoch)) AS epoch, round(min(ap) + 3.3e-10::DOUBLE,6) AS val_loss FROM run_log GROUP BY ALL"),
    "r7_best_by_kind": (lambda s, d: O.best_by_kind(V.run_log(s, d).withColumn("is_ema", F.col("line_no") % 3 == 0)).withColumn("best_res", R("best_res")), f"""WITH {V.RUN_LOG}, k AS (SELECT *, 'all' AS kind FROM run_log UNION ALL SELECT *, CASE WHEN line_no % 3 = 0 THEN 'ema' ELSE 'regular' END FROM run_log)
      SELECT run, dataset, kind, round(max(ap) + 3.3e-10::DOUBLE, 6) AS best_res, min_by(epoch, (-ap, epoch)) AS best_ep FROM k GROUP BY ALL"""),
    "r7_running_best": (lambda s, d: O.running_best(log(s, d)).withColumns({"ap": R("ap"), "best": R("best")}), f"WITH {V.RUN_LOG} SELECT run, dataset, epoch, round(ap + 3.3e-10::DOUBLE,6) AS ap, round(max(ap) OVER ({KEYS}) + 3.3e-10::DOUBLE,6) AS best, coalesce(ap > max(ap) OVER ({KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM run_log"),
    "r8_smoothed": (lambda s, d: O.smoothed(log(s, d)).withColumns({c: R(c) for c in ("ap", "median", "mean", "most", "overall")}), f"""WITH {V.RUN_LOG}, w AS (SELECT *, list_sort(list(ap) OVER ({KEYS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS l, avg(ap) OVER ({KEYS} ROWS UNBOUNDED PRECEDING) AS o FROM run_log)
      SELECT run, dataset, epoch, round(ap + 3.3e-10::DOUBLE,6) AS ap, round(l[(len(l)-1)//2+1] + 3.3e-10::DOUBLE,6) AS median, round(list_avg(l) + 3.3e-10::DOUBLE,6) AS mean, round(list_max(l) + 3.3e-10::DOUBLE,6) AS most, round(o + 3.3e-10::DOUBLE,6) AS overall FROM w"""),
    "r8_weighted_mean": (weighted, "SELECT o_orderpriority AS run, round(sum(o_totalprice/500000.0::DOUBLE*(o_custkey%7+1))/sum(o_custkey%7+1) + 3.3e-10::DOUBLE,6) AS mean FROM orders GROUP BY 1"),
    "r9_interpolated": (smooth, f"""WITH {V.RUN_LOG}, g AS (SELECT run, dataset, epoch, CASE WHEN epoch % 4 > 0 THEN ap END AS ap, row_number() OVER ({KEYS}) AS n FROM run_log),
      k AS (SELECT *, CASE WHEN ap IS NOT NULL THEN n END AS m FROM g),
      b AS (SELECT *, last_value(ap IGNORE NULLS) OVER ({KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a0, last_value(m IGNORE NULLS) OVER ({KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n0,
        first_value(ap IGNORE NULLS) OVER ({KEYS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a1, first_value(m IGNORE NULLS) OVER ({KEYS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n1 FROM k),
      f AS (SELECT run, dataset, epoch, n, CASE WHEN a1 IS NULL OR n0 = n1 THEN a0 ELSE a0 + (a1 - a0) * (n - n0) / (n1 - n0)::DOUBLE END AS filled FROM b)
      SELECT x.run, x.dataset, x.epoch, round(any_value(x.filled) + 3.3e-10::DOUBLE,6) AS filled, round(sum(y.filled*pow(5/6::DOUBLE,x.n-y.n))/sum(pow(5/6::DOUBLE,x.n-y.n)) + 3.3e-10::DOUBLE,6) AS smooth
      FROM f x LEFT JOIN f y ON x.run=y.run AND x.dataset=y.dataset AND y.n<=x.n AND y.filled IS NOT NULL GROUP BY ALL"""),
    "r10_pr_summary": (pr, """WITH m AS (SELECT o_orderpriority AS run, avg(o_orderkey%100/100) AS p, avg(o_custkey%100/100) AS r, avg(o_totalprice/500000.0::DOUBLE) AS s FROM orders GROUP BY 1) SELECT run, round(p + 3.3e-10::DOUBLE,6) AS precision, round(r + 3.3e-10::DOUBLE,6) AS recall, round(s + 3.3e-10::DOUBLE,6) AS score, round(2*p*r/(p+r+1e-8::DOUBLE) + 3.3e-10::DOUBLE,6) AS f1 FROM m"""),
    "r11_timings": (timing, """WITH o AS (SELECT o_orderpriority AS run, o_totalprice/1e6::DOUBLE+0.01::DOUBLE AS t FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) > 50)
      SELECT run, round(avg(t) + 3.3e-10::DOUBLE,6) AS mean, round(stddev_pop(t) + 3.3e-10::DOUBLE,6) AS std, round(min(t) + 3.3e-10::DOUBLE,6) AS least, round(max(t) + 3.3e-10::DOUBLE,6) AS most, round(1/avg(t) + 3.3e-10::DOUBLE,6) AS fps FROM o GROUP BY 1"""),
}
