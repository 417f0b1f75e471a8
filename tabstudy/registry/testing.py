"""Hypothesis tests: statistics against SQL; p-values are covered by unit tests."""

from pyspark.sql import functions as F

from ..operators import hypothesis as H
from .base import LI, ORD, li, orders, query, r, rounded
from .evaluate import S, scores


def _stat(df, digits=6, effect=6):
    return rounded(df.drop("p"), {"statistic": digits, "effect": effect})


PAIR = "l_quantity IS NOT NULL AND l_discount IS NOT NULL"


def rk(c, part=""):
    return f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part or 'PARTITION BY 1'}, {c}) - 1) / 2.0)"


@query("tst_pearson", f"WITH {LI} SELECT 'pearson' AS test, {r('corr(l_quantity, l_discount)')} AS statistic, count(*) AS n, {r('corr(l_quantity, l_discount) ** 2')} AS effect FROM li WHERE {PAIR}")
def _(t):
    return _stat(H.pearson(li(t), "l_quantity", "l_discount"))


@query("tst_spearman", f"WITH {LI}, k AS (SELECT {rk('l_quantity')} AS a, {rk('l_extendedprice')} AS b FROM li WHERE l_quantity IS NOT NULL) SELECT 'spearman' AS test, {r('corr(a, b)')} AS statistic, count(*) AS n, {r('corr(a, b) ** 2')} AS effect FROM k")
def _(t):
    return _stat(H.spearman(li(t), "l_quantity", "l_extendedprice"))


@query("tst_kendall", f"""WITH {LI}, g AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS w FROM li WHERE {PAIR} GROUP BY ALL), s AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM g a, g b WHERE a.x < b.x),
  m AS (SELECT sum(w) AS n FROM g), tx AS (SELECT sum(t * (t - 1)) AS t FROM (SELECT sum(w) AS t FROM g GROUP BY x)), ty AS (SELECT sum(t * (t - 1)) AS t FROM (SELECT sum(w) AS t FROM g GROUP BY y))
  SELECT 'kendall' AS test, {r('2 * s / sqrt((n * (n - 1) - tx.t) * (n * (n - 1) - ty.t))', 8)} AS statistic, n::BIGINT AS n, {r('2 * s / sqrt((n * (n - 1) - tx.t) * (n * (n - 1) - ty.t))', 8)} AS effect FROM s, m, tx, ty""")
def _(t):
    return _stat(H.kendall(li(t), "l_quantity", "l_discount"), 8, 8)


@query("tst_t", f"""WITH {LI}, a AS (SELECT count(l_quantity) FILTER (l_linestatus = 'F') AS n0, count(l_quantity) FILTER (l_linestatus = 'O') AS n1, avg(l_quantity) FILTER (l_linestatus = 'F') AS m0, avg(l_quantity) FILTER (l_linestatus = 'O') AS m1,
  var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v0, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v1 FROM li), p AS (SELECT *, ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) AS s FROM a)
  SELECT 't' AS test, {r('(m0 - m1) / sqrt(s * (1.0 / n0 + 1.0 / n1))')} AS statistic, n0 + n1 AS n, {r('(m0 - m1) / sqrt(s)', 8)} AS effect FROM p""")
def _(t):
    return _stat(H.t_test(li(t), "l_quantity", "l_linestatus", ["F", "O"]), 6, 8)


@query("tst_mannwhitney", f"""WITH {LI}, k AS (SELECT l_linestatus AS g, {rk('l_quantity')} AS x FROM li WHERE l_quantity IS NOT NULL), a AS (SELECT count(*) FILTER (g = 'F') AS n0, count(*) FILTER (g = 'O') AS n1, sum(x) FILTER (g = 'F') AS r0 FROM k)
  SELECT 'mannwhitney' AS test, {r('r0 - n0 * (n0 + 1) / 2.0', 2)} AS statistic, n0 + n1 AS n, {r('(r0 - n0 * (n0 + 1) / 2.0) / (n0 * n1)', 8)} AS effect FROM a""")
def _(t):
    return _stat(H.mann_whitney(li(t), "l_quantity", "l_linestatus", ["F", "O"]), 2, 8)


@query("tst_anova", f"""WITH {ORD}, g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM ord WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority), a AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
  s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * v) AS w, sum(n * (m - gm) ** 2) AS b FROM g, a) SELECT 'anova' AS test, {r('b / (k - 1) / (w / (n - k))')} AS statistic, n, {r('b / (b + w)', 8)} AS effect FROM s""")
def _(t):
    return _stat(H.anova(orders(t), "o_totalprice", "o_orderpriority"), 6, 8)


@query("tst_kruskal", f"""WITH {LI}, z AS (SELECT l_returnflag AS g, l_quantity AS v FROM li WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL), k AS (SELECT g, {rk('v')} AS x FROM z), s AS (SELECT sum(q) AS q, sum(n) AS n FROM (SELECT sum(x) ** 2 / count(*) AS q, count(*) AS n FROM k GROUP BY g)),
  ti AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM z GROUP BY v)) SELECT 'kruskal' AS test, {r('(12 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n))', 5)} AS statistic, n::BIGINT AS n, {r('(12 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) / (n - 1)', 8)} AS effect FROM s, ti""")
def _(t):
    return _stat(H.kruskal(li(t), "l_quantity", "l_returnflag"), 5, 8)


def chi_sql(a, b, cte, where):
    return f"""WITH {cte}, c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {where} GROUP BY ALL), ra AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS rb FROM c GROUP BY 1), g AS (SELECT coalesce(n, 0) AS n, ra * rb / (SELECT sum(n) FROM c)::DOUBLE AS e FROM ra CROSS JOIN rb LEFT JOIN c USING (a, b)),
  k AS (SELECT (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb), h AS (SELECT sum((abs(n - e) - CASE WHEN ka = 2 AND kb = 2 THEN least(0.5, abs(n - e)) ELSE 0 END) ** 2 / e) AS x, sum(n)::BIGINT AS n, any_value(least(ka, kb)) AS m FROM g, k)
  SELECT 'chi2' AS test, {r('x')} AS statistic, n, {r('sqrt(x / (n * (m - 1)))', 8)} AS effect FROM h"""


@query("tst_chi2", chi_sql("l_returnflag", "l_linestatus", LI, "li WHERE l_returnflag IS NOT NULL"))
def _(t):
    return _stat(H.chi_square(li(t), "l_returnflag", "l_linestatus"), 6, 8)


@query("tst_chi2_yates", chi_sql("l_linestatus", "(l_quantity IS NULL)", LI, "li"))
def _(t):
    return _stat(H.chi_square(li(t).withColumn("hole", F.col("l_quantity").isNull()), "l_linestatus", "hole"), 6, 8)


@query("tst_fisher", f"SELECT 'fisher' AS test, {r('(count(*) FILTER (quality = 0 AND toxic = 0) * count(*) FILTER (quality = 1 AND toxic = 1)) / (count(*) FILTER (quality = 0 AND toxic = 1) * count(*) FILTER (quality = 1 AND toxic = 0))::DOUBLE')} AS statistic, count(*) AS n, "
       f"{r('(count(*) FILTER (quality = 0 AND toxic = 0) * count(*) FILTER (quality = 1 AND toxic = 1)) / (count(*) FILTER (quality = 0 AND toxic = 1) * count(*) FILTER (quality = 1 AND toxic = 0))::DOUBLE')} AS effect FROM labels")
def _(t):
    return _stat(H.fisher(t.labels, "quality", "toxic", [0, 1], [0, 1]))


K2 = """a AS (SELECT count(v)::DOUBLE AS n, skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1.0)) AS g1, kurtosis_pop(v) AS g2 FROM z),
  b AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS be FROM a), c AS (SELECT *, sqrt(2 * (be - 1)) - 1 AS w2, (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM b), d AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM c),
  e AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS den FROM d), f AS (SELECT *, (1 - 2 / (9 * a) - sign(den) * cbrt((1 - 2 / a) / abs(den))) / sqrt(2 / (9 * a)) AS zk FROM e)"""


@query("tst_normality", f"WITH z AS (SELECT o_totalprice AS v FROM orders), {K2} SELECT 'all' AS \"group\", n::BIGINT AS n, {r('zs * zs + zk * zk', 3)} AS k2, {r('exp(-(zs * zs + zk * zk) / 2)')} AS k2_p, {r('n / 6 * (g1 * g1 + g2 * g2 / 4)', 3)} AS jarque_bera, {r('exp(-n / 12 * (g1 * g1 + g2 * g2 / 4))')} AS jarque_bera_p, exp(-(zs * zs + zk * zk) / 2) > 0.05 AS normal FROM f")
def _(t):
    return rounded(H.normality(t.orders, "o_totalprice"), {"k2": 3, "k2_p": 6, "jarque_bera": 3, "jarque_bera_p": 6})


@query("tst_friedman", f"""WITH e AS (SELECT user_id % 20 AS block, event_type AS tr, avg(value) AS v FROM events GROUP BY 1, 2), k AS (SELECT *, {rk('v', 'PARTITION BY block')} AS x, count(*) OVER (PARTITION BY block, v) AS t FROM e),
  p AS (SELECT tr, sum(x) AS x, count(*) AS n, sum(t * t - 1) AS t FROM k GROUP BY 1), a AS (SELECT count(*)::DOUBLE AS k, max(n)::DOUBLE AS n, sum(x * x) AS s, sum(t)::DOUBLE AS t FROM p), q AS (SELECT *, (12 / (n * k * (k + 1)) * s - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) AS q FROM a)
  SELECT 'friedman' AS test, {r('q')} AS statistic, n::BIGINT AS n, {r('q / (n * (k - 1))')} AS effect FROM q""")
def _(t):
    means = t.events.groupBy((F.col("user_id") % 20).alias("block"), F.col("event_type").alias("tr")).agg(F.avg("value").alias("v"))
    return _stat(H.friedman(means, "block", "tr", "v"))


@query("tst_paired_t", f"WITH {S} SELECT 'paired_t' AS test, {r('avg(pred - other) * sqrt(count(*)) / stddev_samp(pred - other)', 5)} AS statistic, count(*) AS n, {r('avg(pred - other) / stddev_samp(pred - other)')} AS effect FROM s")
def _(t):
    return _stat(H.paired_t(scores(t), "pred", "other"), 5)


@query("tst_wilcoxon", f"""WITH {S}, d AS (SELECT round(pred - other) AS d FROM s WHERE round(pred - other) <> 0), k AS (SELECT d, {rk('abs(d)')} AS x FROM d), a AS (SELECT sum(x) FILTER (d > 0) AS p, sum(x) FILTER (d < 0) AS m, count(*) AS n FROM k)
  SELECT 'wilcoxon' AS test, {r('least(p, m)', 2)} AS statistic, n, {r('(p - m) / (p + m)')} AS effect FROM a""")
def _(t):
    df = scores(t).select(F.round(F.col("pred") - F.col("other")).alias("d"), F.lit(0.0).alias("z"))
    return _stat(H.wilcoxon(df, "d", "z"), 2)


# A p-value per priority and status from exact counts, so both engines see the same numbers.
PV = "pv AS (SELECT o_orderpriority || o_orderstatus AS feature, count(*) / 100000.0::DOUBLE AS p FROM orders GROUP BY 1)"


def p_table(t):
    return t.orders.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("feature")).agg((F.count(F.lit(1)) / 100000.0).alias("p"))


@query("tst_bh", f"""WITH {PV}, k AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM pv), a AS (SELECT feature, p, least(1.0, min(p * m / i) OVER (ORDER BY i DESC)) AS q FROM k)
  SELECT feature, {r('p')} AS p, {r('q', 8)} AS p_adjusted, q <= 0.0105 AS rejected FROM a""")
def _(t):
    return rounded(H.adjust_bh(p_table(t), alpha=0.0105), {"p": 6, "p_adjusted": 8})


@query("tst_bonferroni", f"WITH {PV} SELECT feature, {r('p')} AS p, {r('least(1.0, p * count(*) OVER ())', 8)} AS p_adjusted, least(1.0, p * count(*) OVER ()) <= 0.15 AS rejected FROM pv")
def _(t):
    return rounded(H.adjust_bonferroni(p_table(t), alpha=0.15), {"p": 6, "p_adjusted": 8})


@query("tst_auto", f"""WITH {LI}, k AS (SELECT l_linestatus AS g, {rk('l_quantity')} AS x FROM li WHERE l_quantity IS NOT NULL), a AS (SELECT count(*) FILTER (g = 'F') AS n0, count(*) AS n, sum(x) FILTER (g = 'F') AS r0 FROM k)
  SELECT 'mannwhitney' AS test, {r('r0 - n0 * (n0 + 1) / 2.0', 2)} AS statistic, n FROM a UNION ALL SELECT test, round(statistic, 2) + 0.0, n FROM ({chi_sql('l_returnflag', 'l_linestatus', LI, 'li WHERE l_returnflag IS NOT NULL')})""")
def _(t):
    both = H.compare_groups(li(t), "l_quantity", "l_linestatus").unionByName(H.compare_classes(li(t), "l_returnflag", "l_linestatus"))
    return rounded(both.drop("p", "effect"), {"statistic": 2})
