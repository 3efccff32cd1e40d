"""Registered queries: numeric transforms (X1-X6)."""

from __future__ import annotations

from washframe.operators import transforms as X
from washframe.plans.registry import register, rounded, sql_rounded
from washframe.sources.tables import load_table

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _minmax_sql(table: str, cols: list[str], keep: list[str], a: float = 0.0, b: float = 1.0) -> str:
    stats = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols)
    exprs = []
    for c in cols:
        unit = f"(CAST({c} AS DOUBLE) - mn_{c}) / coalesce(nullif(mx_{c} - mn_{c}, 0), 1)"
        exprs.append(f"{unit} AS {c}" if (a, b) == (0.0, 1.0)
                     else f"{unit} * {b - a!r} + {a!r} AS {c}")
    sql = (f"WITH s AS (SELECT {stats} FROM {table})\n"
           f"SELECT {', '.join(keep)}, {', '.join(exprs)} FROM {table}, s")
    return sql_rounded(sql, cols)


@register("normalize", _minmax_sql("lineitem", LINE_NUM, ["l_orderkey", "l_linenumber"]))
def q_normalize(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUM)
    return rounded(X.normalize(li, LINE_NUM))


_STD_SQL = sql_rounded("""WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT c_custkey, c_name, c_nationkey,
       (c_acctbal - m) / coalesce(nullif(sd, 0), 1) AS c_acctbal, c_mktsegment
FROM customer, s""", ["c_acctbal"])


@register("standardize", _STD_SQL)
def q_standardize(spark, sf):
    cu = load_table(spark, sf, "customer")
    return rounded(X.standardize(cu, ["c_acctbal"]))


_LOG_SQL = sql_rounded("""WITH s AS (SELECT min(c_acctbal) AS mb, min(c_custkey) AS mk FROM customer)
SELECT c_custkey AS key,
       CASE WHEN mb <= 0 THEN ln(c_acctbal + abs(mb) + 1) ELSE ln(c_acctbal) END AS c_acctbal,
       CASE WHEN mk <= 0 THEN ln(c_custkey + abs(mk) + 1) ELSE ln(c_custkey) END AS c_custkey
FROM customer, s""", ["c_acctbal", "c_custkey"])


@register("log_transform", _LOG_SQL)
def q_log(spark, sf):
    cu = load_table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_acctbal", "c_custkey")
    return rounded(X.log_transform(cu, ["c_acctbal", "c_custkey"]))


_SQRT_SQL = sql_rounded("""WITH s AS (SELECT min(c_acctbal) AS mb, min(c_nationkey) AS mn FROM customer)
SELECT c_custkey,
       CASE WHEN mb < 0 THEN sqrt(c_acctbal + abs(mb)) ELSE sqrt(c_acctbal) END AS c_acctbal,
       CASE WHEN mn < 0 THEN sqrt(c_nationkey + abs(mn)) ELSE sqrt(c_nationkey) END AS c_nationkey
FROM customer, s""", ["c_acctbal", "c_nationkey"])


@register("sqrt_transform", _SQRT_SQL)
def q_sqrt(spark, sf):
    cu = load_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return rounded(X.sqrt_transform(cu, ["c_acctbal", "c_nationkey"]))


@register("min_max_scale", _minmax_sql("part", ["p_retailprice", "p_size"], ["p_partkey", "p_brand"], -1.0, 1.0))
def q_scale(spark, sf):
    pa = load_table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return rounded(X.min_max_scale(pa, ["p_retailprice", "p_size"], (-1, 1)))


@register("apply_transformation",
          _minmax_sql("orders", ["o_totalprice"], ["o_orderkey", "o_orderstatus"], 0.0, 10.0))
def q_apply_transformation(spark, sf):
    od = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(X.apply_transformation(od, ["o_totalprice"], "scale",
                                          {"feature_range": (0, 10)}))
