"""The registered queries of the engine's own operators, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import col, cond, if_, is_in, over, sql
from ..operators import fts
from ..operators.graph import Graph
from . import macros
from .session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function of (spark, t), ``t(name)`` being a table as a frame, and its oracle."""

    def register(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, lambda table: Frame.from_parquet(spark, f"{sf_dir}/{table}.parquet"))
            return out.df if isinstance(out, Frame) else out

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if text:
            SQL[name] = text
        return f

    return register



@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def flagship(spark, t):
    """filter, mutate, group, summarise, sort."""
    return (
        t("lineitem").filter_with("l_shipdate <= TIMESTAMP '1998-09-02'").mutate(net="l_extendedprice * (1 - l_discount)").group_by("l_returnflag", "l_linestatus")
        .summarise(sum_qty="round(sum(l_quantity), 2)", revenue="round(sum(net), 2)", n="count(*)").sort_by("l_returnflag", "l_linestatus")
    )


@query("SELECT * FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05")
def filter_chain(spark, t):
    return t("lineitem").filter(col("l_quantity") > 30).filter(col("l_discount") < 0.05)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(spark, t):
    return t("orders").filter(is_in(col("o_orderstatus"), ["F", "P"])).select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def filter_pins(spark, t):
    return t("customer").filter_with("c_acctbal > :least AND c_mktsegment = $$".replace("$$", ":seg"), least=5000, seg="BUILDING").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, CASE WHEN p_retailprice > 1000 THEN 1 END AS dear FROM part")
def case_when(spark, t):
    return t("part").mutate(band=cond((col("p_size") < 10, "small"), (col("p_size") < 30, "medium"), (True, "large")), dear=if_(col("p_retailprice") > 1000, 1)).select("p_partkey", "band", "dear")


@query("SELECT o_totalprice, o_orderkey FROM orders")
def select_reorder(spark, t):
    return t("orders").select("o_totalprice", "o_orderkey")


@query("SELECT * EXCLUDE (p_name, p_type) FROM part")
def discard(spark, t):
    return t("part").discard("p_name", "p_type")


@query("SELECT event_id, user_id, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL")
def drop_nil(spark, t):
    return t("events").drop_nil("user_id", "value").select("event_id", "user_id", "value")


@query("SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def mutate_lateral(spark, t):
    return t("lineitem").mutate(net="l_extendedprice * (1 - l_discount)", gross="net * (1 + l_tax)")


@query("SELECT * REPLACE (upper(r_name) AS r_name) FROM region")
def mutate_replace(spark, t):
    return t("region").mutate(r_name=F.upper("r_name"))


@query("SELECT n_nationkey AS id, n_name AS nation, n_regionkey FROM nation")
def rename(spark, t):
    return t("nation").rename(n_nationkey="id", n_name="nation")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def sort_head_topk(spark, t):
    return t("orders").sort_by(("desc", "o_totalprice"), "o_orderkey").head(25).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, value FROM events ORDER BY value ASC NULLS LAST, event_id LIMIT 40 OFFSET 15")
def slice_rows(spark, t):
    return t("events").sort_by("value", "event_id").slice(15, 40).select("event_id", "value")


@query("SELECT o_orderkey FROM orders LIMIT 0")
def head_zero(spark, t):
    return t("orders").select("o_orderkey").head(0)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM (SELECT DISTINCT ON (o_custkey) * FROM orders)")
def distinct_on(spark, t):
    return t("orders").distinct("o_custkey").summarise(n="count(*)", customers="count_distinct(o_custkey)")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def group_basic(spark, t):
    return t("events").group_by("event_type").summarise(n="count(*)", total="round(sum(value), 4)", mean="round(mean(value), 6)", lo="min(value)", hi="max(value)")


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v, round(stddev_pop(l_tax), 8) AS sdp, round(var_pop(l_tax), 8) AS vp FROM lineitem GROUP BY 1")
def group_spread(spark, t):
    return t("lineitem").group_by("l_returnflag").summarise(sd="round(std(l_quantity), 6)", v="round(variance(l_quantity), 6)", sdp="round(stddev_pop(l_tax), 8)", vp="round(var_pop(l_tax), 8)")


@query("SELECT p_brand, round(median(p_retailprice), 6) AS med, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part GROUP BY 1")
def group_quantiles(spark, t):
    return t("part").group_by("p_brand").summarise(med="round(median(p_retailprice), 6)", p95="round(quantile_cont(p_retailprice, 0.95), 6)")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def group_count_distinct(spark, t):
    return t("orders").group_by("o_orderpriority").summarise(customers="count_distinct(o_custkey)")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, arg_max(n_name, n_nationkey) AS last, arg_min(n_name, n_nationkey) AS first FROM nation GROUP BY 1")
def group_text(spark, t):
    return t("nation").group_by("n_regionkey").summarise(names="listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)", last="arg_max(n_name, n_nationkey)", first="arg_min(n_name, n_nationkey)")


@query("SELECT o_orderstatus, bool_and(o_totalprice > 0) AS ok, bool_or(o_totalprice > 400000) AS big, round(corr(o_totalprice, o_custkey), 6) AS r, round(covar_samp(o_totalprice, o_custkey), 2) AS cov FROM orders GROUP BY 1")
def group_bool_corr(spark, t):
    return t("orders").group_by("o_orderstatus").summarise(ok="bool_and(o_totalprice > 0)", big="bool_or(o_totalprice > 400000)", r="round(corr(o_totalprice, o_custkey), 6)", cov="round(covar_samp(o_totalprice, o_custkey), 2)")


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0")
def global_agg_empty(spark, t):
    return t("orders").filter_with("o_totalprice < 0").summarise(n="count(*)", total="sum(o_totalprice)")


@query("SELECT round(avg(l_quantity) + 1, 6) AS shifted, round(sum(l_extendedprice) / count(*), 4) AS ratio FROM lineitem")
def global_agg_compound(spark, t):
    return t("lineitem").summarise(shifted="round(avg(l_quantity) + 1, 6)", ratio="round(sum(l_extendedprice) / count(*), 4)")


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def cube(spark, t):
    return t("customer").join(t("nation"), [("c_nationkey", "n_nationkey")]).cube("n_regionkey", "c_mktsegment", n="count(*)")


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority", total="round(sum(o_totalprice), 2)")


def _join_sql(kind: str, cols: str = "c_custkey, c_name, o_orderkey") -> str:
    return f"SELECT {cols} FROM customer {kind} JOIN orders ON c_custkey = o_custkey"


@query(_join_sql("INNER"))
def join_inner(spark, t):
    return t("customer").join(t("orders"), [("c_custkey", "o_custkey")]).select("c_custkey", "c_name", "o_orderkey")


@query(_join_sql("LEFT"))
def join_left(spark, t):
    return t("customer").join(t("orders"), [("c_custkey", "o_custkey")], how="left").select("c_custkey", "c_name", "o_orderkey")


@query(_join_sql("RIGHT"))
def join_right(spark, t):
    return t("customer").join(t("orders"), [("c_custkey", "o_custkey")], how="right").select("c_custkey", "c_name", "o_orderkey")


@query(_join_sql("SEMI", "c_custkey, c_name"))
def join_semi(spark, t):
    return t("customer").join(t("orders"), [("c_custkey", "o_custkey")], how="semi").select("c_custkey", "c_name")


@query(_join_sql("ANTI", "c_custkey, c_name"))
def join_anti(spark, t):
    return t("customer").join(t("orders"), [("c_custkey", "o_custkey")], how="anti").select("c_custkey", "c_name")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, t):
    return t("region").select("r_name").join(t("nation").select("n_name"), how="cross")


@query("SELECT a.n_regionkey AS k, a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b USING (n_regionkey)")
def join_self_suffix(spark, t):
    n = t("nation").select("n_regionkey", "n_name")
    return n.join(n, "n_regionkey").rename(n_regionkey="k")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, r.mx FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, max(l_tax) AS mx FROM lineitem GROUP BY 1, 2) r USING (l_orderkey, l_linenumber)")
def join_multi_key(spark, t):
    r = t("lineitem").group_by("l_orderkey", "l_linenumber").summarise(mx="max(l_tax)")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(r, ["l_orderkey", "l_linenumber"])


@query("""SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def join_star(spark, t):
    small = t("nation").join(t("region"), [("n_regionkey", "r_regionkey")])
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")])
    return lines.join(t("customer"), [("o_custkey", "c_custkey")]).join(small, [("c_nationkey", "n_nationkey")]).group_by("r_name", "c_mktsegment").summarise(revenue="round(sum(l_extendedprice * (1 - l_discount)), 2)", n="count(*)")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, t):
    """The right side is broadcast behind a check of its estimated size."""
    return t("supplier").broadcast_join(t("nation"), [("s_nationkey", "n_nationkey")]).select("s_suppkey", "n_name")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_shuffle_hash(spark, t):
    return t("lineitem").join(t("orders"), [("l_orderkey", "o_orderkey")], hint="shuffle_hash").group_by("o_orderstatus").summarise(n="count(*)", qty="round(sum(l_quantity), 2)")


def _asof_sql(op: str, pick: str, kind: str = "") -> str:
    rows = f"SELECT l.event_id, max(r.v) AS found FROM (SELECT * FROM events WHERE event_type = 'click') l JOIN (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND r.ts = (SELECT {pick}(x.ts) FROM events x WHERE x.event_type = 'view' AND x.user_id = l.user_id AND l.ts {op} x.ts) GROUP BY 1"
    if kind == "left":
        return f"SELECT e.event_id, f.found FROM (SELECT event_id FROM events WHERE event_type = 'click') e LEFT JOIN ({rows}) f USING (event_id)"
    return rows


def _asof(t, op: str, how: str = "inner") -> Frame:
    e = t("events").select("event_id", "user_id", "ts", "event_type", "value")
    right = e.filter_with("event_type = 'view'").group_by("user_id", "ts").summarise(found="max(value)")
    return e.filter_with("event_type = 'click'").asof_join(right, by=("ts", op), on="user_id", how=how).select("event_id", "found")


@query(_asof_sql(">=", "max"))
def asof_ge(spark, t):
    return _asof(t, ">=")


@query(_asof_sql(">", "max"))
def asof_gt(spark, t):
    return _asof(t, ">")


@query(_asof_sql("<=", "min"))
def asof_le(spark, t):
    return _asof(t, "<=")


@query(_asof_sql("<", "min"))
def asof_lt(spark, t):
    return _asof(t, "<")


@query(_asof_sql(">=", "max", "left"))
def asof_left(spark, t):
    return _asof(t, ">=", "left")


@query("SELECT l.event_id, r.found FROM (SELECT event_id, ts FROM events WHERE event_type = 'click') l ASOF JOIN (SELECT ts, max(value) AS found FROM events WHERE event_type = 'purchase' GROUP BY ts) r ON l.ts >= r.ts")
def asof_no_keys(spark, t):
    """Without equality keys: dealt in ranges of the time, not in one task."""
    e = t("events").select("event_id", "ts", "event_type", "value")
    right = e.filter_with("event_type = 'purchase'").group_by("ts").summarise(found="max(value)")
    return e.filter_with("event_type = 'click'").asof_join(right, by=("ts", ">=")).select("event_id", "found")


W = "PARTITION BY user_id ORDER BY ts NULLS LAST, event_id"
BY_USER = {"partition_by": "user_id", "order_by": ["ts", "event_id"]}


@query(f"SELECT event_id, row_number() OVER ({W}) AS rn, rank() OVER (PARTITION BY event_type ORDER BY user_id NULLS LAST) AS rk, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id NULLS LAST) AS dr, ntile(4) OVER ({W}) AS q FROM events")
def win_ranks(spark, t):
    by_type = {"partition_by": "event_type", "order_by": "user_id"}
    return t("events").mutate(rn=over("row_number()", **BY_USER), rk=over("rank()", **by_type), dr=over("dense_rank()", **by_type), q=over("ntile(4)", **BY_USER)).select("event_id", "rn", "rk", "dr", "q")


@query(f"SELECT event_id, round(percent_rank() OVER ({W}), 8) AS pr, round(cume_dist() OVER ({W}), 8) AS cd, nth_value(event_id, 2) OVER ({W}) AS second FROM events")
def win_relative(spark, t):
    return t("events").mutate(pr=over("percent_rank()", **BY_USER), cd=over("cume_dist()", **BY_USER), second=over("nth_value(event_id, 2)", **BY_USER)).mutate(pr="round(pr, 8)", cd="round(cd, 8)").select("event_id", "pr", "cd", "second")


@query(f"SELECT event_id, lag(event_id, 1) OVER ({W}) AS prev, lead(event_id, 2) OVER ({W}) AS next2 FROM events")
def win_lag_lead(spark, t):
    return t("events").mutate(prev=over("lag(event_id, 1)", **BY_USER), next2=over("lead(event_id, 2)", **BY_USER)).select("event_id", "prev", "next2")


@query(f"SELECT event_id, first_value(event_id) OVER ({W}) AS first, last_value(event_id) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events")
def win_first_last(spark, t):
    return t("events").mutate(first=over("first_value(event_id)", **BY_USER), last=over("last_value(event_id)", **BY_USER, frame=("rows", "unbounded", "unbounded"))).select("event_id", "first", "last")


@query(f"SELECT event_id, round(sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) AS running, round(avg(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS moving FROM events")
def win_rows_frames(spark, t):
    return t("events").mutate(running=over("sum(value)", **BY_USER, frame=("rows", "unbounded", "current")), moving=over("avg(value)", **BY_USER, frame=("rows", -2, 1))).mutate(running="round(running, 4)", moving="round(moving, 6)").select("event_id", "running", "moving")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS mean FROM part")
def win_range_frame(spark, t):
    return t("part").mutate(near=over("count(*)", "p_brand", "p_size", ("range", -3, 3)), mean=over("avg(p_retailprice)", "p_brand")).mutate(mean="round(mean, 6)").select("p_partkey", "near", "mean")


@query("SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM part")
def win_groups_frame(spark, t):
    return t("part").mutate(s=over("sum(p_partkey)", "p_brand", "p_size", ("groups", -1, 1))).select("p_partkey", "s")


@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS s, round(avg(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 8) AS a, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM part")
def win_exclude_current(spark, t):
    f = {"partition_by": "p_brand", "order_by": "p_partkey", "frame": ("rows", -2, 2), "exclude": "current"}
    return t("part").mutate(s=over(col("p_size").cast("long"), **f, kind="sum"), a=over("p_size", **f, kind="avg"), m=over("p_size", **f, kind="max")).mutate(a="round(a, 8)").select("p_partkey", "s", "a", "m")


@query("SELECT p_partkey, count(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS n, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS lo FROM part")
def win_exclude_group(spark, t):
    f = {"partition_by": "p_brand", "order_by": "p_size", "frame": ("groups", -1, "current"), "exclude": "group"}
    return t("part").mutate(n=over("p_partkey", **f, kind="count"), lo=over("p_retailprice", **f, kind="min")).select("p_partkey", "n", "lo")


@query("SELECT p_partkey, count(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE UNBOUNDED PRECEDING EXCLUDE TIES) AS n FROM part")
def win_exclude_ties(spark, t):
    return t("part").mutate(n=over("p_partkey", "p_brand", "p_size", ("range", "unbounded", "current"), exclude="ties", kind="count")).select("p_partkey", "n")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_n_per_group(spark, t):
    return t("orders").mutate(rn=over("row_number()", "o_custkey", [("desc", "o_totalprice"), "o_orderkey"])).filter_with("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("""SELECT c_mktsegment, round(sum(CASE WHEN o_orderstatus = 'F' THEN v END), 2) AS F, round(sum(CASE WHEN o_orderstatus = 'O' THEN v END), 2) AS O, round(sum(CASE WHEN o_orderstatus = 'P' THEN v END), 2) AS P
FROM (SELECT c_mktsegment, o_orderstatus, round(o_totalprice, 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def pivot_wider(spark, t):
    rows = t("orders").join(t("customer"), [("o_custkey", "c_custkey")]).mutate(v="round(o_totalprice, 2)").select("c_mktsegment", "o_orderstatus", "v")
    wide = rows.pivot_wider("o_orderstatus", "v")
    return wide.mutate(**{c: F.round(col(c), 2) for c in wide.columns if c != "c_mktsegment"})


@query(f"""SELECT event_type, {', '.join(f'count(CASE WHEN d = {d} THEN event_id END) AS "{d}"' for d in range(7))} FROM (SELECT event_type, dayofweek(ts) AS d, event_id FROM events) GROUP BY 1""")
def pivot_wider_count(spark, t):
    return t("events").mutate(d="date_part('dow', ts)").select("event_type", "d", "event_id").pivot_wider("d", "event_id", "count")


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount > 0.03 THEN l_discount END AS l_discount FROM lineitem) ON l_quantity, l_discount INTO NAME measure VALUE amount")
def pivot_longer(spark, t):
    return t("lineitem").mutate(l_discount="CASE WHEN l_discount > 0.03 THEN l_discount END").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").pivot_longer(["l_quantity", "l_discount"], "measure", "amount")


@query("SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation")
def concat_rows(spark, t):
    return t("customer").select("c_custkey", "c_name").rename(c_custkey="k", c_name="n").concat_rows(t("supplier").select("s_suppkey", "s_name"), t("nation").select("n_nationkey", "n_name"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, t):
    return t("customer").select("c_nationkey").rename(c_nationkey="k").union_distinct(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_rows(spark, t):
    return t("customer").select("c_nationkey").rename(c_nationkey="k").intersect(t("supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10")
def except_rows(spark, t):
    return t("part").select("p_partkey").rename(p_partkey="k").except_(t("lineitem").filter_with("l_quantity > 10").select("l_partkey"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_extract(spark, t):
    return t("events").json_extract("props", {"k": "k", "missing": "none"}).select("event_id", "k", "missing")


@query("SELECT event_id, j.value::VARCHAR AS item FROM (SELECT event_id, json_array(event_type, user_id, json_object('u', user_id), NULL) AS doc FROM events) e, json_each(e.doc) j")
def json_unnest(spark, t):
    doc = sql("CASE WHEN user_id IS NULL THEN '[\"' || event_type || '\",null,{\"u\":null},null]' ELSE '[\"' || event_type || '\",' || user_id || ',{\"u\":' || user_id || '},null]' END")
    return t("events").mutate(doc=doc).select("event_id", "doc").json_unnest("doc", as_="item").select("event_id", "item")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_expand(spark, t):
    return t("events").select("event_id", "props").json_expand("props").discard("props")


@query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, length(p_name)::BIGINT AS n, trim('  ' || p_type || ' ') AS tr, replace(p_type, ' ', '_') AS rp, starts_with(p_name, 'a') AS sw,
 string_split(p_type, ' ')[1] AS first_word, p_name LIKE '%a%' AS lk, concat(p_brand, NULL, p_type) AS cc, p_brand || '-' || p_size AS j FROM part""")
def str_fns(spark, t):
    return t("part").mutate(lo="lower(p_name)", up="upper(p_brand)", n="CAST(length(p_name) AS BIGINT)", tr="trim('  ' || p_type || ' ')", rp="replace(p_type, ' ', '_')", sw="starts_with(p_name, 'a')", first_word="list_extract(string_split(p_type, ' '), 1)", lk="p_name LIKE '%a%'", cc="concat(p_brand, NULL, p_type)", j="p_brand || '-' || p_size").select("p_partkey", "lo", "up", "n", "tr", "rp", "sw", "first_word", "lk", "cc", "j")


@query(r"SELECT doc_id, regexp_matches(text, '\d{3}') AS has, regexp_extract(text, '([a-z]+)ing', 1) AS ex, regexp_replace(text, '[aeiou]', '#') AS one, regexp_replace(text, '[aeiou]', '#', 'g') AS every FROM documents")
def regex_fns(spark, t):
    return t("documents").mutate(has=r"regexp_matches(text, '\d{3}')", ex="regexp_extract(text, '([a-z]+)ing', 1)", one="regexp_replace(text, '[aeiou]', '#')", every="regexp_replace(text, '[aeiou]', '#', 'g')").select("doc_id", "has", "ex", "one", "every")


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_part('dow', o_orderdate) AS dow, date_trunc('month', o_orderdate)::DATE AS mon, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days,
 date_diff('month', TIMESTAMP '1995-01-15', o_orderdate) AS months, epoch(o_orderdate) AS ep FROM orders""")
def date_fns(spark, t):
    return t("orders").mutate(y="CAST(year(o_orderdate) AS BIGINT)", m="CAST(month(o_orderdate) AS BIGINT)", d="CAST(day(o_orderdate) AS BIGINT)", dow="date_part('dow', o_orderdate)", mon="to_date(date_trunc('month', o_orderdate))", days="date_diff('day', TIMESTAMP_NTZ'1995-01-01', o_orderdate)", months="date_diff('month', TIMESTAMP_NTZ'1995-01-15', o_orderdate)", ep="epoch(o_orderdate)").select("o_orderkey", "y", "m", "d", "dow", "mon", "days", "months", "ep")


@query("""SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, round(l_extendedprice / 7, 2) AS r, ceil(l_tax * 100) AS c, floor(l_discount * 100) AS f, round(sqrt(l_quantity), 8) AS s, round(ln(l_extendedprice), 8) AS n, round(log(l_extendedprice), 8) AS lg,
 l_orderkey // 7 AS i, l_orderkey % 7 AS md, l_quantity / 0 AS inf, (l_linenumber - l_linenumber) / 0 AS nan, l_quantity / l_linenumber / 2 AS q, CAST(l_extendedprice AS BIGINT) AS whole, round(log2(l_quantity), 8) AS l2 FROM lineitem""")
def math_fns(spark, t):
    return t("lineitem").mutate(a="abs(l_quantity - 25)", r="round(l_extendedprice / 7, 2)", c="CAST(ceil(l_tax * 100) AS DOUBLE)", f="CAST(floor(l_discount * 100) AS DOUBLE)", s="round(sqrt(l_quantity), 8)", n="round(ln(l_extendedprice), 8)", lg="round(log(l_extendedprice), 8)", i="l_orderkey // 7", md="l_orderkey % 7", inf="l_quantity / 0", nan="(l_linenumber - l_linenumber) / 0", q="l_quantity / l_linenumber / 2", whole="CAST(l_extendedprice AS BIGINT)", l2="round(log2(l_quantity), 8)").select("l_orderkey", "l_linenumber", "a", "r", "c", "f", "s", "n", "lg", "i", "md", "inf", "nan", "q", "whole", "l2")


@query("SELECT event_id, coalesce(user_id, -1) AS u, nullif(event_type, 'click') AS e, greatest(value, 50.0::DOUBLE) AS g, least(value, 50.0::DOUBLE) AS l, CAST(user_id AS VARCHAR) AS s FROM events")
def null_fns(spark, t):
    return t("events").mutate(u="coalesce(user_id, -1)", e="nullif(event_type, 'click')", g="greatest(value, 50.0D)", l="least(value, 50.0D)", s="cast(user_id, 'VARCHAR')").select("event_id", "u", "e", "g", "l", "s")


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names, len(list(n_name)) AS n, list_contains(list(n_name), 'FRANCE') AS fr FROM nation GROUP BY 1")
def list_fns(spark, t):
    return t("nation").group_by("n_regionkey").summarise(names="list_sort(list(n_name))", n="len(list(n_name))", fr="list_contains(list(n_name), 'FRANCE')")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def macro_scalar(spark, t):
    macros.define("net_price", ["price", "off"], "price * (1 - off)")
    macros.define("charged", ["price", "off", "tax"], "net_price(price, off) * (1 + tax)")
    return t("lineitem").mutate(charge="charged(l_extendedprice, l_discount, l_tax)").select("l_orderkey", "l_linenumber", "charge")


@query("SELECT i, i * i AS square FROM range(1, 101) r(i)")
def macro_table(spark, t):
    macros.define_table("squares", ["n"], "SELECT id AS i, id * id AS square FROM range(1, n + 1)")
    return Frame.from_query(spark, "SELECT * FROM squares(100)")


@query("SELECT i % 10 AS k, count(*) AS n, sum(i)::BIGINT AS s FROM range(100000) r(i) GROUP BY 1")
def from_query(spark, t):
    return Frame.from_query(spark, "SELECT id % 10 AS k, count(*) AS n, sum(id) AS s FROM range(100000) GROUP BY 1")


@query("SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, 'it''s', NULL), (3, NULL, 2.5)) v(id, name, x)")
def from_list(spark, t):
    return Frame.from_list(spark, [{"id": 1, "name": "a", "x": 1.5}, {"id": 2, "name": "it's", "x": None}, {"id": 3, "name": None, "x": 2.5}])


def _round_trip(spark: SparkSession, frame: Frame, kind: str) -> Frame:
    """Write, then read back, in the shared folder."""
    path = f"{shared_dir(spark)}/brightwater/{kind}-{uuid.uuid4().hex}"
    if kind == "parquet":
        frame.to_parquet(path)
        return Frame.from_parquet(spark, path)
    if kind == "hive":
        frame.to_parquet(path, partition_by="o_orderstatus")
        return Frame.from_parquet(spark, path)
    if kind == "csv":
        frame.to_csv(path, single_file=False)
        return Frame.from_csv(spark, path)
    frame.to_ndjson(path, single_file=False)
    return Frame.from_ndjson(spark, path)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def csv_round_trip(spark, t):
    return _round_trip(spark, t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "csv").mutate(o_orderkey="CAST(o_orderkey AS BIGINT)", o_custkey="CAST(o_custkey AS BIGINT)")


@query("SELECT * FROM events")
def parquet_round_trip(spark, t):
    return _round_trip(spark, t("events"), "parquet")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def parquet_partitioned(spark, t):
    """The filter prunes folders."""
    return _round_trip(spark, t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "hive").filter(col("o_orderstatus") == "F")


@query("SELECT event_id, event_type, value FROM events")
def ndjson_round_trip(spark, t):
    return _round_trip(spark, t("events").select("event_id", "event_type", "value"), "ndjson").select("event_id", "event_type", "value")


# graphs: customers, suppliers and parts as vertices; a line links customer to supplier, supplier to part, part to customer
EDGES = "SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, 1000000000 + l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 1000000000 + l_suppkey, 2000000000 + l_partkey FROM lineitem UNION ALL SELECT 2000000000 + l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
def _trade(t) -> Graph:
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")]).df
    supp, part = F.col("l_suppkey") + 1_000_000_000, F.col("l_partkey") + 2_000_000_000
    pairs = F.explode(F.array(F.struct(F.col("o_custkey").alias("src"), supp.alias("dst")), F.struct(supp.alias("src"), part.alias("dst")), F.struct(part.alias("src"), F.col("o_custkey").alias("dst"))))
    return Graph.from_edgelist(lines.select(pairs.alias("e")).select("e.src", "e.dst").distinct())


@query(f"SELECT src AS id, count(*) AS out_degree FROM ({EDGES}) GROUP BY 1")
def graph_out_degree(spark, t):
    return _trade(t).out_degree()


@query(f"SELECT dst AS id, count(*) AS in_degree FROM ({EDGES}) GROUP BY 1")
def graph_in_degree(spark, t):
    return _trade(t).in_degree()


@query(f"WITH e AS ({EDGES}) SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def graph_degree(spark, t):
    return _trade(t).degree()


def _pagerank_sql(n: int) -> str:
    parts = [f"e AS MATERIALIZED ({EDGES})", "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "n AS (SELECT count(*) AS n FROM v)", "o AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY 1)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for i in range(1, n + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / d) AS s FROM e JOIN o USING (src) JOIN r{i - 1} ON id = src GROUP BY 1) g ON v.id = g.dst)")
    return f"WITH {', '.join(parts)} SELECT id, round(rank, 10) AS rank FROM r{n}"


@query(_pagerank_sql(6))
def graph_pagerank(spark, t):
    return _trade(t).pagerank(max_iterations=6, tolerance=0).withColumn("rank", F.round("rank", 10))


@query(f"WITH RECURSIVE e AS MATERIALIZED ({EDGES}), p AS (SELECT (SELECT min(src) FROM e) AS node, 0::BIGINT AS dist UNION SELECT e.dst, p.dist + 1 FROM p JOIN e ON e.src = p.node WHERE p.dist < 8) SELECT node, min(dist) AS dist FROM p GROUP BY 1")
def graph_bfs(spark, t):
    """From the first customer, at most eight steps."""
    g = _trade(t)
    return g.shortest_paths(g.edges.agg(F.min("src")).first()[0], max_depth=8)


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, (src % 5 + 0.5)::DOUBLE AS w FROM ({EDGES})), p AS (SELECT (SELECT min(src) FROM e) AS node, 0.0::DOUBLE AS dist UNION SELECT e.dst, p.dist + e.w FROM p JOIN e ON e.src = p.node WHERE p.dist + e.w <= 8) SELECT node, min(dist) AS dist FROM p GROUP BY 1")
def graph_weighted_paths(spark, t):
    """From the first customer, to a cost of eight."""
    g = _trade(t)
    weighed = Graph.from_edgelist(g.edges.withColumn("w", F.col("src") % 5 + 0.5))
    return weighed.shortest_paths(g.edges.agg(F.min("src")).first()[0], max_depth=8, weight="w")


# customers and their large orders: a component for each such customer
ORDERED_EDGES = "SELECT o_custkey AS src, 4000000000 + o_orderkey AS dst FROM orders WHERE o_totalprice > 250000"


def _components_sql(n: int) -> str:
    parts = [f"e AS MATERIALIZED ({ORDERED_EDGES})", "b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "c0 AS (SELECT DISTINCT src AS id, src AS label FROM b)"]
    for i in range(1, n + 1):
        parts.append(f"c{i} AS MATERIALIZED (SELECT id, min(label) AS label FROM (SELECT b.src AS id, label FROM b JOIN c{i - 1} ON b.dst = c{i - 1}.id UNION ALL SELECT id, label FROM c{i - 1}) GROUP BY id)")
    return f"WITH {', '.join(parts)} SELECT id, label AS component FROM c{n}"


@query(_components_sql(8))
def graph_components(spark, t):
    """Customers and their large orders."""
    e = t("orders").df.where("o_totalprice > 250000").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 4_000_000_000).alias("dst"))
    return Graph.from_edgelist(e).connected_components()


def _communities_sql(n: int) -> str:
    parts = [f"e AS MATERIALIZED ({EDGES})", "b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "c0 AS (SELECT DISTINCT src AS id, src AS label FROM b)"]
    for i in range(1, n + 1):
        parts.append(f"c{i} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS k FROM (SELECT b.src AS id, label FROM b JOIN c{i - 1} ON b.dst = c{i - 1}.id UNION ALL SELECT id, label FROM c{i - 1}) GROUP BY id, label) WHERE k = 1)")
    return f"WITH {', '.join(parts)} SELECT id, label AS community FROM c{n}"


@query(_communities_sql(4))
def graph_communities(spark, t):
    return _trade(t).communities(max_iterations=4)


@query(f"WITH e AS MATERIALIZED ({EDGES}) SELECT count(*) AS triangles FROM e a JOIN e b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN e c ON c.src = b.dst AND c.dst = a.src")
def graph_triangles(spark, t):
    return _trade(t).triangles().agg(F.count("*").alias("triangles"))


def _betweenness_sql(sample: int, levels: int) -> str:
    """Paths of the sampled sources counted forward level by level, dependencies summed backward."""
    parts = [f"e AS MATERIALIZED ({EDGES})", "b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "v AS MATERIALIZED (SELECT DISTINCT src AS id FROM b)", "n AS (SELECT count(*) AS n FROM v)"]
    parts += [f"s AS MATERIALIZED (SELECT id FROM v ORDER BY md5('0|' || id), id LIMIT {sample})", "p0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS sigma FROM s)"]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM p{j}" for j in range(i))
        parts.append(f"p{i} AS MATERIALIZED (SELECT x.s, b.dst AS v, sum(sigma) AS sigma FROM p{i - 1} x JOIN b ON b.src = x.v ANTI JOIN ({seen}) o ON o.s = x.s AND o.v = b.dst GROUP BY 1, 2)")
    parts.append(f"d{levels} AS MATERIALIZED (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM p{levels})")
    for i in range(levels - 1, 0, -1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT p.s, p.v, p.sigma, coalesce(sum(p.sigma / x.sigma * (1 + x.delta)), 0) AS delta FROM p{i} p LEFT JOIN (SELECT d.s, b.src AS v, d.sigma, d.delta FROM d{i + 1} d JOIN b ON b.dst = d.v) x ON x.s = p.s AND x.v = p.v GROUP BY 1, 2, 3)")
    every = " UNION ALL ".join(f"SELECT v, delta FROM d{i}" for i in range(1, levels + 1))
    return f"WITH {', '.join(parts)} SELECT v.id, round(coalesce(sum(delta), 0) * (n / {sample}::DOUBLE) * 2 / ((n - 1) * (n - 2)::DOUBLE), 8) AS bc FROM v CROSS JOIN n LEFT JOIN ({every}) x ON x.v = v.id GROUP BY v.id, n"


@query(_betweenness_sql(10, 5))
def graph_betweenness(spark, t):
    """Estimated from ten sources."""
    return _trade(t).betweenness_centrality(sample=10).withColumn("bc", F.round("bc", 8))


BM25 = """WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) AS words), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (words / n::DOUBLE)))), 6) AS fts_score
FROM p JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN n WHERE term IN ('thing', 'stion', 'password') GROUP BY 1"""


@query(BM25)
def fts_bm25(spark, t):
    index = fts.create_index(t("documents").df, "doc_id", "text", stemmer="none", stopwords="none", strip_accents=False)
    return fts.search(index, "thing stion PASSWORD").select("doc_id", F.round("fts_score", 6).alias("fts_score"))


@query()
def fts_stemmed(spark, t):
    """With the English stemmer and stop words, best 20; SQL has no stemmer, the tests hold it against plain Python."""
    index = fts.create_index(t("documents").df, "doc_id", "text")
    return fts.search(index, "the things lasted", limit=20).select("doc_id", "fts_score")


@query("SELECT event_type, count(DISTINCT event_id) AS near FROM events GROUP BY 1")
def approx_distinct(spark, t):
    """``near`` is the exact count where the sketch is within five of its standard errors, else the sketch's own."""
    got = t("events").group_by("event_type").summarise(exact="count_distinct(event_id)", approx="approx_count_distinct(event_id, 0.01)")
    return got.mutate(near="CASE WHEN abs(approx - exact) <= 0.05 * exact THEN exact ELSE approx END").select("event_type", "near")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_group(spark, t):
    """The same verbs over a streaming source, run until nothing new is there."""
    from ..streaming import run_available, stream_parquet

    static = t("events")
    files = static.df.inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    pattern = f"{folder}/events.parquet" if len(files) == 1 else folder
    name = f"events_{abs(hash(static))}"
    frame = stream_parquet(spark, pattern.replace("events.parquet", "event*.parquet") if len(files) == 1 else pattern, static.df.schema).group_by("event_type").summarise(n="count(*)", total="round(sum(value), 4)")
    run_available(frame, name)
    return spark.table(name)
