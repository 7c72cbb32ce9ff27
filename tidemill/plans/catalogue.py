"""The query catalogue as SQL: name -> (Spark SQL, DuckDB SQL).

A text is written once where both engines read it alike. Where they differ, ``{a|b}`` holds Spark's wording and DuckDB's. Money is
DOUBLE in the tables, so sums are rounded on both sides. Queries named after TPC-H, SSB, ClickBench and JSONBench keep the shape of
their originals on the columns that these tables have.
"""

from __future__ import annotations

import re

from tidemill.plans.shapes import SHAPES

#: Sum of revenue, rounded.
_REV = "round(sum(l_extendedprice * (1 - l_discount)), 2)"

SQL: dict[str, str] = {
    # TPC-H shapes
    "tpch_q1": """
        select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
               round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
        from lineitem where l_shipdate <= TS'2001-08-01' group by l_returnflag, l_linestatus order by l_returnflag nulls last, l_linestatus nulls last""",
    "tpch_q3": f"""
        select l_orderkey, {_REV} as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        where c_mktsegment = 'BUILDING' and o_orderdate < TS'1998-03-15' and l_shipdate > TS'1998-03-15'
        group by l_orderkey, o_orderdate order by revenue desc nulls last, l_orderkey limit 10""",
    "tpch_q4_exists": """
        select o_orderpriority, count(*) as order_count from orders
        where o_orderdate >= TS'1997-01-01' and o_orderdate < TS'1997-07-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)
        group by o_orderpriority order by o_orderpriority""",
    "tpch_q5": f"""
        select n_name, {_REV} as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where r_regionkey <= 2 group by n_name order by revenue desc nulls last, n_name""",
    "tpch_q6": "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= TS'1997-01-01' and l_shipdate < TS'1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24",
    "tpch_q7_or_residual": f"""
        select n1.n_name as supp_nation, n2.n_name as cust_nation, {{cast(year(l_shipdate) as bigint)|year(l_shipdate)}} as l_year, {_REV} as revenue
        from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
        join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey
        where (n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1') or (n1.n_name = 'NATION_3' and n2.n_name = 'NATION_4')
        group by 1, 2, 3 order by 1, 2, 3""",
    "tpch_q8_share": """
        select {cast(year(o_orderdate) as bigint)|year(o_orderdate)} as o_year, round(sum(case when n_name = 'NATION_1' then l_extendedprice * (1 - l_discount) else 0.0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as mkt_share
        from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey
        where p_type = 'PROMO' group by 1 order by 1""",
    "tpch_q10": f"""
        select c_custkey, c_name, {_REV} as revenue, c_acctbal, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
        where o_orderdate >= TS'1997-10-01' and o_orderdate < TS'1998-01-01' and l_returnflag = 'R' group by c_custkey, c_name, c_acctbal, n_name order by revenue desc nulls last, c_custkey limit 20""",
    "tpch_q11_having_scalar": """
        select l_partkey, round(sum(l_extendedprice), 2) as value from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey < 5
        group by l_partkey having sum(l_extendedprice) > (select 0.0008 * sum(l_extendedprice) from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey < 5) order by value desc nulls last, l_partkey""",
    "tpch_q12_case": """
        select l_returnflag, sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as high_line_count, sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end) as low_line_count
        from orders join lineitem on o_orderkey = l_orderkey where l_shipdate >= TS'1997-01-01' and l_shipdate < TS'1998-01-01' group by l_returnflag order by l_returnflag""",
    "tpch_q13_outer_hist": """
        select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority like '1%' group by c_custkey) t
        group by c_count order by custdist desc, c_count desc""",
    "tpch_q14_promo": "select round(100.0 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0.0 end) / sum(l_extendedprice * (1 - l_discount)), 4) as promo_revenue from lineitem join part on l_partkey = p_partkey where l_shipdate >= TS'1997-09-01' and l_shipdate < TS'1997-10-01'",
    "tpch_q15_cte": f"""
        with revenue as (select l_suppkey as supplier_no, {_REV} as total_revenue from lineitem where l_shipdate >= TS'1997-01-01' and l_shipdate < TS'1997-04-01' group by l_suppkey)
        select s_suppkey, s_name, total_revenue from supplier join revenue on s_suppkey = supplier_no where total_revenue = (select max(total_revenue) from revenue) order by s_suppkey""",
    "tpch_q16_not_in": """
        select p_brand, p_type, count(distinct l_suppkey) as supplier_cnt from lineitem join part on p_partkey = l_partkey
        where p_brand <> 'Brand#11' and p_size in (1, 5, 9, 14, 23, 36, 45, 49) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)
        group by p_brand, p_type order by supplier_cnt desc, p_brand, p_type""",
    "tpch_q17_corr_avg": "select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem l join part on p_partkey = l.l_partkey where p_size < 10 and l_quantity < (select 0.4 * avg(i.l_quantity) from lineitem i where i.l_partkey = p_partkey)",
    "tpch_q18_in_having": """
        select c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) as sum_qty from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
        where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200) group by c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc nulls last, o_orderkey limit 100""",
    "tpch_q19_or": f"""
        select {_REV} as revenue from lineitem join part on p_partkey = l_partkey where (p_size between 1 and 5 and l_quantity between 1 and 11 and p_type = 'PROMO')
        or (p_size between 1 and 10 and l_quantity between 10 and 20 and p_type <> 'PROMO') or (p_size between 1 and 15 and l_quantity between 20 and 30)""",
    "tpch_q20_corr_in": """
        select s_suppkey, s_name from supplier where s_suppkey in (select l.l_suppkey from lineitem l where l.l_partkey in (select p_partkey from part where p_size < 20)
        and l.l_quantity > (select 0.5 * sum(i.l_quantity) from lineitem i where i.l_partkey = l.l_partkey and i.l_suppkey = l.l_suppkey)) order by s_suppkey""",
    "tpch_q21_double_exists": """
        select s_name, count(*) as numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey where o_orderstatus = 'F'
        and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
        and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_quantity > 40) group by s_name order by numwait desc, s_name limit 100""",
    "tpch_q22_not_exists": """
        select substring(c_name, length(c_name), 1) as code, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer
        where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.0) and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) group by 1 order by 1""",
    # SSB shapes: lineitem as the fact table
    "ssb_flight1": "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey where year(o_orderdate) = 1997 and l_discount between 0.01 and 0.03 and l_quantity < 25",
    "ssb_flight2": f"select {{cast(year(o_orderdate) as bigint)|year(o_orderdate)}} as d_year, p_brand, {_REV} as revenue from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_regionkey = 1 group by 1, 2 order by 1, 2",
    "ssb_flight3": f"select cn.n_name as c_nation, sn.n_name as s_nation, {{cast(year(o_orderdate) as bigint)|year(o_orderdate)}} as d_year, {_REV} as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation cn on c_nationkey = cn.n_nationkey join nation sn on s_nationkey = sn.n_nationkey where cn.n_regionkey = 2 and sn.n_regionkey = 2 group by 1, 2, 3 order by 3, 4 desc nulls last, 1, 2",
    "ssb_flight4": "select {cast(year(o_orderdate) as bigint)|year(o_orderdate)} as d_year, n_name, round(sum(l_extendedprice - l_quantity * p_retailprice * 0.1), 2) as profit from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where p_size <= 25 group by 1, 2 order by 1, 2",
    # ClickBench shapes over events and pages
    "cb_count_filter": "select count(*) as n from events where event_type <> 'view'",
    "cb_global_aggs": "select round(sum(value), 2) as s, count(*) as n, round(avg(value), 4) as a, min(ts) as first_ts, max(ts) as last_ts, min(value) as lo, max(value) as hi from events",
    "cb_count_distinct": "select count(distinct user_id) as users, count(distinct event_type) as types from events",
    "cb_group_topn": "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 10",
    "cb_multi_distinct_mix": "select event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 4) as a, round(sum(value), 2) as s from events group by event_type order by n desc, event_type",
    "cb_group_two_keys": "select user_id, event_type, count(*) as n from events group by user_id, event_type order by n desc, user_id, event_type limit 10",
    "cb_minute_topn": "select user_id, {cast(minute(ts) as bigint)|minute(ts)} as m, event_type, count(*) as n from events group by 1, 2, 3 order by n desc, user_id, m, event_type limit 10",
    "cb_point_lookup": "select event_id, user_id from events where user_id = 42 order by event_id",
    "cb_like_count": "select count(*) as n from pages where url like '%example.net%'",
    "cb_like_group": "select min(url) as u, count(*) as n, {cast(length(min(html)) as bigint)|length(min(html))} as l from pages where html like '%<p>%' and url not like '%.org%' group by substring(url, 1, 12) order by n desc, u limit 10",
    "cb_sum_offsets": "select " + ", ".join(f"round(sum(value + {i}), 1) as s{i}" for i in range(12)) + " from events",
    "cb_case_src": "select case when event_type = 'click' and value > 50 then event_type else '' end as src, user_id, count(*) as n from events group by 1, 2 order by n desc, src, user_id limit 10 offset 5",
    "cb_offset_page": "select url, count(*) as n from pages group by url order by n desc, url limit 10 offset 10",
    "cb_computed_keys": "select user_id, user_id - 1 as u1, user_id - 2 as u2, count(*) as n from events group by user_id, user_id - 1, user_id - 2 order by n desc, user_id limit 10",
    # joins
    "semi_join": "select c_custkey, c_name from customer left semi join orders on c_custkey = o_custkey and o_totalprice > 300000",
    "anti_join": "select c_custkey, c_name from customer left anti join (select * from orders where o_totalprice > 100000) o on c_custkey = o_custkey",
    "left_join": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000",
    "right_join": "select c_custkey, o_orderkey from (select * from orders where o_totalprice > 250000) o right join customer on c_custkey = o_custkey",
    "join_null_keys": "with a as (select o_orderkey, nullif(o_custkey, 7) as k from orders), b as (select c_custkey, nullif(c_custkey, 9) as k from customer) select o_orderkey, c_custkey from a left join b on a.k = b.k",
    "join_multi_key": "select a.l_orderkey, a.l_linenumber, b.l_quantity from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1 where a.l_quantity > 45",
    "join_computed_key": "select e.event_id, c.c_custkey from events e join customer c on e.user_id * 2 = c.c_custkey + 1",
    "corr_scalar_select": "select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as most from customer",
    "in_list_with_null": "select count(*) as n from part where p_size in (1, 2, null)",
    "not_in_with_null": "select count(*) as n from part where p_size not in (select nullif(p_size, 3) from part where p_size < 5)",
    # aggregation, distinct
    "agg_types": "select cast({sum(cast(l_linenumber as decimal(28,0)))|sum(l_linenumber)} as decimal(38,0)) as si, cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(38,2)) as sd, round({avg(cast(cast(l_discount as decimal(10,2)) as double))|avg(cast(l_discount as decimal(10,2)))}, 6) as ad, min(l_returnflag) as mt, max(l_shipdate) as md from lineitem",
    "agg_having": "select l_suppkey, count(*) as n from lineitem group by l_suppkey having count(*) > 500 and avg(l_quantity) > 25",
    "agg_null_groups": "select nullif(event_type, 'view') as k, count(*) as n, count(nullif(event_type, 'click')) as c, max(nullif(value, value)) as m from events group by 1",
    "agg_bool_key": "select value > 50 as big, count(*) as n from events group by 1",
    "agg_empty": "select count(*) as n, sum(value) as s, min(event_type) as m from events where event_id < 0",
    "agg_first_constant": "select event_type, {first(event_type)|first(event_type)} as f from events group by event_type",
    "agg_computed_key": "select l_quantity * 2 as k, count(*) as n from lineitem group by l_quantity * 2 having count(*) > 3",
    "distinct_rows": "select distinct l_returnflag, l_linestatus from lineitem",
    "group_keys_only": "select p_brand, p_type from part group by p_brand, p_type",
    # sort and limit
    "sort_nulls": "select event_id, nullif(event_type, 'view') as t from events order by t asc nulls last, event_id",
    "sort_nulls_first": "select event_id, nullif(event_type, 'view') as t from events order by t desc nulls first, event_id",
    "topn_offset": "select event_id, value from events order by value desc nulls last, event_id limit 20 offset 30",
    "limit_offset": "select event_id from (select * from events order by event_id) t order by event_id limit 10 offset 100",
    "offset_only": "select event_id from events order by event_id offset 100",
    # series, values, unnest
    "values_rows": "select * from (values (1, 'a'), (2, 'b'), (3, null)) as t(k, v)",
    "dummy_scan": "select 1 + 1 as two, 'x' || 'y' as xy",
    "unnest_pair": "{select p_partkey, z.a, z.b from (select p_partkey, array(p_size, p_size + 1) as a, array(p_size * 10, p_size * 20) as b from part) t lateral view explode(arrays_zip(a, b)) as z|select p_partkey, unnest([p_size, p_size + 1]) as a, unnest([p_size * 10, p_size * 20]) as b from part}",
    "unnest_uneven": "{select p_partkey, z.a, z.b from (select p_partkey, array(p_size, p_size + 1, p_size + 2) as a, array(p_brand) as b from part) t lateral view explode(arrays_zip(a, b)) as z|select p_partkey, unnest([p_size, p_size + 1, p_size + 2]) as a, unnest([p_brand]) as b from part}",
    "unnest_struct": "{select p_partkey, n, v from part lateral view inline(array(named_struct('n', 'size', 'v', p_size), named_struct('n', 'twice', 'v', p_size * 2))) as n, v|select p_partkey, s.n as n, s.v as v from (select p_partkey, unnest([{'n': 'size', 'v': p_size}, {'n': 'twice', 'v': p_size * 2}]) as s from part) t}",
    "unnest_empty": "{select p_partkey, x from part lateral view explode(filter(array(p_size), y -> y > 25)) as x|select p_partkey, unnest(list_filter([p_size], lambda y: y > 25)) as x from part}",
    "struct_fields": "{select p_partkey, s.a as a, s.b as b from (select p_partkey, named_struct('a', p_size, 'b', p_brand) as s from part) t|select p_partkey, s.a as a, struct_extract(s, 'b') as b from (select p_partkey, {'a': p_size, 'b': p_brand} as s from part) t}",
    "nested_ctes": "with a as (select l_suppkey, sum(l_quantity) as q from lineitem group by l_suppkey), b as (select l_suppkey, q from a where q > (select avg(q) from a)), c as (select b.l_suppkey, a.q - b.q as d from a join b on a.l_suppkey = b.l_suppkey) select l_suppkey, round(d, 2) as d from c",
    # JSON documents
    "json_q1": "{select cast(j:k as bigint) as k, count(*) as n from (select parse_json(props) as j from events) t group by 1|select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1} order by n desc, k limit 20",
    "json_q2": "{select event_type, count(*) as n, count(distinct variant_get(j, '$.k', 'bigint')) as ks from (select event_type, parse_json(props) as j from events) t|select event_type, count(*) as n, count(distinct cast(json_extract_string(props, '$.k') as bigint)) as ks from events} group by event_type",
    "json_q3": "select {cast(hour(ts) as bigint)|hour(ts)} as h, event_type, count(*) as n from events where {variant_get(parse_json(props), '$.k', 'bigint')|cast(json_extract_string(props, '$.k') as bigint)} < 50 group by 1, 2",
    "json_q4": "select user_id, min(ts) as first_ts from events where {variant_get(parse_json(props), '$.k', 'bigint')|cast(json_extract_string(props, '$.k') as bigint)} > 10 group by user_id order by first_ts, user_id limit 3",
    "json_q5": "select user_id, {unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))|epoch_us(max(ts)) - epoch_us(min(ts))} as span from events where event_type in ('click', 'view') group by user_id order by span desc, user_id limit 3",
    "json_missing": "select count(*) as n, count({variant_get(parse_json(props), '$.absent', 'string')|json_extract_string(props, '$.absent')}) as there from events",
    "json_null": "{select is_variant_null(parse_json(d):a) as json_null, parse_json(d):a is null as absent from (values ('{\"a\": null}'), ('{\"b\": 1}'), ('{\"a\": 1}')) as t(d)|select coalesce(json_type(d, '$.a') = 'NULL', false) as json_null, json_type(d, '$.a') is null as absent from (values ('{\"a\": null}'), ('{\"b\": 1}'), ('{\"a\": 1}')) as t(d)}",
    "json_text": "{select event_id, to_json(parse_json(props)) as j from events|select event_id, cast(json(props) as varchar) as j from events}",
    # strings in SQL
    "str_concat": "select doc_id, lang || '-' || source as s from documents",
    "str_between": "select count(*) as n from documents where lang between 'de' and 'es' and not (n_chars < 100)",
    "case_expr": "select doc_id, case lang when 'en' then 1 when 'fr' then 2 else 0 end as k from documents",
    "cast_strict": "select event_id, cast(cast(value as decimal(18,2)) as varchar{(40)|}) as v, cast({cast(value as bigint)|trunc(value)} as bigint) as i from events",
    "is_null": "select count(*) as n from (select nullif(event_type, 'view') as t from events) s where t is null",
}

_CHOICE = re.compile(r"\{((?:[^{}|]|\|\||\{[^{}|]*\})*)\|((?:[^{}|]|\|\||\{[^{}|]*\})*)\}")


SQL.update(SHAPES)


def _worded(text: str, side: int) -> str:
    """Spark's (0) or DuckDB's (1) wording."""
    text = _CHOICE.sub(lambda m: m[side + 1], text)
    return text.replace("TS'", "TIMESTAMP_NTZ'" if side == 0 else "TIMESTAMP '")


def spark_sql(name: str) -> str:
    return _worded(SQL[name], 0)


def duckdb_sql(name: str) -> str:
    text = _worded(SQL[name], 1)
    return text.replace("left semi join", "semi join").replace("left anti join", "anti join")
