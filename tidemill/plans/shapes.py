"""More benchmark shapes as SQL, in the notation of the catalogue: further ClickBench, SSB and TPC-H queries on the columns there are, and statements.

Parts stand for SSB's parts (brand, type for category), nations and regions for its cities and regions, and lineitem's
distinct (part, supplier) pairs for TPC-H's partsupp.
"""

from __future__ import annotations

_YEAR = "{cast(year(o_orderdate) as bigint)|year(o_orderdate)}"
_REVENUE = "round(sum(l_extendedprice), 2) as revenue"
_FACTS = "lineitem join orders on l_orderkey = o_orderkey"
_PARTS = f"{_FACTS} join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_SIDES = f"{_FACTS} join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey join region cr on cn.n_regionkey = cr.r_regionkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join region sr on sn.n_regionkey = sr.r_regionkey"
_PROFIT = "round(sum(l_extendedprice - 0.1 * l_quantity * p_retailprice), 2) as profit"
#: A window of days without one type, the shape of the last ClickBench queries.
_DAYS = "ts >= TS'2024-01-05' and ts < TS'2024-01-25' and event_type <> 'error'"

SHAPES: dict[str, str] = {
    # SSB, query by query
    "ssb_q11": f"select round(sum(l_extendedprice * l_discount), 2) as revenue from {_FACTS} where year(o_orderdate) = 1996 and l_discount between 0.01 and 0.03 and l_quantity < 25",
    "ssb_q12": f"select round(sum(l_extendedprice * l_discount), 2) as revenue from {_FACTS} where o_orderdate >= TS'1997-01-01' and o_orderdate < TS'1997-02-01' and l_discount between 0.04 and 0.06 and l_quantity between 26 and 35",
    "ssb_q13": f"select round(sum(l_extendedprice * l_discount), 2) as revenue from {_FACTS} where {{weekofyear(o_orderdate)|week(o_orderdate)}} = 6 and year(o_orderdate) = 1998 and l_discount between 0.05 and 0.07 and l_quantity between 26 and 35",
    "ssb_q21": f"select {_YEAR} as d_year, p_brand, {_REVENUE} from {_PARTS} where p_type = 'PROMO' and r_name = 'AMERICA' group by 1, 2 order by 1, 2",
    "ssb_q22": f"select {_YEAR} as d_year, p_brand, {_REVENUE} from {_PARTS} where p_brand between 'Brand#12' and 'Brand#19' and r_name = 'ASIA' group by 1, 2 order by 1, 2",
    "ssb_q23": f"select {_YEAR} as d_year, p_brand, {_REVENUE} from {_PARTS} where p_brand = 'Brand#21' and r_name = 'EUROPE' group by 1, 2 order by 1, 2",
    "ssb_q31": f"select cn.n_name as c_nation, sn.n_name as s_nation, {_YEAR} as d_year, {_REVENUE} from {_SIDES} where cr.r_name = 'ASIA' and sr.r_name = 'ASIA' and year(o_orderdate) between 1996 and 2000 group by 1, 2, 3 order by d_year, revenue desc, c_nation, s_nation",
    "ssb_q32": f"select c_mktsegment, s_name, {_YEAR} as d_year, {_REVENUE} from {_SIDES} where cn.n_name = 'NATION_3' and sn.n_name = 'NATION_3' group by 1, 2, 3 order by d_year, revenue desc, c_mktsegment, s_name",
    "ssb_q33": f"select c_name, s_name, {_YEAR} as d_year, {_REVENUE} from {_SIDES} where cn.n_name in ('NATION_1', 'NATION_5') and sn.n_name in ('NATION_1', 'NATION_5') and year(o_orderdate) between 1996 and 1999 group by 1, 2, 3 order by d_year, revenue desc, c_name, s_name",
    "ssb_q34": f"select c_name, s_name, {_YEAR} as d_year, {_REVENUE} from {_SIDES} where cn.n_name in ('NATION_1', 'NATION_5') and sn.n_name in ('NATION_1', 'NATION_5') and o_orderdate >= TS'1997-12-01' and o_orderdate < TS'1998-01-01' group by 1, 2, 3 order by d_year, revenue desc, c_name, s_name",
    "ssb_q41": f"select {_YEAR} as d_year, cn.n_name as c_nation, {_PROFIT} from {_SIDES} join part on l_partkey = p_partkey where cr.r_name = 'AMERICA' and sr.r_name = 'AMERICA' and p_type in ('PROMO', 'SMALL') group by 1, 2 order by 1, 2",
    "ssb_q42": f"select {_YEAR} as d_year, sn.n_name as s_nation, p_type, {_PROFIT} from {_SIDES} join part on l_partkey = p_partkey where cr.r_name = 'AMERICA' and sr.r_name = 'AMERICA' and year(o_orderdate) in (1997, 1998) and p_type in ('PROMO', 'SMALL') group by 1, 2, 3 order by 1, 2, 3",
    "ssb_q43": f"select {_YEAR} as d_year, s_name, p_brand, {_PROFIT} from {_SIDES} join part on l_partkey = p_partkey where cr.r_name = 'AMERICA' and sn.n_name = 'NATION_1' and year(o_orderdate) in (1997, 1998) and p_type = 'PROMO' group by 1, 2, 3 order by 1, 2, 3",
    # TPC-H
    "tpch_q2_min_cost": """
        with offers as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, min(l_extendedprice / l_quantity) as cost from lineitem group by l_partkey, l_suppkey)
        select s_acctbal, s_name, n_name, p_partkey from part join offers on p_partkey = ps_partkey join supplier on s_suppkey = ps_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where p_size < 15 and p_type like '%O%' and r_name = 'EUROPE' and cost = (select min(o.cost) from offers o join supplier s on s.s_suppkey = o.ps_suppkey join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
        where o.ps_partkey = p_partkey and r.r_name = 'EUROPE') order by s_acctbal desc nulls last, n_name, s_name, p_partkey limit 100""",
    "tpch_q9_two_keys": f"""
        with offers as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, min(l_tax) as ps_cost from lineitem group by l_partkey, l_suppkey)
        select n_name as nation, {_YEAR} as o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_cost * l_quantity), 2) as sum_profit
        from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join offers on ps_suppkey = l_suppkey and ps_partkey = l_partkey join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey
        where p_size < 20 group by 1, 2 order by nation, o_year desc""",
    # ClickBench
    "cb_count": "select count(*) as n from events",
    "cb_avg_key": "select round(avg(user_id), 4) as a from events",
    "cb_sum_count_avg": "select round(sum(value), 2) as s, count(*) as n, round(avg(user_id), 4) as a from events",
    "cb_distinct_text": "select count(distinct url) as n from pages",
    "cb_min_max_day": "select min({cast(ts as date)|cast(ts as date)}) as lo, max({cast(ts as date)|cast(ts as date)}) as hi from events",
    "cb_filter_group": "select event_type, count(*) as n from events where event_type <> 'view' group by event_type order by n desc, event_type",
    "cb_distinct_topn": "select {cast(hour(ts) as bigint)|hour(ts)} as h, count(distinct user_id) as u from events group by 1 order by u desc, h limit 10",
    "cb_distinct_filtered": "select props, count(distinct user_id) as u from events where props <> '' group by props order by u desc, props limit 10",
    "cb_distinct_two_keys": "select event_type, props, count(distinct user_id) as u from events where props <> '' group by event_type, props order by u desc, event_type, props limit 10",
    "cb_phrase_topn": "select props, count(*) as n from events where props <> '' group by props order by n desc, props limit 10",
    "cb_phrase_users": "select props, count(distinct user_id) as u, count(*) as n from events where event_type = 'click' group by props order by u desc, n desc, props limit 10",
    "cb_two_keys_filtered": "select event_type, props, count(*) as n from events where props <> '' group by event_type, props order by n desc, event_type, props limit 10",
    "cb_group_limit_unordered": "with g as (select user_id, event_type, count(*) as n from events group by user_id, event_type), l as (select * from g limit 10) select count(*) as taken, count(g.n) as genuine from l left join g on l.user_id = g.user_id and l.event_type = g.event_type and l.n = g.n",
    "cb_like_order": "select * from events where props like '%7%' order by ts, event_id limit 10",
    "cb_like_two": "select min(url) as u, count(*) as n, count(distinct substring(url, 1, 20)) as d from pages where html like '%<a%' and url not like '%.net%' group by substring(url, 9, 3) order by n desc, u limit 10",
    "cb_order_by_time": "select props from events where event_type = 'purchase' order by ts, event_id limit 10",
    "cb_order_by_text": "select props from events where event_type = 'purchase' order by props limit 10",
    "cb_order_by_both": "select props, event_id from events where event_type = 'purchase' order by ts, props, event_id limit 10",
    "cb_avg_length_having": "select substring(url, 1, 14) as site, {cast(round(avg(length(url)), 4) as double)|round(avg(length(url)), 4)} as l, count(*) as c from pages group by 1 having count(*) > 3 order by l desc, site limit 25",
    "cb_group_sums": "select event_type, user_id, count(*) as c, round(sum(value), 2) as s, round(avg(value), 4) as a from events where value > 1 group by event_type, user_id order by c desc, event_type, user_id limit 10",
    "cb_group_unique": "select event_id, user_id, count(*) as c, round(sum(value), 2) as s from events group by event_id, user_id order by c desc, event_id limit 10",
    "cb_group_unique_filtered": "select event_id, user_id, count(*) as c, round(avg(value), 4) as a from events where event_type <> 'view' group by event_id, user_id order by c desc, event_id limit 10",
    "cb_url_topn": "select url, count(*) as c from pages group by url order by c desc, url limit 10",
    "cb_constant_key": "select 1 as one, url, count(*) as c from pages group by 1, url order by c desc, url limit 10",
    "cb_window_urls": f"select user_id, count(*) as views from events where {_DAYS} and props <> '' group by user_id order by views desc, user_id limit 10",
    "cb_window_types": f"select event_type, count(*) as views from events where {_DAYS} group by event_type order by views desc, event_type limit 10",
    "cb_window_offset": f"select user_id, count(*) as views from events where {_DAYS} and value > 3 group by user_id order by views desc, user_id limit 10 offset 100",
    "cb_window_five_keys": f"select event_type, user_id, case when value > 50 and event_type = 'click' then props else '' end as src, {{cast(day(ts) as bigint)|day(ts)}} as d, count(*) as views from events where {_DAYS} group by 1, 2, 3, 4 order by views desc, user_id, event_type, src, d limit 10 offset 20",
    "cb_window_days": f"select {{cast(ts as date)|cast(ts as date)}} as d, user_id, count(*) as views from events where {_DAYS} and user_id in (1, 6, 42) group by 1, 2 order by views desc, d, user_id limit 10 offset 2",
    "cb_window_sizes": f"select user_id, event_type, count(*) as views from events where {_DAYS} and user_id < 200 group by 1, 2 order by views desc, user_id, event_type limit 10 offset 10",
    "cb_window_minutes": f"select {{cast(date_trunc('minute', ts) as timestamp_ntz)|date_trunc('minute', ts)}} as m, count(*) as views from events where {_DAYS} and ts < TS'2024-01-06' group by 1 order by m limit 10 offset 100",
    # lists with NULL, grouped limit, structs by position, statements
    "not_in_list_with_null": "select count(*) as n from part where p_size not in (1, 2, null)",
    "in_long_list": "select count(*) as n from orders where o_orderkey in (" + ", ".join(str(7 * k) for k in range(120)) + ")",
    "anti_join_null_probe": "with a as (select c_custkey, nullif(c_custkey % 50, 7) as k from customer), b as (select o_custkey as k from orders where o_totalprice > 200000) select a.c_custkey, a.k from a left anti join b on a.k = b.k",
    "not_exists_null_probe": "with a as (select c_custkey, nullif(c_custkey % 50, 7) as k from customer) select c_custkey from a where not exists (select 1 from orders where o_custkey = a.k)",
    "struct_row": "{select p_partkey, s.col1 as a, s.col2 as b from (select p_partkey, struct(p_size as col1, p_brand as col2) as s from part) t|select p_partkey, s[1] as a, s[2] as b from (select p_partkey, row(p_size, p_brand) as s from part) t}",
    "regex_tilde": "{select page_id, regexp_like(url, '\\\\A(?:https?://m[.].*)\\\\z') as v from pages|select page_id, url ~ 'https?://m[.].*' as v from pages}",
    "regex_not_tilde": "{select page_id, not regexp_like(url, '\\\\A(?:.*/en/.*)\\\\z') as v from pages|select page_id, url !~ '.*/en/.*' as v from pages}",
    "similar_to": "{select p_partkey, regexp_like(p_brand, '\\\\A(?:Brand#[12][0-9])\\\\z') as v from part|select p_partkey, p_brand similar to 'Brand#[12][0-9]' as v from part}",
}
