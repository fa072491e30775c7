"""The queries in SQL for an independent engine, over the same tables."""

from __future__ import annotations

from ..operators.rules import PRODUCT_DECISIONS, RULES

_P = "case when {d} >= date '1997-01-01' and {d} < date '1998-01-01' then 'CURRENT' when {d} >= date '1996-01-01' and {d} < date '1997-01-01' then 'COMPARISON' end"
_O = f"""ord as (select o_orderkey order_id, o_custkey customer_id, o_orderdate demand_at, cast(o_totalprice as decimal(18,2)) as value, o_orderstatus = 'P' as is_cancelled,
 {_P.format(d="cast(o_orderdate as date)")} as period,
 case when o_orderkey % 7 = 0 then 'UNKNOWN' when row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1 then 'NEW' else 'RETURNING' end as segment from orders),
li as (select l_orderkey order_id, l_linenumber line_number, l_partkey product_id, cast(l_quantity as int) quantity,
 cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(20,4)) revenue,
 cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as decimal(20,4)) discount, l_returnflag flag from lineitem),
ln as (select *, case flag when 'R' then quantity when 'A' then quantity // 2 else 0 end refunded_units, case flag when 'A' then quantity // 2 else 0 end restocked_units,
 case flag when 'R' then 0 else quantity end current_quantity,
 cast(case flag when 'R' then revenue when 'A' then revenue * cast(0.5 as decimal(2,1)) else 0 end as decimal(22,5)) refund_value from li),
pl as (select ln.*, o.demand_at, o.period from ln join ord o using (order_id) where not o.is_cancelled and o.period is not null),
po as (select o.*, coalesce(x.units, 0) units, coalesce(x.refunds, 0) refunds, coalesce(x.discounts, 0) discounts from ord o left join (select order_id, sum(quantity) units, sum(refund_value) refunds, sum(discount) discounts from ln group by 1) x using (order_id) where not o.is_cancelled and o.period is not null)"""
_C = f"""{_O},
cost as (select p_partkey product_id, timestamp '1990-01-01' f, timestamp '1996-07-01' u, cast(cast(p_retailprice as decimal(18,2)) * cast(0.4 as decimal(2,1)) as decimal(20,3)) c from part
 union all select p_partkey, timestamp '1996-07-01', case when p_partkey % 3 = 0 then timestamp '1997-10-01' end, cast(cast(p_retailprice as decimal(18,2)) * cast(0.5 as decimal(2,1)) as decimal(20,3)) from part),
cl as (select pl.*, c.c unit_cost from pl left join cost c on c.product_id = pl.product_id and c.f <= pl.demand_at and (c.u is null or c.u > pl.demand_at)),
adj as (select *, least(quantity, greatest(refunded_units, quantity - current_quantity, 0)) au,
 least(cast(revenue as double), greatest(cast(refund_value as double), cast(revenue as double) * (quantity - current_quantity) / nullif(quantity, 0), 0.0)) av, greatest(quantity - restocked_units, 0) cu from cl),
eco as (select period, product_id, count(distinct order_id) orders, sum(quantity) sold_units, sum(au) refunded_units, cast(sum(revenue) as double) revenue,
 sum(cast(round(av * 10000) as bigint)) / 10000.0 refund_value, cast(sum(case when unit_cost is not null then unit_cost * cu end) as double) raw_cogs,
 coalesce(sum(case when unit_cost is not null then cu end), 0) covered_units, sum(cu) relevant_units from adj group by 1, 2),
met as (select *, case when cost_coverage >= 0.8 then coalesce(raw_cogs, 0.0) end cogs from (select *, case when relevant_units = 0 then 1.0 else cast(covered_units as double) / relevant_units end cost_coverage,
 greatest(revenue - cast(refund_value as double), 0.0) net_revenue, sold_units - refunded_units net_units from eco)),
mets as (select *, net_revenue - cogs contribution_before_ads from met)"""
def _ads(current: tuple[str, str], comparison: tuple[str, str]) -> str:
    period = f"case when cast(l_shipdate as date) >= date '{current[0]}' and cast(l_shipdate as date) < date '{current[1]}' then 'CURRENT' when cast(l_shipdate as date) >= date '{comparison[0]}' and cast(l_shipdate as date) < date '{comparison[1]}' then 'COMPARISON' end"
    return f"""fact as (select l_suppkey ad_id, cast(l_shipdate as date) as date, {period} as period,
 sum(cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(20,4))) spend, sum(cast(l_quantity as bigint) * 100) impressions, count(*) clicks,
 case when not max(l_returnflag = 'A') then count(*) end conversions, case when not max(l_returnflag = 'A') then sum(cast(l_extendedprice as decimal(18,2))) end conversion_value,
 max(case when l_linenumber > 1 then l_linenumber end) frequency from lineitem group by 1, 2, 3),
ad as (select f.*, s_nationkey campaign_id, s_nationkey * 2 + cast(s_acctbal < 0 as int) group_id, cast(s_nationkey * 3 + s_suppkey % 3 as bigint) creative_id, case s_nationkey % 3 when 0 then 'META' when 1 then 'GOOGLE' else 'TIKTOK' end provider,
 case s_nationkey % 2 when 0 then 'EUR' else 'USD' end currency, s_nationkey % 5 account_id from fact f join supplier on s_suppkey = ad_id where period is not null)"""


_M = """shared as (select s_suppkey ad_id from supplier where s_suppkey % 5 = 0),
mp as (select ad_id, product_id, confidence, confirmed from (select distinct l_suppkey ad_id, l_partkey product_id, ((l_partkey * 7 + l_suppkey) % 100) / 100.0 confidence, l_partkey % 97 = 0 confirmed from lineitem)
 where (product_id + ad_id) % (case when ad_id % 3 = 0 then 7 else 53 end) = 0),
cls as (select ad_id, bool_or(confirmed) merchant_confirmed,
 case when bool_or(s.ad_id is not null) then 'SHARED' when count(*) filter (where confirmed) > 0 and count(distinct product_id) filter (where confirmed) = 1 then 'EXACT' when count(*) filter (where confirmed) > 0 then 'AMBIGUOUS'
  when count(distinct product_id) filter (where confidence >= 0.7) = 1 then 'EXACT' else 'AMBIGUOUS' end mapping_class,
 case when bool_or(s.ad_id is not null) then null when count(*) filter (where confirmed) > 0 then case when count(distinct product_id) filter (where confirmed) = 1 then min(product_id) filter (where confirmed) end
  when count(distinct product_id) filter (where confidence >= 0.7) = 1 then min(product_id) filter (where confidence >= 0.7) end product_id,
 case when bool_or(s.ad_id is not null) then max(confidence) when count(*) filter (where confirmed) > 0 and count(distinct product_id) filter (where confirmed) = 1 then 1.0 when count(*) filter (where confirmed) > 0 then max(confidence) filter (where confirmed)
  else coalesce(max(confidence) filter (where confidence >= 0.7), 0) end confidence
 from mp left join shared s using (ad_id) group by 1)"""
_A = _ads(("1997-01-01", "1998-01-01"), ("1996-01-01", "1997-01-01")) + ", " + _M
_AM = _ads(("1997-12-01", "1998-01-01"), ("1997-11-01", "1997-12-01"))
_SUMS = """cast(sum(spend) as double) spend, sum(impressions) impressions, sum(clicks) clicks, case when count(conversions) = count(*) then sum(conversions) end conversions,
 case when count(conversion_value) = count(*) then cast(sum(conversion_value) as double) end conversion_value,
 cast(sum(case when frequency is not null then frequency * impressions end) as double) / nullif(cast(sum(impressions) as double), 0) frequency"""
_RATIOS = """conversion_value / nullif(spend, 0) roas, spend / nullif(cast(conversions as double), 0) cpa, cast(clicks as double) / nullif(cast(impressions as double), 0) ctr,
 spend / nullif(cast(clicks as double), 0) cpc, spend * 1000 / nullif(cast(impressions as double), 0) cpm"""
_E = """ev as (select event_id, ts event_at, ts + to_minutes(cast(event_id % 10 as bigint)) received_at, user_id visitor_id, k,
 case when event_type = 'view' and k % 5 = 1 then 'COLLECTION_VIEW' when event_type = 'view' then 'PRODUCT_VIEW' when event_type = 'click' and k % 3 = 0 then 'CART_VIEW' when event_type = 'click' then 'ADD_TO_CART' when event_type = 'signup' then 'BEGIN_CHECKOUT' when event_type = 'purchase' then 'CHECKOUT_COMPLETED' else 'PAGE_VIEW' end event_name,
 case k % 4 when 0 then 'META' when 1 then 'GOOGLE' when 2 then 'DIRECT' else 'UNKNOWN' end source,
 case when event_type = 'view' and k % 5 <> 1 or event_type = 'click' and k % 3 <> 0 then k % 20 end product_id, case when event_type = 'view' and k % 5 = 1 then k % 3 end collection_id, case when k % 8 = 0 then k end ad_id, event_type = 'purchase' and event_id % 4 <> 0 linked,
 case k % 5 when 0 then '/' when 1 then '/collections/c' || (k % 3) when 2 then '/products/p' || (k % 20) when 3 then '/pages/about' else '/:other' end landing
 from (select *, cast(json_extract_string(props, '$.k') as bigint) k from events)),
gap as (select *, case when lag(event_at) over (partition by visitor_id order by event_at, event_id) + interval 720 minute > event_at then 0 else 1 end n from ev),
es as (select *, cast(visitor_id as varchar) || ':' || cast(sum(n) over (partition by visitor_id order by event_at, event_id rows unbounded preceding) as varchar) session_id from gap),
ses as (select session_id, first(visitor_id order by event_at, event_id) visitor_id, count(distinct visitor_id) > 1 several_visitors, min(event_at) started_at, max(event_at) ended_at, count(*) events,
 count(*) filter (where event_name = 'PAGE_VIEW') page_views, count(*) filter (where event_name = 'PRODUCT_VIEW') product_views, count(*) filter (where event_name = 'COLLECTION_VIEW') collection_views, cast(0 as bigint) searches, count(*) filter (where event_name = 'ADD_TO_CART') adds_to_cart, cast(0 as bigint) removes_from_cart,
 count(*) filter (where event_name = 'CART_VIEW') cart_views, count(*) filter (where event_name = 'BEGIN_CHECKOUT') checkouts, count(*) filter (where event_name = 'CHECKOUT_COMPLETED') purchases,
 min(event_at) filter (where event_name = 'BEGIN_CHECKOUT') checkout_started_at, min(event_at) filter (where event_name = 'CHECKOUT_COMPLETED') checkout_completed_at, bool_or(linked) linked_purchase,
 first(landing order by event_at, event_id) landing, first(event_id order by event_at, event_id) first_event_id, last(event_id order by event_at, event_id) last_event_id from es group by 1),
sp as (select session_id, product_id, count(*) filter (where event_name = 'PRODUCT_VIEW') views, count(*) filter (where event_name = 'ADD_TO_CART') adds, cast(0 as bigint) removals, min(event_at) first_seen_at, max(event_at) last_seen_at from es where product_id is not null group by 1, 2),
sc as (select session_id, collection_id, count(*) views, min(event_at) first_seen_at, max(event_at) last_seen_at from es where collection_id is not null group by 1, 2),
ol as (select distinct session_id, unnest([k % 20, (k + 7) % 20]) product_id from (select session_id, last(k order by event_at, event_id) k from es where linked group by 1)),
tm as (select *, min(event_at) over (partition by session_id) session_started_at, row_number() over w = 1 or lag(source) over w is distinct from source or lag(ad_id) over w is distinct from ad_id as fresh from es window w as (partition by session_id order by event_at, event_id)),
tc as (select session_id, visitor_id, session_started_at, event_at touched_at, source, ad_id, row_number() over (partition by session_id order by event_at, event_id) ordinal from tm where fresh)"""
_FUNNEL = ", ".join(f"count(*) filter (where {w}) {n}" for n, w in [("view_sessions", "product_views > 0"), ("collection_view_sessions", "collection_views > 0"), ("cart_sessions", "adds_to_cart > 0"), ("cart_view_sessions", "cart_views > 0"), ("cart_view_checkout_sessions", "cart_views > 0 and checkouts > 0"), ("cart_view_purchase_sessions", "cart_views > 0 and linked_purchase"), ("checkout_sessions", "checkouts > 0"), ("checkout_purchase_sessions", "checkouts > 0 and linked_purchase"), ("purchase_sessions", "linked_purchase")])
_COUNTS = "sessions view_sessions collection_view_sessions cart_sessions cart_view_sessions cart_view_checkout_sessions cart_view_purchase_sessions checkout_sessions checkout_purchase_sessions purchase_sessions".split()
_CUBE = f"""{_E}, pj as (select started_at, cast(product_id as varchar) as key, views product_views, 0 collection_views, adds adds_to_cart, cart_views, checkouts, linked_purchase and ol.session_id is not null linked_purchase from sp join ses using (session_id) left join ol using (session_id, product_id)),
cj as (select started_at, cast(collection_id as varchar) as key, 0 product_views, views collection_views, 0 adds_to_cart, 0 cart_views, checkouts, linked_purchase from sc join ses using (session_id)),
cube as (select cast(started_at as date) as day, 'STORE' dimension, 'store' as key, count(*) sessions, {_FUNNEL} from ses group by 1
 union all select cast(started_at as date), 'LANDING_PAGE', 'https://shop.example' || landing, count(*), {_FUNNEL} from ses group by 1, 3
 union all select cast(started_at as date), 'PRODUCT', key, count(*), {_FUNNEL} from pj group by 1, 3
 union all select cast(started_at as date), 'COLLECTION', key, count(*), {_FUNNEL} from cj group by 1, 3)"""
_DAYS = "case when day >= date '2024-01-16' and day < date '2024-01-31' then 'CURRENT' when day >= date '2024-01-01' and day < date '2024-01-16' then 'COMPARISON' end"
_DROPS = [("SESSION_TO_PRODUCT", "view_sessions", "sessions"), ("PRODUCT_TO_CART", "cart_sessions", "view_sessions"), ("CART_TO_CHECKOUT", "cart_view_checkout_sessions", "cart_view_sessions"), ("CHECKOUT_TO_PURCHASE", "checkout_purchase_sessions", "checkout_sessions")]


def _behavior(dimension: str) -> str:
    """Sums of a dimension by period with rates and the largest drop, as the last of common table expressions."""
    drop = lambda n, d: f"case when {d} > 0 and {n} <= {d} then 1 - cast({n} as double) / {d} end"
    most = "greatest(" + ", ".join(drop(n, d) for _, n, d in _DROPS) + ")"
    return f"""bs as (select {_DAYS} as period, key, {', '.join(f'sum({c}) {c}' for c in _COUNTS)} from cube where dimension = '{dimension}' and {_DAYS} is not null group by 1, 2),
br as (select *, cast(purchase_sessions as double) / nullif(sessions, 0) conversion_rate, cast(cart_sessions as double) / nullif(view_sessions, 0) view_to_cart, cast(purchase_sessions as double) / nullif(view_sessions, 0) purchase_rate,
 greatest(0.0::double, least(1.0::double, 1 - cast(cart_view_purchase_sessions as double) / nullif(cart_view_sessions, 0))) + 0 * cart_view_purchase_sessions / nullif(cart_view_sessions, 0) cart_abandonment,
 greatest(0.0::double, least(1.0::double, 1 - cast(checkout_purchase_sessions as double) / nullif(checkout_sessions, 0))) + 0 * checkout_purchase_sessions / nullif(checkout_sessions, 0) checkout_abandonment,
 {most} largest_drop, case {' '.join(f"when {drop(n, d)} = {most} then '{stage}'" for stage, n, d in _DROPS)} end largest_drop_stage from bs)"""


_RATES = ["conversion_rate", "view_to_cart", "purchase_rate", "cart_abandonment", "checkout_abandonment"]
_SIDE = ", ".join([f"coalesce(max({c}) filter (where period = '{p}'), 0) {c}{z}" for c in _COUNTS for p, z in (("CURRENT", ""), ("COMPARISON", "0"))] + [f"max({c}) filter (where period = '{p}') {c}{z}" for c in _RATES for p, z in (("CURRENT", ""), ("COMPARISON", "0"))])
_EVIDENCE = f"select key entity_id, {_SIDE}, coalesce(max(view_sessions) filter (where period = 'CURRENT'), 0) product_views, coalesce(max(view_sessions) filter (where period = 'COMPARISON'), 0) product_views0 from br group by 1"
_J = f"""{_E}, bt as (select session_id pid, visitor_id, started_at, checkout_completed_at, coalesce(checkout_completed_at, ended_at) cutoff_at from ses where linked_purchase),
jt as (select pid, cast(started_at as date) as day, cutoff_at, t.touched_at, t.source, t.ad_id, t.session_id sid, row_number() over (partition by pid order by touched_at, ordinal, session_started_at, t.session_id) n, count(*) over (partition by pid) m from bt join tc t using (visitor_id) where touched_at <= cutoff_at and cast(session_started_at as date) >= cast(started_at as date) - 30),
dl as (select pid, (epoch_us(any_value(bt.checkout_completed_at)) - epoch_us(min(s.started_at))) // 1000 delay from bt join ses s using (visitor_id) where s.started_at <= cutoff_at and cast(s.started_at as date) >= cast(bt.started_at as date) - 30 group by 1),
wh as (select pid, count(distinct sid) ns from jt group by 1),
ji as (select pid, day, n, m, 'SOURCE' dimension, source as key from jt union all select pid, day, n, m, 'META_AD', cast(ad_id as varchar) from jt where ad_id is not null and source = 'META'),
jc as (select pid, day, dimension, key, bool_or(n = 1) f, bool_or(n = m) l, bool_or(n < m) a, max(m) = 1 one from ji group by 1, 2, 3, 4),
cr as (select day, dimension, key, count(*) purchases, count(*) filter (where f) first_touch, count(*) filter (where l) last_touch, count(*) filter (where a) assisted, count(*) filter (where one) single_touch, count(*) filter (where ns > 1) cross_session, coalesce(sum(delay), 0) delay_ms, count(delay) delays from jc join wh using (pid) left join dl using (pid) group by 1, 2, 3),
ti as (select session_id, 'SOURCE' dimension, source as key from tc union select session_id, 'META_AD', cast(ad_id as varchar) from tc where ad_id is not null and source = 'META'),
td as (select cast(started_at as date) as day, dimension, key, count(*) touched_sessions from ti join ses using (session_id) group by 1, 2, 3),
att as (select day, dimension, key, {', '.join(f'coalesce({c}, 0) {c}' for c in 'touched_sessions purchases first_touch last_touch assisted single_touch cross_session delay_ms delays'.split())} from td full join cr using (day, dimension, key))"""
_PATHS = """own as (select t.* from tc t join ses using (session_id) where touched_at <= case when linked_purchase then coalesce(checkout_completed_at, ended_at) else ended_at end),
sl as (select *, lag(source) over (partition by session_id order by touched_at, ordinal) p from own),
sx as (select session_id, 'SESSION:' || string_agg(source, '>' order by touched_at, ordinal) path from sl where p is null or p <> source group by 1),
jl as (select *, lag(source) over (partition by pid order by n) p from jt),
jx as (select pid, 'JOURNEY:' || string_agg(source, '>' order by n) path from jl where p is null or p <> source group by 1),
al as (select cast(started_at as date) as day, coalesce(path, 'SESSION:UNKNOWN') path, 1 ns, linked_purchase b, false x, cast(null as bigint) delay from ses left join sx using (session_id)
 union all select cast(started_at as date), coalesce(path, 'JOURNEY:UNKNOWN'), 0, true, coalesce(ns > 1, false), delay from bt left join jx using (pid) left join wh using (pid) left join dl using (pid))"""
_TARGETS = f"""{_J}, ta as (select distinct session_id, cast(ad_id as varchar) ad_id from tc where ad_id is not null and source = 'META'),
tg as (select session_id, 'PRODUCT' target, cast(product_id as varchar) target_id, views, adds, ol.session_id is not null has from sp left join ol using (session_id, product_id)
 union all select session_id, 'COLLECTION', cast(collection_id as varchar), views, 0, true from sc),
te as (select cast(started_at as date) as day, ta.ad_id, target, target_id, count(*) interacted_sessions, count(*) filter (where views > 0) viewed_sessions, count(*) filter (where adds > 0) cart_sessions, count(*) filter (where has and c.pid is not null) purchase_sessions,
 count(*) filter (where has and f) first_touch, count(*) filter (where has and l) last_touch, count(*) filter (where has and a) assisted
 from ta join tg using (session_id) join ses using (session_id) left join jc c on c.pid = session_id and c.dimension = 'META_AD' and c.key = ta.ad_id group by 1, 2, 3, 4)"""
_B = f"""{_C}, {_A}, per as (select unnest(['CURRENT', 'COMPARISON']) period), acc as (select distinct account_id from ad where currency = 'EUR'),
sp as (select period, count(*) - count(s) missing_accounts, case when count(s) = count(*) then cast(sum(s) as double) end spend from per cross join acc
 left join (select period, account_id, sum(spend) s from ad where currency = 'EUR' group by 1, 2) using (period, account_id) group by 1),
bl as (select k.*, cb contribution_before_ads, missing_accounts, spend, case when spend > 0 then order_value / spend end mer, case when order_value > 0 then spend / order_value end ad_spend_ratio, cb - spend contribution_after_ads
 from (select period, count(*) orders, cast(sum(value) as double) order_value from po group by 1) k left join (select period, case when count(cogs) = count(*) then sum(net_revenue) - sum(cogs) end cb from mets group by 1) using (period) left join sp using (period))"""


_COVER = f"""{_O}, cv as (select p_partkey product_id, p_partkey % 4 <> 0 tracked, cast(p_size - 7 as bigint) available, coalesce((select sum(greatest(quantity - restocked_units, 0)) from pl where pl.product_id = p_partkey and period = 'CURRENT'), 0) / 365.0::double u from part),
st as (select *, ceil(u * 10) rp, greatest(available, 0) / u dc from cv where available >= 0 and u > 0)"""


def _change(x: str) -> str:
    return f"case when {x} = 0 and {x}0 = 0 then 0.0 when {x}0 <> 0 then cast({x} - {x}0 as double) / abs(cast({x}0 as double)) end"


def _rel(x: str) -> str:
    return f"(cast({x} - {x}0 as double) / nullif(abs(cast({x}0 as double)), 0))"


_K = "impressions >= 100 and n0 > 0 and impressions0 >= 100"
_SIGNALS = [
    ("INSUFFICIENT_CURRENT_EVIDENCE", "coalesce(n, 0) = 0", "'WARNING'"),
    ("LOW_DELIVERY_INSUFFICIENT_EVIDENCE", "n > 0 and impressions < 100", "'INFO'"),
    ("NO_CONVERSION_SPEND", "impressions >= 100 and spend > 0 and conversions = 0", "'WARNING'"),
    ("SPEND_UP_EFFICIENCY_DOWN", f"{_K} and {_rel('spend')} >= 0.15 and {_rel('roas')} <= -0.15", f"case when {_rel('roas')} <= -0.3 then 'HIGH' else 'WARNING' end"),
    ("CPC_DETERIORATION", f"{_K} and {_rel('cpc')} >= 0.2", f"case when {_rel('cpc')} >= 0.4 then 'HIGH' else 'WARNING' end"),
    ("CTR_DETERIORATION", f"{_K} and {_rel('ctr')} <= -0.2", f"case when {_rel('ctr')} <= -0.4 then 'HIGH' else 'WARNING' end"),
    ("CONVERSIONS_DOWN_SPEND_UP", f"{_K} and {_rel('spend')} > 0.1 and {_rel('conversions')} < -0.1", "'HIGH'"),
    ("STRONG_PROVIDER_EFFICIENCY", f"{_K} and impressions >= 1000 and impressions0 >= 1000 and conversions >= 5 and roas >= roas0 * 1.15", "'INFO'"),
    ("SUDDEN_DELIVERY_CHANGE", f"{_K} and abs({_rel('spend')}) >= 0.5", "'WARNING'"),
]
_PAIR = ", ".join(f"max(case when period = '{p}' then {m} end) {m}{z}" for m in "n impressions spend conversions roas cpc ctr".split() for p, z in (("CURRENT", ""), ("COMPARISON", "0")))
_SEG = ", ".join(f"{f}{z}" for f, z in [(f"coalesce(sum(case when period = '{p}' then {e} end), 0) {n}", z) for p, z in (("CURRENT", ""), ("COMPARISON", "0")) for e, n in (("1", "orders"), ("units", "units"), ("value", "v"))])

ORACLE_SQL = {
    "O-75_adset_evidence": f"with {_A}, x as (select period, currency, group_id, {_SUMS} from ad group by 1, 2, 3), t as (select period, currency, cast(sum(spend) as double) a from ad group by 1, 2) select x.*, {_RATIOS}, spend / nullif(a, 0) spend_share from x join t using (period, currency)",
    "O-90_net_revenue_totals": f"with {_C}, x as (select period, product_id, greatest(sum(cast(revenue as double) - av), 0.0) n from adj group by 1, 2) select period, round(sum(n), 2) net_revenue from x group by 1",
    "O-93_latest_levels": "with x as (select l_partkey item_id, l_suppkey location_id, l_shipdate observed_at, max(cast(l_quantity as bigint)) available from lineitem where l_shipdate <= timestamp '1997-06-30' group by 1, 2, 3) select * from x qualify row_number() over (partition by item_id, location_id order by observed_at desc) = 1",
    "O-101_daily_trend": f"with {_O}, {_A}, d as (select cast(unnest(generate_series(timestamp '1997-01-01', timestamp '1997-12-31', interval 1 day)) as date) as day), a as (select cast(demand_at as date) as day, count(*) orders, cast(sum(value) as double) order_value from po where period = 'CURRENT' group by 1), b as (select date as day, cast(sum(spend) as double) spend from ad where currency = 'EUR' and period = 'CURRENT' group by 1) select day, coalesce(orders, 0) orders, coalesce(order_value, 0.0) order_value, coalesce(spend, 0.0) spend, case when spend > 0 then coalesce(order_value, 0.0) / spend end mer from d left join a using (day) left join b using (day)",
    "R-24_ad_signals": f"with {_A}, x as (select period, ad_id, count(*) n, {_SUMS} from ad group by 1, 2), y as (select *, {_RATIOS} from x), z as (select ad_id entity_id, {_PAIR} from y group by 1) " + " union all ".join(f"select entity_id, '{code}' code, {severity} severity from z where {when}" for code, when, severity in _SIGNALS),
    "W-01_overview_changes": f"with {_B}, w as (select " + ", ".join(f"max(case when period = '{p}' then {m} end) {m}{z}" for m in ("orders", "order_value", "spend", "mer") for p, z in (("CURRENT", ""), ("COMPARISON", "0"))) + f" from bl) select orders, orders0, round(order_value, 2) order_value, round(order_value0, 2) order_value0, spend, spend0, round(mer, 6) mer, round(mer0, 6) mer0, {_change('orders')} orders_change, round({_change('order_value')}, 6) order_value_change, round({_change('spend')}, 6) spend_change, round({_change('mer')}, 6) mer_change from w",
    "W-04_customers": f"with {_O}, x as (select s.segment, {_SEG} from (select unnest(['TOTAL', 'NEW', 'RETURNING', 'UNKNOWN']) segment) s left join po on s.segment in ('TOTAL', po.segment) group by 1), y as (select segment, orders, orders0, units, units0, cast(v as double) order_value, cast(v0 as double) order_value0, coalesce(cast((select sum(orders) from x where segment in ('NEW', 'RETURNING')) as double) / nullif((select orders from x where segment = 'TOTAL'), 0), 0.0) coverage, coalesce(cast((select sum(orders0) from x where segment in ('NEW', 'RETURNING')) as double) / nullif((select orders0 from x where segment = 'TOTAL'), 0), 0.0) coverage0 from x) select segment, orders, orders0, units, units0, round(order_value, 2) order_value, round(order_value0, 2) order_value0, coverage, coverage0, round(order_value / nullif(orders, 0), 4) average_order_value, round(order_value0 / nullif(orders0, 0), 4) average_order_value0, {_change('orders')} orders_change, {_change('units')} units_change, round({_change('order_value')}, 6) order_value_change from y",
    "W-05_inventory_cover": f"with {_O}, x as (select p_partkey product_id, p_partkey % 4 <> 0 tracked, cast(p_size - 7 as bigint) available, cast(p_size % 7 as bigint) incoming, coalesce((select sum(greatest(quantity - restocked_units, 0)) from pl where pl.product_id = p_partkey and period = 'CURRENT'), 0) units_sold from part) select *, units_sold / 365.0::double units_per_day, case when tracked and units_sold > 0 then greatest(available, 0) / (units_sold / 365.0::double) end days_cover from x",
    "W-13_blended_economics": f"with {_B} select period, orders, round(order_value, 2) order_value, round(contribution_before_ads, 2) contribution_before_ads, missing_accounts, spend, round(mer, 6) mer, round(ad_spend_ratio, 6) ad_spend_ratio, round(contribution_after_ads, 2) contribution_after_ads from bl",
    "W-19_visitor_journeys": f"with {_E} select visitor_id, session_id, row_number() over w ordinal, started_at, ended_at, purchases, cast(floor(epoch(started_at)) - floor(epoch(lag(ended_at) over w)) as bigint) seconds_since_previous, sum(purchases) over (partition by visitor_id order by started_at, session_id rows unbounded preceding) purchases_so_far from ses window w as (partition by visitor_id order by started_at, session_id)",
    "O-60_order_aggregates": f"with {_O} select period, segment, count(*) orders, sum(units) units, cast(sum(value) as double) order_value, cast(sum(refunds) as double) refunds from po group by 1, 2",
    "O-61_product_economics": f"with {_C} select period, product_id, orders, sold_units, refunded_units, revenue, raw_cogs, covered_units, relevant_units, cast(refund_value as double) refund_value from eco",
    "O-63_product_metrics": f"with {_C} select period, product_id, orders, sold_units, refunded_units, revenue, raw_cogs, covered_units, relevant_units, cast(refund_value as double) refund_value, cost_coverage, net_revenue, net_units, cogs, contribution_before_ads from mets",
    "O-64_total_product_metrics": f"with {_C} select period, sum(orders) order_count, sum(net_units) net_units, round(sum(net_revenue), 2) net_revenue, round(case when count(cogs) = count(*) then sum(cogs) end, 2) cogs, round(sum(cost_coverage * net_revenue) / nullif(sum(net_revenue), 0), 6) cost_coverage from mets group by 1",
    "O-65_variant_depletion": f"with {_O} select product_id, sum(greatest(quantity - restocked_units, 0)) depleted_units from pl group by 1",
    "O-70_advertising_overview": f"with {_A}, x as (select period, currency, {_SUMS}, string_agg(distinct provider, ',' order by provider) providers from ad group by 1, 2) select *, {_RATIOS} from x",
    "O-71_campaign_metrics": f"with {_A}, x as (select period, campaign_id, currency, {_SUMS} from ad group by 1, 2, 3) select *, {_RATIOS} from x",
    "O-76_raw_refund_evidence": f"with {_O} select period, product_id, sum(quantity) units, cast(sum(revenue) as double) revenue, sum(refunded_units) refunded_units, cast(sum(refund_value) as double) refund_value from pl group by 1, 2",
    "O-85_unified_accounts": f"with {_A}, x as (select period, provider, currency, account_id, cast(sum(spend) as double) spend, sum(impressions) impressions, sum(clicks) clicks, case when count(conversions) = count(*) then sum(conversions) end c, case when count(conversion_value) = count(*) then cast(sum(conversion_value) as double) end v from ad group by 1, 2, 3, 4), y as (select *, count(c) over (partition by period, provider, currency) = count(*) over (partition by period, provider, currency) complete from x) select period, provider, currency, account_id, spend, impressions, clicks, complete, case when complete then c end conversions, case when complete then v end conversion_value from y",
    "O-89_collection_performance": f"with {_O}, mem as (select p_partkey product_id, p_brand collection_id from part union select p_partkey, p_type from part), g as (select collection_id, period from (select distinct collection_id from mem) cross join (values ('CURRENT'), ('COMPARISON')) v(period)), x as (select period, collection_id, count(distinct order_id) orders, sum(quantity) units, cast(sum(revenue) as double) revenue from pl join mem using (product_id) group by 1, 2) select period, collection_id, coalesce(orders, 0) orders, coalesce(units, 0) units, coalesce(revenue, 0.0) revenue from g left join x using (period, collection_id)",
    "O-92_daily_sales": f"with {_O} select cast(demand_at as date) as day, count(distinct order_id) orders, sum(quantity) units, cast(sum(revenue) as double) gross, cast(sum(refund_value) as double) refunds from pl group by 1",
    "O-111_spend_shares": f"with {_A}, x as (select currency, campaign_id, cast(sum(spend) as double) spend from ad group by 1, 2), t as (select currency, cast(sum(spend) as double) a from ad group by 1) select currency, campaign_id, spend, spend / nullif(a, 0) spend_share from x join t using (currency)",
    "O-50_consented_events": f"with {_E}, w as (select case when event_id % 100 = 0 then 'visitor:' || visitor_id else 'session:' || session_id end sk, event_at r from es where event_id % 50 = 0) select event_name, count(*) events from es e where not exists (select 1 from w where r >= least(e.event_at, e.received_at) and (sk = 'visitor:' || e.visitor_id or sk = 'session:' || e.session_id)) group by 1",
}

_PAIRS = "max({m}) filter (where period = 'CURRENT') {m}, max({m}) filter (where period = 'COMPARISON') {m}0"


def _pairs(*names: str) -> str:
    return ", ".join(_PAIRS.format(m=m) for m in names)


_PADS = f"""{_C}, {_A}, own as (select * from ad where currency = 'EUR'), ex as (select * from cls where mapping_class = 'EXACT'),
sx as (select period, ex.product_id, count(*) source_rows, cast(sum(spend) as double) exact_spend, sum(impressions) impressions, case when count(conversion_value) = count(*) then cast(sum(conversion_value) as double) end cv, sum(cast(spend as double) * cast(confidence as double)) w from own join ex using (ad_id) group by 1, 2),
mx as (select product_id, count(*) mapped_ads, max(confidence) most, bool_or(merchant_confirmed) merchant_confirmed from ex group by 1),
ids as (select period, product_id from mets union select period, product_id from sx union select unnest(['CURRENT', 'COMPARISON']), product_id from mx),
tot as (select period, cast(sum(spend) as double) all_spend from own group by 1), rev as (select period, sum(net_revenue) all_revenue from mets group by 1),
pa as (select i.period, i.product_id, coalesce(net_units, 0) net_units, coalesce(net_revenue, 0.0) net_revenue, case when m.product_id is null then 0.0 else m.contribution_before_ads end contribution_before_ads, coalesce(source_rows, 0) source_rows, coalesce(exact_spend, 0.0) exact_spend, coalesce(impressions, 0) impressions,
 case when source_rows > 0 then case when m.product_id is null then 0.0 else m.contribution_before_ads end - exact_spend end contribution_after_ads, coalesce(coalesce(net_revenue, 0.0) / nullif(all_revenue, 0), 0.0) revenue_share, coalesce(coalesce(exact_spend, 0.0) / nullif(all_spend, 0), 0.0) spend_share,
 case when source_rows > 0 then cv / nullif(exact_spend, 0) end roas, case when exact_spend > 0 then w / exact_spend else coalesce(cast(most as double), 0.0) end mapping_confidence, coalesce(mapped_ads, 0) mapped_ads, coalesce(merchant_confirmed, false) merchant_confirmed
 from ids i left join mets m using (period, product_id) left join sx using (period, product_id) left join mx using (product_id) left join tot using (period) left join rev using (period)),
mcov as (select period, coalesce(cast(sum(spend) filter (where currency = 'EUR') as double), 0.0) spend, coalesce(cast(sum(spend) filter (where currency = 'EUR' and mapping_class = 'EXACT') as double), 0.0) exact_spend, coalesce(cast(sum(spend) filter (where currency <> 'EUR') as double), 0.0) excluded_spend from ad left join cls using (ad_id) group by 1),
mco as (select *, case when spend > 0 then exact_spend / spend else 0.0 end mapping_coverage from mcov),
stk as (select p_partkey product_id, cast(p_size - 7 as bigint) available, p_partkey % 4 <> 0 tracked from part),
pe as (select product_id entity_id, coalesce(sold_units, 0) units, net_revenue, revenue_share, exact_spend spend, impressions, spend_share, mapping_confidence, mapping_coverage, coalesce(cost_coverage, 1.0) cost_coverage, roas, contribution_after_ads, coalesce(tracked, false) inventory_trusted, available stock, relevant_units / 365.0::double velocity
 from (select * from pa where period = 'CURRENT') left join (select product_id, sold_units, cost_coverage, relevant_units from mets where period = 'CURRENT') using (product_id) left join stk using (product_id), (select mapping_coverage from mco where period = 'CURRENT'))"""


def _paid(entity: str, name: str) -> str:
    """Evidence of one kind of advertising entity, as common table expressions."""
    sides = ", ".join([f"coalesce(max({m}) filter (where period = '{p}'), 0) {m}{z}" for m in ("spend", "impressions", "clicks") for p, z in (("CURRENT", ""), ("COMPARISON", "0"))] + [f"max({m}) filter (where period = '{p}') {m}{z}" for m in "conversions conversion_value roas cpa ctr cpm frequency".split() for p, z in (("CURRENT", ""), ("COMPARISON", "0"))])
    return f"""{name}x as (select period, currency, {entity}, {_SUMS} from adm group by 1, 2, 3), {name}t as (select period, currency, cast(sum(spend) as double) a from adm group by 1, 2),
{name} as (select currency, {entity} entity_id, {sides}, coalesce(max(spend / nullif(a, 0)) filter (where period = 'CURRENT'), 0.0) spend_share from (select *, {_RATIOS} from {name}x) join {name}t using (period, currency) group by 1, 2)"""


_MONTH = _AM.replace("fact as", "factm as").replace("from fact f", "from factm f").replace("\nad as", "\nadm as")
_STORE = """kp as (select period, count(*) orders, count(*) filter (where segment = 'NEW') n, count(*) filter (where segment = 'RETURNING') r, sum(refunds) / sum(value) refund_rate, sum(discounts) / (sum(discounts) + sum(value)) discount_rate from po group by 1),
st as (select 'store' entity_id, """ + ", ".join(f"max(cast({e} as double)) filter (where period = '{p}') {n}{z}" for n, e in [("orders", "orders"), ("refund_rate", "refund_rate"), ("discount_rate", "discount_rate"), ("segment_coverage", "cast(n + r as double) / orders"), ("returning_share", "cast(r as double) / nullif(n + r, 0)"), ("known_orders", "n + r")] for p, z in (("CURRENT", ""), ("COMPARISON", "0"))) + " from kp)"


def _of(dimension: str, name: str) -> str:
    body = _behavior(dimension).replace("bs as", f"{name}s as").replace("from bs", f"from {name}s").replace("br as", f"{name}r as")
    return f"{body}, {name} as ({_EVIDENCE.replace('from br', f'from {name}r')})"


_FAMILIES = f"""{_PADS}, {_MONTH}, {_paid('campaign_id', 'campaign')}, {_paid('group_id', 'adset')}, {_paid('ad_id', 'ads')}, {_paid('creative_id', 'creative')}, {_STORE},
mapping as (select 'store' entity_id, spend, mapping_coverage from mco where period = 'CURRENT'), {_CUBE.replace("sp as (", "spr as (").replace("from sp join", "from spr join")}, {_of('STORE', 'storefront')}, {_of('PRODUCT', 'storefront_product')}, {_of('LANDING_PAGE', 'landing_page')}, {_J[len(_E) + 2:]},
attribution as (select 'store' entity_id, 'READY' quality, coalesce(cast((select sum(conversions) from adm where provider = 'META' and period = 'CURRENT') as double), 0.0) provider_purchases, cast(coalesce(sum(purchases), 0) as double) first_party_purchases, cast(coalesce(sum(touched_sessions), 0) as double) sessions from att where dimension = 'SOURCE' and key = 'META')"""
_TABLES = {"campaign": "campaign", "adset": "adset", "ad": "ads", "creative": "creative", "product": "pe", "store": "st", "mapping": "mapping", "attribution": "attribution", "storefront": "storefront", "storefront_product": "storefront_product", "landing_page": "landing_page"}


def _drafts() -> str:
    """All rules over the evidence of this module; conditions and scores are the rules' own expressions, whose values tests fix."""
    parts = []
    for rule_id, r in RULES.items():
        if r.family in _TABLES:
            parts.append(f"select '{rule_id}' rule_id, '{r.category}' category, '{r.entity}' entity_type, cast(entity_id as varchar) entity_id, {r.severity} severity, cast({r.impact} as double) impact, cast({r.confidence} as double) confidence, cast({r.urgency} as double) urgency, {r.quality} evidence_quality, '{r.precision}' as precision from {_TABLES[r.family]} where coalesce({r.when}, false)")
    return f"drafts as ({' union all '.join(parts)})"


_DV = """bo as (select event_id, event_at, k, source, linked from ev where event_name = 'CHECKOUT_COMPLETED'),
dv as (select event_id source_event_id, provider, ['DELIVERED', 'DELIVERED', 'RETRY', 'DEAD', 'PENDING'][event_id % 5 + 1] status, case when event_id % 5 = 3 then 'REJECTED' end reason_code, event_id % 7 <> 0 m, event_id % 6 <> 0 c, event_at
 from bo, (select unnest(['META', 'TIKTOK']) provider) where event_id % 3 <> 0 and (event_id + length(provider)) % 4 <> 0)"""
_QUALITY = "case when mapped_ads = 0 or source_rows = 0 then 'LOW' when merchant_confirmed then 'HIGH' else 'MEDIUM' end"
#: The secret of the query's customer identities, padded for both hashes of an HMAC.
_IPAD, _OPAD = (bytes(b ^ x for b in b"k3y".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
_WAIT = "('PENDING', 'PROCESSING', 'RETRY')"
_PL = f"select product_id, sum(quantity) q from pl group by 1"

ORACLE_SQL |= {
    "O-62_order_kpis": f"with {_O} select period, count(*) orders, round(cast(sum(value) as double), 2) order_value, round(cast(sum(refunds) as double), 4) refunds, count(*) filter (where segment = 'NEW') new_orders, count(*) filter (where segment = 'RETURNING') returning_orders, count(*) filter (where segment = 'UNKNOWN') unknown_orders, round(cast(sum(value) as double) / count(*), 4) average_order_value, count(*) filter (where segment = 'RETURNING') / cast(count(*) filter (where segment <> 'UNKNOWN') as double) returning_share, count(*) filter (where segment <> 'UNKNOWN') / cast(count(*) as double) segment_coverage from po group by 1",
    "O-78_commerce_health": f"with {_O} select period, count(*) orders, count(*) filter (where refunds > 0) / cast(count(*) as double) refund_order_rate, round(cast(sum(refunds) as double) / cast(sum(value) as double), 9) refund_rate, round(cast(sum(discounts) as double) / cast(sum(discounts) + sum(value) as double), 9) discount_rate from po group by 1",
    "O-94_inventory_history": "with sn as (select l_partkey i, cast(l_shipdate as date) t, max(struct_pack(s := l_shipdate, a := cast(l_quantity as bigint))) x, arg_max(q, l_shipdate) a from (select *, max(cast(l_quantity as bigint)) over (partition by l_partkey, l_shipdate) q from lineitem) group by 1, 2), d as (select cast(unnest(generate_series(timestamp '1997-01-01', timestamp '1997-12-31', interval 1 day)) as date) as day), g as (select i, day from (select distinct i from sn) cross join d), u as (select i, t as day, a, false as grid from sn union all select i, day, null, true from g), f as (select *, last_value(a ignore nulls) over (partition by i order by day, grid rows unbounded preceding) lv from u) select day, sum(lv) available from f where grid group by 1",
    "O-100_daily_series": f"with {_A} select date as day, currency, cast(sum(spend) as double) spend, sum(impressions) impressions, sum(clicks) clicks, case when count(conversions) = count(*) then sum(conversions) end purchases, case when count(conversion_value) = count(*) then cast(sum(conversion_value) as double) end purchase_value from ad group by 1, 2",
    "O-88_monitor_summary": f"with {_A}, x as (select currency, count(*) row_count, cast(sum(spend) as double) spend, sum(impressions) impressions, sum(clicks) clicks, coalesce(sum(conversions), 0) conversions, coalesce(cast(sum(conversion_value) as double), 0.0) conversion_value, coalesce(sum(frequency * impressions) filter (where impressions > 0), 0) / cast(sum(impressions) as double) frequency from ad where provider = 'TIKTOK' group by 1) select *, cast(clicks * 100 as double) / nullif(cast(impressions as double), 0) ctr_percent, case when conversion_value <> 0 then conversion_value / nullif(spend, 0) end roas from x",
    "O-183_monitor_entities": f"with {_A}, x as (select currency, campaign_id, count(*) row_count, cast(sum(spend) as double) spend, sum(impressions) impressions, sum(clicks) clicks, coalesce(sum(conversions), 0) conversions, coalesce(cast(sum(conversion_value) as double), 0.0) conversion_value, coalesce(sum(frequency * impressions) filter (where impressions > 0), 0) / cast(sum(impressions) as double) frequency from ad where provider = 'TIKTOK' group by 1, 2) select *, cast(clicks * 100 as double) / nullif(cast(impressions as double), 0) ctr_percent, case when conversion_value <> 0 then conversion_value / nullif(spend, 0) end roas from x",
    "O-82_mapping_classes": f"with {_A} select ad_id, mapping_class, product_id, cast(confidence as double) confidence, merchant_confirmed from cls",
    "O-82b_mapping_confidence": f"with {_A} select mapping_class, merchant_confirmed, count(*) ads, round(cast(sum(confidence) as double), 4) confidence from cls group by 1, 2",
    "O-83_mapping_accounting": f"with {_A} select period, provider, coalesce(mapping_class, 'UNMAPPED') mapping_class, cast(sum(spend) as double) spend, count(distinct ad_id) ads from ad left join cls using (ad_id) group by 1, 2, 3",
    "O-84_ad_rows": f"with {_A}, x as (select period, provider, ad_id, currency, {_SUMS} from ad group by 1, 2, 3, 4) select *, {_RATIOS} from x",
    "O-86_group_metrics": f"with {_A}, x as (select period, provider, currency, group_id entity_id, {_SUMS}, count(*) source_rows, min(date) first_day, max(date) last_day from ad group by 1, 2, 3, 4) select *, {_RATIOS} from x",
    "O-72_counters": f"with {_A} select count(distinct account_id) accounts, count(distinct campaign_id) campaigns, count(distinct ad_id) ads, count(*) facts from ad",
    "O-173_creative_rows": f"with {_A}, y as (select period, currency, creative_id, spend, impressions, clicks, coalesce(conversions, 0) conversions, coalesce(conversion_value, 0) conversion_value, frequency from ad), x as (select period, currency, creative_id, {_SUMS} from y group by 1, 2, 3) select *, {_RATIOS} from x",
    "O-176_exposure_targets": f"with {_A}, x as (select ad_id, product_id, cast(confidence as double) confidence, row_number() over (partition by ad_id order by confidence desc, product_id) place, count(*) over (partition by ad_id) targets from mp) select * from x where place <= 10",
    "O-177_mapping_summary": f"with {_A} select case when s_suppkey % 5 = 0 then 'COLLECTION' else 'PRODUCT' end target_scope, count(*) ads, count(*) filter (where s_suppkey in (select ad_id from mp where confirmed)) confirmed_ads from supplier group by 1",
    "O-186_mapping_coverage": f"with {_PADS} select * from mco",
    "W-11_exposure_scope": f"with {_A}, x as (select period, ad_id, currency, cast(sum(spend) as double) spend from ad group by 1, 2, 3) select period, ad_id, currency, coalesce(mapping_class, 'UNKNOWN') as scope, product_id, case when mapping_class = 'EXACT' then spend end product_spend, case when mapping_class = 'SHARED' then spend end shared_spend, spend from x left join cls using (ad_id)",
    "W-09_product_ads": f"with {_PADS} select * replace (round(net_revenue, 2) as net_revenue, round(contribution_before_ads, 2) as contribution_before_ads, round(contribution_after_ads, 2) as contribution_after_ads, round(revenue_share, 9) as revenue_share, round(spend_share, 9) as spend_share, round(roas, 6) as roas, round(mapping_confidence, 6) as mapping_confidence) from pa",
    "O-109_leaderboard": f"with {_C}, b as (select product_id, {', '.join(f'coalesce(max({m}) filter (where period = ' + chr(39) + p + chr(39) + f'), 0) {m}{z}' for m in ('net_revenue', 'net_units', 'orders') for p, z in (('CURRENT', ''), ('COMPARISON', '0')))} from mets group by 1) select row_number() over (order by net_revenue desc, net_units desc, orders desc, product_id) as rank, product_id, round(net_revenue, 2) net_revenue, round(net_revenue0, 2) net_revenue0, net_units, net_units0, orders, orders0, round({_change('net_revenue')}, 6) net_revenue_change, {_change('net_units')} net_units_change, {_change('orders')} orders_change from b order by 1 limit 25",
    "O-118_sessions": f"with {_E} select * exclude (landing), case landing when '/pages/about' then 'https://shop.example/pages/about?x=1' when '/:other' then 'https://shop.example/account/' || (select k from es e where e.event_id = first_event_id) else 'https://shop.example' || landing end landing_url from ses",
    "O-119_session_products": f"with {_E} select * from sp",
    "O-120_behavior_daily": f"with {_CUBE} select * from cube",
    "O-102_collection_behavior": f"with {_CUBE}, {_behavior('COLLECTION')} select * from br",
    "O-102_store_behavior": f"with {_CUBE}, {_behavior('STORE')} select * from br",
    "O-140_landing_page_drops": f"with {_CUBE}, {_behavior('LANDING_PAGE')} select * from br",
    "O-180_storefront_evidence": f"with {_CUBE}, {_behavior('PRODUCT')} {_EVIDENCE}",
    "O-182_insight_changes": f"with {_CUBE}, {_behavior('STORE')}, b as (select key, {_pairs('cart_abandonment', 'checkout_abandonment', 'conversion_rate', 'largest_drop', 'largest_drop_stage')} from br group by 1) select *, cart_abandonment - cart_abandonment0 cart_abandonment_points, checkout_abandonment - checkout_abandonment0 checkout_abandonment_points, conversion_rate - conversion_rate0 conversion_rate_points, case when largest_drop_stage = largest_drop_stage0 then largest_drop - largest_drop0 end largest_drop_points from b",
    "O-138_rate_points": f"with {_CUBE}, {_behavior('STORE')} select key, max(conversion_rate) filter (where period = 'CURRENT') - max(conversion_rate) filter (where period = 'COMPARISON') points from br group by 1",
    "O-80_checkout_purchase_overlap": f"with {_E} select cast(started_at as date) as day, count(*) filter (where checkout_started_at is not null) checkout_sessions, count(*) filter (where linked_purchase) purchase_sessions, count(*) filter (where checkout_started_at is not null and linked_purchase) both_sessions from ses group by 1",
    "O-121_attribution": f"with {_J} select * from att",
    "O-103_attribution_sources": f"with {_J} select {_DAYS} as period, key, {', '.join(f'sum({c}) {c}' for c in 'touched_sessions purchases first_touch last_touch assisted single_touch cross_session delays'.split())}, cast(floor(sum(delay_ms) / nullif(sum(delays), 0)) as bigint) average_delay_ms from att where dimension = 'SOURCE' and {_DAYS} is not null group by 1, 2",
    "O-81_attribution_health": f"with {_J} select coalesce(sum(touched_sessions), 0) touched_sessions, coalesce(sum(purchases), 0) purchase_sessions from att where dimension = 'SOURCE' and key = 'META'",
    "O-119_session_collections": f"with {_E} select * from sc",
    "O-123_target_evidence": f"with {_TARGETS} select * from te",
    "O-124_source_paths": f"with {_J}, {_PATHS} select day, path, sha256(path) path_key, cast(sum(ns) as bigint) sessions, count(*) filter (where b) purchase_sessions, count(*) filter (where x) cross_session, cast(coalesce(sum(delay), 0) as bigint) delay_ms, count(delay) delays from al group by 1, 2, 3",
    "O-174_first_touch_sources": f"with {_E}, f as (select session_id, first(source order by touched_at, ordinal) source from tc group by 1) select product_id, source, count(*) sessions from sp join f using (session_id) group by 1, 2",
    "O-122_conversion_delays": f"with {_E}, b as (select event_id purchase_id, visitor_id, event_at purchased_at from ev where event_name = 'CHECKOUT_COMPLETED'), f as (select purchase_id, min(started_at) journey_started_at from b join ses using (visitor_id) where started_at <= purchased_at and cast(started_at as date) >= cast(purchased_at as date) - 30 group by 1) select b.*, journey_started_at, (epoch_us(purchased_at) - epoch_us(journey_started_at)) // 1000 delay_ms from b left join f using (purchase_id)",
    "O-45_last_clicks": f"with {_E}, o as (select event_id order_id, visitor_id, event_at ordered_at from ev where event_name = 'CHECKOUT_COMPLETED'), x as (select order_id, source, k.event_id click_id, row_number() over (partition by order_id, source order by k.event_at desc, received_at desc, k.event_id desc) n from o join ev k using (visitor_id) where event_name = 'ADD_TO_CART' and source in ('META', 'GOOGLE') and k.event_at <= ordered_at and k.event_at >= ordered_at - interval 30 day) select o.*, a.click_id meta_click_id, b.click_id google_click_id from o left join x a on a.order_id = o.order_id and a.source = 'META' and a.n = 1 left join x b on b.order_id = o.order_id and b.source = 'GOOGLE' and b.n = 1",
    "O-116_accepted_events": f"with {_E} select event_name, count(*) events from ev where event_id % 9 <= 7 group by 1",
    "O-26_retained_events": f"with {_E} select source, count(*) events from ev where received_at + interval 10 day > timestamp '2024-01-20' group by 1",
    "O-108_ranked_candidates": f"with {_C}, {_A}, m as (select product_id, round(net_revenue, 2) net_revenue from mets where period = 'CURRENT'), sp as (select cls.product_id, cast(sum(spend) as double) spend from ad join cls using (ad_id) where mapping_class = 'EXACT' and period = 'CURRENT' group by 1), ids as (select product_id from m union select product_id from sp union select p_partkey from part where p_partkey % 50 = 0) select product_id, spend, net_revenue from ids left join sp using (product_id) left join m using (product_id) order by spend desc nulls last, net_revenue desc nulls last, product_id limit 50 offset 10",
    "W-12_shared_exposure": f"with {_COVER}, {_A}, tg as (select ad_id, count(distinct product_id) products from mp where confirmed or confidence >= 0.7 group by 1), sm as (select ad_id, cast(sum(spend) as double) spend, sum(impressions) impressions from ad where period = 'CURRENT' group by 1), rk as (select ad_id, count(*) affected_products, bool_or(available <= 0 or available <= u * 5) c, max(greatest(0.0::double, least(1.0::double, 0.55::double + greatest(rp - available, 0) / greatest(1, rp) * 0.45::double))) urgency, min(case when tracked then dc end) minimum_days_cover from mp join st using (product_id) where (confirmed or confidence >= 0.7) and available <= rp group by 1) select ad_id, products, affected_products, spend, impressions, case when c then 'CRITICAL' else 'HIGH' end severity, urgency, minimum_days_cover from tg join sm using (ad_id) join rk using (ad_id) where products > 1 and spend > 0 and impressions >= 1000",
    "O-181_ad_evidence": f"with {_MONTH}, {_paid('ad_id', 'ads')} select * from ads",
    "W-21_product_evidence": f"with {_PADS} select * replace (round(net_revenue, 2) as net_revenue, round(contribution_after_ads, 2) as contribution_after_ads, round(revenue_share, 9) as revenue_share, round(spend_share, 9) as spend_share, round(roas, 6) as roas, round(mapping_confidence, 6) as mapping_confidence, round(mapping_coverage, 6) as mapping_coverage) from pe",
    "W-15_snapshot": f"with {_FAMILIES}, {_drafts()} select * replace (round(impact, 6) as impact, round(confidence, 6) as confidence, round(urgency, 6) as urgency), case when rule_id like '%efficiency_deterioration' then case when severity = 'HIGH' then 'REDUCE' else 'HOLD' end when rule_id in ('creative_fatigue_symptoms', 'video_retention_deterioration', 'underexposed_commerce_winner') then 'TEST' when rule_id = 'provider_roas_margin_trap' then 'REDUCE' when rule_id in ('inventory_spend_conflict', 'inventory_runway_risk') then 'HOLD' else 'INVESTIGATE' end as action from drafts",
    "R-29_occurrences": f"with {_FAMILIES}, {_drafts()} select rule_id, entity_id, rule_id || ':2:' || entity_type || ':' || entity_id || ':1997-12-01:1998-01-01' occurrence_key from drafts",
    "R-27_data_quality": f"with {_PADS} select unnest(['SHOPIFY_HISTORY_LIMITED', 'META_SYNC_STALE']) code, 'WARNING' status, unnest(['SHOPIFY_COMMERCE', 'META_ADVERTISING']) surface union all select 'PRODUCT_AD_MAPPING_LOW', 'WARNING', 'CROSS_CHANNEL_PRODUCT_ADS' from mco where period = 'CURRENT' and spend > 0 and mapping_coverage < 0.6 union all select 'META_CURRENCY_MISMATCH', 'WARNING', 'CROSS_CHANNEL_PRODUCT_ADS' from mco where period = 'CURRENT' and excluded_spend > 0 union all select 'PRODUCT_COST_COVERAGE_LOW', 'WARNING', 'SHOPIFY_ECONOMICS' from mets where period = 'CURRENT' having sum(sold_units) > 0 and sum(sold_units * cost_coverage) / sum(sold_units) < 0.8",
    "R-28_limited_drafts": f"with {_FAMILIES}, {_drafts()}, q as (select unnest(['SHOPIFY_HISTORY_LIMITED', 'META_SYNC_STALE']) code union all select 'PRODUCT_AD_MAPPING_LOW' from mco where period = 'CURRENT' and spend > 0 and mapping_coverage < 0.6 union all select 'META_CURRENCY_MISMATCH' from mco where period = 'CURRENT' and excluded_spend > 0), l as (select d.*, (select string_agg(code, ',' order by code) from q where code = 'META_SYNC_STALE' or code = 'SHOPIFY_HISTORY_LIMITED' and d.precision <> 'META_PROVIDER' or code in ('PRODUCT_AD_MAPPING_LOW', 'META_CURRENCY_MISMATCH') and d.precision = 'EXACT_PRODUCT') limitations from drafts d), n as (select *, confidence * pow(0.92, length(limitations) - length(replace(limitations, ',', '')) + 1) c from l) select rule_id, entity_id, case when c >= 0.58 then 'MEDIUM' else 'LOW' end evidence_quality, round(c, 6) confidence, limitations from n",
    "O-92b_variant_sales": f"with {_O} select product_id, count(distinct order_id) orders, sum(quantity) units, sum(current_quantity) current_units, sum(refunded_units) refunded_units, round(cast(sum(revenue) as double), 2) gross, round(cast(sum(refund_value) as double), 2) refunds, round(cast(sum(revenue) as double) - cast(sum(refund_value) as double), 2) net from pl where period = 'CURRENT' group by 1",
    "O-91_store_summary": f"with {_O} select (select count(*) from part) products, (select sum(p_size - 10) from part) available, (select count(*) from part where p_size - 10 between 1 and 5) low_stock, (select count(*) from part where p_size <= 10) out_of_stock, count(*) orders, sum(units) units, round(cast(sum(value) as double), 2) total_sales, round(cast(sum(discounts) as double), 2) discounts, count(*) filter (where refunds > 0) refunded_orders, round(cast(sum(refunds) as double), 2) refunded from po where period = 'CURRENT'",
    "O-12_product_search": "with x as (select p_partkey product_id, p_name title, p_brand vendor from part where lower(p_name) like '%5%' or lower(p_brand) like '%5%' or 'sku-' || p_partkey like '%5%') select *, (select count(*) from x) total from x order by title, product_id limit 20 offset 20",
    "O-12_short_search": "select p_partkey product_id, p_name title, p_brand vendor from part where lower(p_name) like '%g%' or lower(p_brand) like '%g%' union all select p_partkey, p_name, p_brand from part where 'sku-' || p_partkey like '%ku-17%'",
    "O-165_stock_states": f"with {_COVER} select product_id, case when available <= 0 then 'SOLD_OUT' when u > 0 and greatest(available, 0) / u <= 10 then 'STOCKOUT_RISK' when available <= 5 then 'LOW_STOCK' when u = 0 and available > 15 then 'OVERSTOCK_WEAK_DEMAND' else 'HEALTHY' end stock_state from cv",
    "O-58_recent_orders": f"with {_O}, n as (select order_id, demand_at, cast(value as double) as value, is_cancelled from ord order by demand_at desc, order_id desc limit 6) select n.*, units, lines from n left join (select order_id, sum(quantity) units, count(*) lines from ln group by 1) using (order_id)",
    "W-02_dashboard": f"with {_B}, cv as (select p_partkey product_id, cast(p_size - 7 as bigint) available, coalesce(q, 0) / 365.0::double u from part left join (select product_id, sum(greatest(quantity - restocked_units, 0)) q from pl where period = 'CURRENT' group by 1) on product_id = p_partkey) select period, orders, round(order_value, 2) order_value, spend, round(mer, 6) mer, (select count(*) from cv where available >= 0 and u > 0 and available <= ceil(u * 10)) products_at_risk, (select count(*) from cv where available >= 0 and u > 0 and (available <= 0 or available <= u * 5)) products_critical from bl",
    "W-03_products": f"with {_C}, b as (select product_id, {', '.join(f'coalesce(max({m}) filter (where period = ' + chr(39) + p + chr(39) + f'), 0) {m}{z}' for m in ('net_revenue', 'net_units', 'orders') for p, z in (('CURRENT', ''), ('COMPARISON', '0')))} from mets group by 1) select product_id, round(net_revenue, 2) net_revenue, round(net_revenue0, 2) net_revenue0, net_units, net_units0, orders, orders0, round({_change('net_revenue')}, 6) net_revenue_change, {_change('net_units')} net_units_change, {_change('orders')} orders_change, (select count(*) from b) total from b order by b.net_revenue desc, net_units desc, orders desc, product_id limit 50 offset 50",
    "W-06_collections": f"with {_O}, mem as (select p_partkey product_id, p_brand collection_id from part union select p_partkey, p_type from part), g as (select collection_id, period from (select distinct collection_id from mem) cross join (values ('CURRENT'), ('COMPARISON')) v(period)), x as (select period, collection_id, count(distinct order_id) orders, sum(quantity) units, cast(sum(revenue) as double) revenue from pl join mem using (product_id) group by 1, 2), f as (select period, collection_id, coalesce(orders, 0) orders, coalesce(units, 0) units, coalesce(revenue, 0.0) revenue from g left join x using (period, collection_id)), b as (select collection_id, {_pairs('revenue', 'orders', 'units')} from f group by 1) select collection_id, round(revenue, 2) revenue, round(revenue0, 2) revenue0, orders, orders0, units, units0, round({_change('revenue')}, 6) revenue_change, {_change('orders')} orders_change, {_change('units')} units_change, (select count(*) from b) total from b order by b.revenue desc, collection_id limit 20",
    "W-07_campaigns": f"with {_A}, x as (select period, campaign_id, {_SUMS} from ad group by 1, 2), r as (select *, {_RATIOS} from x), b as (select campaign_id entity_id, {_pairs('spend', 'impressions', 'clicks', 'roas')} from r group by 1) select *, {_change('spend')} spend_change, {_change('impressions')} impressions_change, {_change('clicks')} clicks_change, {_change('roas')} roas_change, (select count(*) from b) total from b order by spend desc nulls last, entity_id limit 20",
    "W-14_unified_entities": f"with {_MONTH}, x as (select period, ad_id, count(*) n, {_SUMS} from adm group by 1, 2), y as (select *, {_RATIOS} from x), z as (select ad_id entity_id, {_PAIR} from y group by 1), g as (" + " union all ".join(f"select entity_id, '{code}' code from z where {when}" for code, when, _ in _SIGNALS) + "), c as (select entity_id, string_agg(code, ',' order by code) signals from g group by 1) select entity_id, spend, impressions, case when coalesce(n, 0) = 0 or coalesce(impressions, 0) < 100 then 'LOW' when coalesce(n0, 0) = 0 or coalesce(impressions0, 0) < 1000 or impressions < 1000 then 'MEDIUM' else 'HIGH' end confidence, coalesce(signals, '') signals, (select count(*) from z) total from z left join c using (entity_id) order by spend desc nulls last, entity_id limit 50",
    "W-17_behavior_list": f"with {_CUBE}, {_behavior('PRODUCT')}, b as (select key, {_pairs('sessions', 'view_sessions', 'conversion_rate')} from br group by 1) select *, {_change('sessions')} sessions_change, {_change('view_sessions')} view_sessions_change, {_change('conversion_rate')} conversion_rate_change, (select count(*) from b) total from b order by sessions desc nulls last, key limit 10",
    "O-95_signal_diagnostics": f"with {_E}, {_DV} select provider, 'PURCHASE' event_name, status, reason_code, count(*) total, count(*) filter (where m) measured, count(*) filter (where m and source_event_id % 2 = 0) email, count(*) filter (where m and source_event_id % 3 = 0) click_id, count(*) filter (where c) content_measured, coalesce(sum(source_event_id % 4) filter (where c), 0) observed_items, coalesce(sum(source_event_id % 2) filter (where c), 0) mapped_items from dv group by 1, 2, 3, 4",
    "O-96_delivery_funnel": f"with {_E}, {_DV}, c as (select event_name, count(*) collected, count(*) filter (where event_id % 6 <> 0) consented from ev group by 1), s as (select provider, event_name, count(distinct event_id) queued, count(distinct event_id) filter (where m) matching_measured, count(distinct event_id) filter (where status = 'DELIVERED') acknowledged from dv join ev on event_id = source_event_id group by 1, 2) select p.provider, c.*, coalesce(queued, 0) queued, coalesce(matching_measured, 0) matching_measured, coalesce(acknowledged, 0) acknowledged from c cross join (values ('META'), ('TIKTOK'), ('GOOGLE_ADS')) p(provider) left join s on s.provider = p.provider and s.event_name = c.event_name",
    "O-97_purchase_states": f"with {_E}, {_DV}, s as (select p.provider, b.event_id, coalesce(bool_or(status = 'DELIVERED'), false) a, coalesce(bool_or(status in {_WAIT}), false) w, count(source_event_id) > 0 q from bo b cross join (values ('META'), ('TIKTOK'), ('GOOGLE_ADS')) p(provider) left join dv on source_event_id = b.event_id and dv.provider = p.provider group by 1, 2) select provider, count(*) orders, count(*) filter (where a) accepted, count(*) filter (where not a and w) waiting, count(*) filter (where not a and not w and q) failed, count(*) filter (where not q) not_queued from s group by 1",
    "O-98_first_seen_touches": f"with {_E} select visitor_id, ad_id, min(touched_at) first_touched_at from tc where ad_id is not null group by 1, 2 having min(touched_at) >= timestamp '2024-01-05'",
    "O-169_delivery_health": f"with {_E}, {_DV}, h as (select provider, case when source_event_id % 11 = 0 then 'SKIPPED' else status end status, case when source_event_id % 22 = 0 then 'SHADOW_MODE' when source_event_id % 13 = 0 then 'CONNECTION_REAUTH_REQUIRED' else reason_code end reason_code, event_at + to_minutes(source_event_id % 30) due from dv where source_event_id % 17 <> 0 and event_at >= timestamp '2024-02-05' - interval 30 day), x as (select p.provider, count(status) filter (where status <> 'SKIPPED' or reason_code = 'SHADOW_MODE') eligible, count(*) filter (where status = 'DELIVERED') acknowledged, count(*) filter (where reason_code = 'SHADOW_MODE') shadow, count(*) filter (where status in ('PENDING', 'PROCESSING')) pending, count(*) filter (where status = 'RETRY') retrying, count(*) filter (where status = 'DEAD') terminal, count(*) filter (where status = 'SKIPPED' and coalesce(reason_code, '') <> 'SHADOW_MODE') excluded, count(*) filter (where reason_code = 'CONNECTION_REAUTH_REQUIRED') c, min(due) filter (where status in {_WAIT}) o from (values ('META'), ('TIKTOK'), ('GOOGLE_ADS')) p(provider) left join h on h.provider = p.provider group by 1) select * exclude (c, o), cast(acknowledged as double) / nullif(eligible, 0) acceptance_rate, array_to_string(list_filter([case when c > 0 then 'CREDENTIAL_RECONNECT_REQUIRED' end, case when terminal >= 5 and terminal >= 0.1 * greatest(1, acknowledged + terminal) then 'DELIVERY_FAILURE_RATE' end, case when o < timestamp '2024-02-04 23:50:00' then 'DELIVERY_QUEUE_STALE' end], lambda z: z is not null), ',') alerts from x",
    "O-161_customer_match": f"with a as (select c_custkey n, c_nationkey st_, sha256('user.' || c_custkey || '+x@gmail.com') e1, case when c_custkey % 4 = 0 then sha256('u' || c_custkey || '@shop.example') end e2, sha256('user' || c_custkey || '@gmail.com') g1, case when c_custkey % 3 <> 0 and length('+49301000' || c_custkey) <= 16 then '49301000' || c_custkey end p1, case when c_custkey % 5 = 0 then '493077' || c_custkey end p2, sha256(nullif(regexp_replace(lower(trim(c_name)), '[#0-9[:punct:]]', '', 'g'), '')) fn, case when c_custkey % 6 > 0 then sha256('oneil') end ln, case when c_custkey % 2 = 0 then 'de' when c_custkey % 7 = 0 then 'nz' end land from customer), b as (select *, list_filter([p1, p2], lambda x: x is not null) ps from a) select n customer_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode('[\"customer-v1\",\"' || st_ || '\",\"' || n || '\"]')))) identity, concat_ws(',', e1, e2) em, array_to_string(list_transform(ps, lambda x: sha256(x)), ',') ph, fn, ln, sha256('badhomburgvdh') ct, case when n % 2 = 0 then sha256('hesse') end st, sha256('10115') zp, sha256(land) country, case when n % 9 > 0 then sha256(cast(n as varchar)) end external_id, e1 tiktok_email, sha256('+' || ps[1]) tiktok_phone, concat_ws(',', g1, e2, nullif(array_to_string(list_transform(ps, lambda x: sha256('+' || x)), ','), ''), fn || '|' || ln || '|' || upper(land) || '|10115-A') google_identifiers, true has_email, len(ps) > 0 has_phone from b",
    "O-163_purchase_eligibility": f"with {_E}, x as (select case when k % 10 = 1 then 'TEST_ORDER' when k % 12 = 3 then 'ORDER_CANCELLED' when k % 9 = 0 then 'ORDER_SOURCE_EXCLUDED' when k % 11 = 2 then 'B2B_ORDER_EXCLUDED' when not linked then 'CHECKOUT_LINK_UNAVAILABLE' when event_at < timestamp '2024-01-03' then 'ORDER_BEFORE_INSTALLATION' when k <= 0 then 'ZERO_VALUE_ORDER' end reason from ev where event_name = 'CHECKOUT_COMPLETED') select reason, count(*) orders from x group by 1",
    "O-192_enqueued": f"with {_E}, {_DV} select p.provider, count(*) new_deliveries from bo cross join (values ('META'), ('TIKTOK'), ('GOOGLE_ADS')) p(provider) where not exists (select 1 from dv where source_event_id = event_id and dv.provider = p.provider) group by 1",
    "O-49_undelivered": f"with {_E}, {_DV} select source, count(*) orders from bo where not exists (select 1 from dv where source_event_id = event_id and status = 'DELIVERED') group by 1",
    "O-54_or_key_counts": f"with {_E} select event_id, count(*) sessions from es e join ses s on e.session_id = s.session_id or e.visitor_id = s.visitor_id group by 1",
    "O-33_selected_accounts": f"with {_A} select account_id, count(*) facts from ad where account_id in (1, 3) group by 1",
    "O-36_keyset": f"with {_E} select event_name, count(*) events from ev where received_at > timestamp '2024-01-15' or received_at = timestamp '2024-01-15' and event_id > 100 group by 1",
    "O-51_still_shared": f"with {_E} select event_name, count(*) events from es e where k % 100 <> 0 and not exists (select 1 from es w where w.k % 100 = 0 and w.received_at > e.received_at and (w.session_id = e.session_id or w.visitor_id = e.visitor_id)) group by 1",
    "O-46_latest_runs": "select distinct on (connection_id) connection_id, run_id, created_at from (select o_custkey % 50 connection_id, o_orderkey run_id, o_orderdate created_at from orders where o_orderstatus = 'F') order by connection_id, created_at desc, run_id desc",
    "O-136_numbers": "select p_partkey product_id, case when p_partkey % 3 = 1 then cast(p_size as double) else 0.0 end n from part",
    "O-142_local_days": "select cast((o_orderdate at time zone 'UTC') at time zone 'America/New_York' as date) as day, count(*) orders from orders group by 1",
    "O-15_upserted": "select o_orderkey k, case when o_orderkey % 2 = 0 then o_totalprice * 2 else o_totalprice end x, case when o_orderkey % 2 = 0 then 2 else 1 end v from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0",
    "O-22_delete_missing": "select p_partkey k from part where p_size >= 25 or p_partkey % 4 <> 0",
    "O-153_normalized_text": "select p_partkey product_id, trim(regexp_replace(lower(p_name || ' -- 50% Off! -- ' || p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) as text from part",
    "O-160_pixel_mappings": f"with {_TARGETS}, {_M}, x as (select cast(ad_id as bigint) ad_id, cast(target_id as bigint) product_id, cast(sum(interacted_sessions) as bigint) sessions, cast(sum(viewed_sessions) as bigint) viewed_sessions, sum(purchase_sessions) p from te where target = 'PRODUCT' group by 1, 2), y as (select *, cast(viewed_sessions as double) / sessions view_rate, sessions >= 5 and cast(viewed_sessions as double) / sessions >= 0.6 e from x), z as (select *, count(*) filter (where e) over (partition by ad_id) ne from y) select ad_id, product_id, sessions, viewed_sessions, view_rate, case when exists (select 1 from mp where mp.ad_id = z.ad_id and mp.product_id = z.product_id) then 'SUPPORTS_EXISTING' when exists (select 1 from mp where mp.ad_id = z.ad_id and confirmed) then 'CONFLICTS_WITH_MERCHANT_MAPPING' when e and ne > 1 then 'POSSIBLE_SHARED_SCOPE' when e then 'REVIEW_SUGGESTION' else 'INSUFFICIENT_EVIDENCE' end status, case when e then round(least(0.69::double, 0.45::double + least(sessions / 20.0::double, 1.0::double) * 0.12 + view_rate * 0.08 + least(p / cast(sessions as double) * 2, 1.0::double) * 0.04), 6) end confidence from z",
}

_STATE = f"""{_PADS}, {_CUBE.replace("sp as (", "spr as (").replace("from sp join", "from spr join")}, {_of('PRODUCT', 'seen')},
pst as (select pa.*, case when stk.available <= 0 then 'SOLD_OUT' when u > 0 and greatest(stk.available, 0) / u <= 10 then 'STOCKOUT_RISK' when stk.available <= 5 then 'LOW_STOCK' when u = 0 and stk.available > 15 then 'OVERSTOCK_WEAK_DEMAND' else 'HEALTHY' end stock_state, seen.product_views, seen.view_to_cart,
 pa.product_id in (select mp.product_id from mp join cls c2 using (ad_id) where c2.mapping_class = 'AMBIGUOUS') mapping_ambiguous, case when mapped_ads = 0 or source_rows > 0 then exact_spend end spend, true commerce_known, true pixel_fresh, contribution_after_ads < 0 inefficient_paid_demand, {_QUALITY} evidence_quality
 from pa join stk using (product_id) left join (select product_id, sum(greatest(quantity - restocked_units, 0)) / 365.0::double u from pl where period = 'CURRENT' group by 1) v using (product_id) left join seen on seen.entity_id = cast(pa.product_id as varchar) where pa.period = 'CURRENT')"""
_STATE = _STATE.replace("when u > 0 and", "when coalesce(u, 0) > 0 and").replace("when u = 0 and", "when coalesce(u, 0) = 0 and")
#: The same with the weighted confidence summed without rounding and kept to 12 digits: a sum of doubles falls to either side of a threshold by chance.
_SUM, _MEAN = "sum(cast(spend as double) * cast(confidence as double)) w", "then w / exact_spend"
_EXACT_STATE = _STATE.replace(_SUM, "cast(sum(cast(spend as decimal(20,4)) * cast(confidence as decimal(11,10))) as double) w").replace(_MEAN, "then round(w / exact_spend, 12)")
_SURE = "case evidence_quality when 'HIGH' then 0.9 when 'MEDIUM' then 0.65 else 0.35 end"
_DECISIONS = " union all ".join(f"select '{rule}' rule_id, '{category}' category, 'PRODUCT' entity_type, cast(product_id as varchar) entity_id, {severity} severity, cast({impact} as double) impact, cast({_SURE} as double) confidence, cast({urgency} as double) urgency, evidence_quality, '{precision}' as precision from pst where coalesce({when}, false)" for rule, (category, when, severity, impact, urgency, precision) in PRODUCT_DECISIONS.items())


def _signal_decisions(kind: str, column: str) -> str:
    pairs = ", ".join(f"max(case when period = '{p}' then {m} end) {m}{z}" for m in "n impressions spend conversions roas cpc ctr".split() for p, z in (("CURRENT", ""), ("COMPARISON", "0")))
    quality = "case when coalesce(n, 0) = 0 or coalesce(impressions, 0) < 100 then 'LOW' when coalesce(n0, 0) = 0 or coalesce(impressions0, 0) < 1000 or impressions < 1000 then 'MEDIUM' else 'HIGH' end"
    rows = " union all ".join(f"select entity_id, '{code}' code, {severity} s, {quality} evidence_quality from z where {when}" for code, when, severity in _SIGNALS)
    score = "cast(case s when 'HIGH' then 0.85 when 'WARNING' then 0.6 else 0.35 end as double)"
    return f"""select 'unified_{kind.lower()}_' || lower(code) rule_id, case when code like '%DELIVERY%' then 'PAID_MEDIA_DELIVERY' else 'PAID_MEDIA_EFFICIENCY' end category, '{kind}' entity_type, cast(entity_id as varchar) entity_id, case s when 'HIGH' then 'HIGH' when 'WARNING' then 'MEDIUM' else 'LOW' end severity,
 {score} impact, cast({_SURE} as double) confidence, {score} urgency, evidence_quality, 'PROVIDER_REPORTED' as precision from (with x as (select period, {column}, count(*) n, {_SUMS} from adm group by 1, 2), y as (select *, {_RATIOS} from x), z as (select {column} entity_id, {pairs} from y group by 1) {rows})"""


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_UTM = r"nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '')"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_LOOK = f"""with p as (select page_id n, url, coalesce({_UTM}, case when page_id % 5 > 0 then ['google', 'fb', 'klaviyo'][page_id % 3 + 1] end) source, case page_id % 5 when 1 then 'cpc' when 2 then 'organic' when 3 then 'email' end medium,
 case when page_id % 4 = 0 then ['www.google.de', 'm.facebook.com', 'shop.example', 'mail.google.com', 'news.example.org'][page_id % 5 + 1] end ref from pages),
q as (select *, case source when 'google' then 'GOOGLE' when 'fb' then 'META' when 'klaviyo' then 'KLAVIYO' else 'OTHER' end named from p),
r as (select case when n % 11 = 0 then ['PAID_SOCIAL', 'META', 'META_CLICK', 'true'] when n % 7 = 0 then ['OTHER', 'GOOGLE', 'GOOGLE_CLICK', 'true'] when n % 13 = 0 then ['PAID_SOCIAL', 'META', 'META_LINK_ID', 'true']
 when (source is not null or medium is not null) and medium = 'email' then ['EMAIL', named, 'UTM', 'false'] when medium = 'cpc' then [case when named = 'META' then 'PAID_SOCIAL' else 'OTHER' end, named, 'UTM', 'true']
 when medium = 'organic' then [case named when 'GOOGLE' then 'ORGANIC_SEARCH' when 'META' then 'ORGANIC_SOCIAL' else 'OTHER' end, named, 'UTM', 'false'] when source is not null then ['OTHER', named, 'UTM', null]
 when ref = 'mail.google.com' then ['EMAIL', 'GOOGLE', 'REFERRER', 'false'] when ref = 'www.google.de' then ['ORGANIC_SEARCH', 'GOOGLE', 'REFERRER', 'false'] when ref = 'm.facebook.com' then ['ORGANIC_SOCIAL', 'META', 'REFERRER', 'false'] when ref is not null then ['REFERRAL', 'OTHER', 'REFERRER', null]
 else ['DIRECT', null, 'NO_EXTERNAL_EVIDENCE', null] end a from q)"""
_CATALOG = """with v as (select p_partkey variant_id, 'SKU-' || (p_partkey % 1500) sku, p_partkey // 2 product_id, 'h' || (p_partkey // 2) handle, case when p_partkey % 2 = 0 then 'red' else 'blue' end color from part),
i as (select p_partkey item_id, case when p_partkey % 4 = 0 then 'SKU-' || p_partkey end rid, case when p_partkey % 4 = 1 then 'h' || (p_partkey // 2) end handle, case when p_partkey % 4 = 1 and p_partkey % 3 = 0 then p_partkey end token, case when p_partkey % 4 = 2 then p_partkey // 2 end gid, case when p_partkey % 5 = 0 then 'red' end color from part),
a as (select item_id, count(*) n, min(variant_id) one from i join v on rid = sku group by 1), b as (select item_id, count(*) n, min(variant_id) one from i join v on i.handle = v.handle and token = variant_id group by 1),
u as (select item_id, count(*) n, count(*) filter (where i.color is null or i.color = v.color) f, min(variant_id) al, min(variant_id) filter (where i.color is null or i.color = v.color) one from i join v on i.handle = v.handle group by 1),
g as (select item_id, count(*) n, count(*) filter (where i.color is null or i.color = v.color) f, min(variant_id) al, min(variant_id) filter (where i.color is null or i.color = v.color) one from i join v on gid = product_id group by 1),
x as (select i.item_id, case when a.n = 1 then struct_pack(state := 'MAPPED', source := 'RETAILER_ID_SKU', confidence := 1.0::double, variant_id := a.one) when a.n > 1 then struct_pack(state := 'AMBIGUOUS', source := null::varchar, confidence := 0.0::double, variant_id := null::bigint)
 when b.n = 1 then struct_pack(state := 'MAPPED', source := 'URL', confidence := 1.0::double, variant_id := b.one) when u.f = 1 then struct_pack(state := 'MAPPED', source := 'URL', confidence := 0.99::double, variant_id := u.one) when u.f > 1 and i.color is not null then struct_pack(state := 'MAPPED', source := 'URL', confidence := 0.95::double, variant_id := null::bigint) when u.n = 1 then struct_pack(state := 'MAPPED', source := 'URL', confidence := 0.95::double, variant_id := u.al)
 when g.f = 1 then struct_pack(state := 'MAPPED', source := 'PRODUCT_GROUP', confidence := 0.95::double, variant_id := g.one) when g.f > 1 and i.color is not null then struct_pack(state := 'MAPPED', source := 'PRODUCT_GROUP', confidence := 0.9::double, variant_id := null::bigint) when g.n = 1 then struct_pack(state := 'MAPPED', source := 'PRODUCT_GROUP', confidence := 0.9::double, variant_id := g.al)
 when g.n > 1 then struct_pack(state := 'AMBIGUOUS', source := null::varchar, confidence := 0.0::double, variant_id := null::bigint) else struct_pack(state := 'UNMAPPED', source := null::varchar, confidence := 0.0::double, variant_id := null::bigint) end r from i left join a using (item_id) left join b using (item_id) left join u using (item_id) left join g using (item_id))
select item_id, r.state, r.source, r.confidence, r.variant_id from x"""

_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
ORACLE_SQL |= {
    "R-25_product_decisions": f"with {_EXACT_STATE} {_DECISIONS}",
    "W-16_decisions": f"with {_EXACT_STATE}, {_MONTH}, al as ({_DECISIONS} union all {' union all '.join(_signal_decisions(k, c) for k, c in (('CAMPAIGN', 'campaign_id'), ('GROUP', 'group_id'), ('AD', 'ad_id')))}) select *, round(impact * 0.45 + confidence * 0.35 + urgency * 0.2, 6) priority from al",
    "W-10_unified_product_ads": f"with {_STATE} select product_id, round(net_revenue, 2) net_revenue, round(exact_spend, 4) exact_spend, round(contribution_after_ads, 2) contribution_after_ads, stock_state, mapped_ads, evidence_quality, (select count(*) from pst) total from pst order by pst.exact_spend desc, pst.net_revenue desc, product_id limit 50",
    "O-145_page_values": f"select page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || case when {_PATH} = '' then '/' else {_PATH} end url, {_UTM} utm_source, regexp_replace({_HOST}, '^www\\.', '') host, nullif(regexp_extract({_PATH}, '(\\d+)$', 1), '') tail from pages",
    "O-147_landing_pages": f"select regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || case when {_PATH} in ('', '/') then '/' else '/:other' end landing_page, regexp_replace({_HOST}, '^www\\.', '') host, coalesce({_UTM}, 'none') utm_source, count(*) pages from pages group by 1, 2, 3",
    "O-148_acquisition": f"{_LOOK} select a[1] channel, a[2] provider, a[3] basis, cast(a[4] as boolean) paid, count(*) visits from r group by 1, 2, 3, 4",
    "O-156_catalog_items": _CATALOG,
    "O-158_text_suggestions": f"with t as (select p_partkey ad_id, {_NORM.format('x')} f from part, unnest(['New: ' || p_name || 's of ' || p_brand, case when p_partkey % 3 = 0 then upper(p_name) end, case when p_partkey % 5 = 0 then p_brand || '!' end]) as u(x) where x is not null), n as (select distinct x title, {_NORM.format('x')} n from part, unnest([p_name, p_brand, p_type]) as u(x)), s as (select ad_id, title, max(case when f = n then 0.75::double else 0.65::double end) confidence from t join n on contains(f, n) where length(n) >= 4 group by 1, 2) select *, row_number() over (partition by ad_id order by confidence desc, title) place from s qualify place <= 5",
    "O-155_provider_ids": "select p_partkey product_id, array_to_string(list_sort(list_distinct([cast(p_partkey as varchar), 'S-' || p_size, p_partkey || 'x', '7', 'R-' || (p_size % 5)])), ',') ids from part",
}

_ASKED = "case k % 6 when 0 then 900000 when 1 then case when event_at <= timestamp '2024-01-25' then least(epoch_us(timestamp '2024-01-25') // 1000 - epoch_us(event_at) // 1000, 604800000) end end"
_RETRY = f"to_milliseconds(cast(greatest(floor(least(60000 * pow(2, least(greatest(k % 12 - 1, 0), 8)), 21600000) * ((event_id % 10) / 10.0::double * 0.5::double + 0.5::double)), coalesce({_ASKED}, 0)) as bigint))"
_SIGNALS_OF = f"""{_E}, sg as (select *, case when k % 11 = 0 then 'm' || k end mc, case when k % 13 = 0 then 't' || k end tk, case when k % 17 = 0 then 'g' || k end gc, case k % 6 when 0 then 'facebook' when 1 then 'google' when 2 then 'tiktok' when 3 then 'klaviyo' end us,
 case k % 5 when 0 then 'cpc' when 1 then 'paid_social' when 2 then 'organic' when 3 then 'email' end um, 'c' || (k % 3) uc, case when k % 8 = 0 then 'a' || k end ma, case when k % 19 = 0 then 'b' || k end ta from es),
cv as (select event_id conversion_id, event_at, visitor_id from sg where event_name = 'CHECKOUT_COMPLETED'),
rw as (select conversion_id, cv.event_at, mc, tk, gc, us, um, uc, ma, ta, min(e.event_at) fa from cv join sg e using (visitor_id) where e.event_at >= timestamp '2024-01-02' and e.event_at <= cv.event_at and coalesce(us, mc, tk, gc, ma, ta) is not null group by all having min(e.event_at) >= cv.event_at - interval 10 day),
nm as (select *, case us when 'facebook' then 'META' when 'google' then 'GOOGLE' when 'tiktok' then 'TIKTOK' when 'klaviyo' then 'KLAVIYO' else 'OTHER' end named, case um when 'email' then false when 'organic' then false when 'cpc' then true when 'paid_social' then true end upaid from rw),
ac as (select *, case when mc is not null then 'META' when tk is not null then 'TIKTOK' when gc is not null then 'GOOGLE' when ta is not null then 'TIKTOK' when ma is not null then 'META' else named end fp, coalesce(mc, tk, gc, ta, ma) is not null or upaid as paid0,
 case when mc is not null then 'META_CLICK' when tk is not null then 'TIKTOK_CLICK' when gc is not null then 'GOOGLE_CLICK' when ta is not null then 'TIKTOK_LINK_ID' when ma is not null then 'META_LINK_ID' else 'UTM' end basis,
 cast(mc is not null or ma is not null as int) + cast(tk is not null or ta is not null as int) + cast(gc is not null as int) ns from nm),
cn as (select *, case fp when 'META' then 'META' when 'TIKTOK' then 'TIKTOK' when 'GOOGLE' then 'GOOGLE_ADS' end provider, case named when 'META' then 'META' when 'TIKTOK' then 'TIKTOK' when 'GOOGLE' then 'GOOGLE_ADS' end said from ac),
jd as (select *, ns > 1 or ns > 0 and said is not null and said is distinct from provider as twofold, provider is not null and coalesce(paid0, false) and (provider <> 'META' or um in ('cpc', 'paid_social') or ma is not null) as paid1 from cn),
ju as (select *, twofold or paid1 and ns > 0 and upaid is false as amb, paid1 and not twofold and not (ns > 0 and upaid is false) as ok, provider || '|' || coalesce(case provider when 'META' then mc when 'TIKTOK' then tk else gc end, concat_ws(',', coalesce(us, '-'), coalesce(um, '-'), uc, coalesce(ma, '-'), coalesce(ta, '-'))) tkey,
 uc campaign, case when provider = 'TIKTOK' then ta else ma end ad from jd),
kt as (select conversion_id, tkey, min(fa) fa, first(provider order by fa, basis) provider, first(basis order by fa, basis) basis, first(campaign order by fa, basis) campaign, first(ad order by fa, basis) ad from ju where ok group by 1, 2),
ls as (select conversion_id, count(*) n, array_to_string(list_sort(list(distinct provider)), ',') providers, max(struct_pack(fa := fa, tkey := tkey, provider := provider, basis := basis, campaign := campaign, ad := ad)) l from kt group by 1),
am as (select conversion_id, count(*) filter (where amb) amb from ju group by 1)"""
_CHANGES = """ca as (select s_suppkey ad_id, case when s_suppkey % 17 = 0 then 'ADDED' when s_suppkey % 13 = 0 then 'DELETED' when s_suppkey % 11 = 0 then 'MOVED' when s_suppkey % 7 = 0 then 'CHANGED' end change from supplier where not (s_suppkey % 17 = 0 and s_suppkey % 13 = 0) and (s_suppkey % 17 = 0 or s_suppkey % 13 = 0 or s_suppkey % 11 = 0 or s_suppkey % 7 = 0))"""
_BROWSER = (
    _SIGNALS_OF.replace("where event_name = 'CHECKOUT_COMPLETED')", "where event_name in ('PAGE_VIEW', 'PRODUCT_VIEW', 'ADD_TO_CART'))").replace("interval 10 day", "interval 30 day")
    + """, rt as (select conversion_id event_id from ls join am using (conversion_id) where amb = 0 and contains(providers, 'META')),
be as (select event_id, event_name, visitor_id % 5 store_id, event_at, event_at + to_seconds(event_id % 40) arrived, session_id, visitor_id, k % 10 <> 0 shared, case k % 7 when 0 then 'DENIED' when 1 then 'NOT_REQUIRED' else 'GRANTED' end consent, event_at + to_seconds(event_id % 40) + case when event_id % 29 = 0 then interval 10 second else interval 90 day end expires from es),
rq as (select event_id request_id, store_id, arrived + to_seconds(event_id % 50) due from be),
wd as (select store_id, case when event_id % 100 = 0 then 'visitor:' || visitor_id else 'session:' || session_id end sk, event_at r from be where event_id % 50 = 0),
lv as (select visitor_id, arg_max(shared, struct_pack(a := event_at, b := arrived, c := event_id)) newest from be group by 1),
dn as (select n_nationkey destination_id, n_nationkey % 5 store_id, n_nationkey % 2 = 0 via_ads, n_nationkey % 4 account from nation where n_nationkey % 4 <> 3 and n_nationkey % 6 <> 5 and n_nationkey % 8 <> 6 and n_nationkey % 9 <> 1)
select request_id, e.event_id, destination_id from rq join be e using (store_id) join lv using (visitor_id) join dn using (store_id)
where e.event_name in ('PAGE_VIEW', 'PRODUCT_VIEW', 'ADD_TO_CART') and e.event_at between due - interval 60 second and due + interval 5 second and arrived between due - interval 60 second and due and expires > due and shared and consent <> 'DENIED'
 and store_id <> 4 and (store_id <> 1 or e.event_at >= timestamp '2024-01-10') and newest and e.event_id in (select event_id from rt)
 and not exists (select 1 from wd where wd.store_id = e.store_id and r >= least(e.event_at, arrived) and (sk = 'visitor:' || e.visitor_id or sk = 'session:' || e.session_id))
 and (not via_ads or store_id <> 2 and account in (0, 3) and (store_id <> 3 or due < timestamp '2024-01-20'))"""
)
ORACLE_SQL |= {
    "O-150_routing": f"with {_SIGNALS_OF} select conversion_id, case when coalesce(amb, 0) = 0 then coalesce(providers, '') else '' end eligible_providers, coalesce(n, 0) paid_touches, coalesce(amb, 0) ambiguous_touches, case when amb > 0 then 'AMBIGUOUS_TOUCH' when n > 0 then 'PAID_TOUCH_FOUND' else 'NO_PAID_TOUCH' end reason, {', '.join(f'case when coalesce(amb, 0) = 0 then l.{a} end {b}' for a, b in (('provider', 'last_provider'), ('fa', 'last_touch_at'), ('basis', 'last_basis'), ('campaign', 'last_campaign'), ('ad', 'last_ad')))} from cv left join ls using (conversion_id) left join am using (conversion_id)",
    "O-126_dirty_days": f"with {_E}, lt as (select distinct session_id from es where event_id % 50 = 0), a as (select visitor_id, cast(min(event_at) as date) as day from es join lt using (session_id) group by session_id, visitor_id union select visitor_id, cast(min(event_at) as date) from es join lt using (session_id) where event_id % 50 <> 0 group by session_id, visitor_id) select day from a union select cast(e.event_at as date) from ev e join a using (visitor_id) where event_name = 'CHECKOUT_COMPLETED' and cast(e.event_at as date) between day and day + 30",
    "O-130_changed_ads": f"with {_CHANGES} select * from ca",
    "O-130_invalidated_sessions": f"with {_E}, {_CHANGES} select session_id, max(received_at) source_received_at from es where ad_id in (select ad_id from ca) or ad_id in (select s_suppkey from supplier where s_suppkey % 17 <> 0 and s_nationkey % 9 = 4 or s_suppkey % 13 <> 0 and (s_nationkey + case when s_suppkey % 11 = 0 then 1 else 0 end) % 9 = 4 and s_nationkey + case when s_suppkey % 11 = 0 then 1 else 0 end < 25) or product_id in (select p_partkey from part where (p_partkey % 19 = 0) <> (p_partkey % 23 = 0) or p_partkey % 19 <> 0 and p_partkey % 23 <> 0 and p_partkey % 6 = 0) group by 1",
    "O-44_versioned_costs": "with v as (select l_partkey product_id, l_shipdate b, case when l_linenumber < 6 then l_shipdate + to_days(cast(l_quantity as int)) end u, cast(l_extendedprice as decimal(18,2)) c from lineitem), t as (select l_orderkey order_id, l_linenumber line_number, l_partkey product_id, o_orderdate t from lineitem join orders on o_orderkey = l_orderkey), w as (select product_id, t, arg_max(c, struct_pack(b := b, u := coalesce(u, timestamp '9999-01-01'), c := c)) unit_cost from t join v using (product_id) where b <= t and (u is null or u > t) group by 1, 2) select order_id, line_number, unit_cost from t left join w using (product_id, t)",
    "O-170_browser_pairs": f"with {_BROWSER}",
    "O-191_contents": "select l_orderkey source_event_id, count(*) observed_items, count(*) filter (where l_partkey % 3 = 1) mapped_items, count(*) filter (where l_partkey % 3 = 2) ambiguous_items, sum(cast(l_quantity as bigint)) quantity, cast(sum(cast(l_quantity as bigint) * cast(l_extendedprice as decimal(18,2))) as double) as value from lineitem group by 1",
    "O-133_keyset_sweep": f"with {_E} select received_at, event_id, event_name from ev where received_at > timestamp '2024-01-20' or received_at = timestamp '2024-01-20' and event_id > 0 order by 1, 2 limit 100",
    "O-135_retries": f"with {_E} select event_id, event_at + {_RETRY} next_try_at, event_at + interval 7 day - interval 5 minute deadline_at, event_at + {_RETRY} > event_at + interval 7 day - interval 5 minute expired from ev where event_name = 'CHECKOUT_COMPLETED'",
    "O-59_within_connection": f"with {_E} select visitor_id % 3 store_id, event_name, count(*) events from ev where visitor_id % 3 = 0 and event_at >= timestamp '2024-01-05' or visitor_id % 3 = 1 and event_at >= timestamp '2024-01-25' group by 1, 2",
    "O-184_accounts_in_scope": f"with {_A} select distinct account_id, provider, currency from ad where provider = 'META' and account_id in (0, 1, 3)",
    "O-129_linked_orders": f"with {_E} select session_id, last_event_id order_ext, cast(events % 9 + 1 as int) attempts, ended_at tried_at, case when last_event_id % 3 <> 0 then 'o' || last_event_id end order_id, case when last_event_id % 3 <> 0 then 'LINKED' else 'PENDING' end link_status, case when last_event_id % 3 = 0 then ended_at + to_minutes(least(360, 5 * cast(pow(2, least(events % 9, 7)) as bigint))) end next_try_at from ses where purchases > 0",
    "W-24_purchase_candidates": f"with {_E}, {_DV}, w as (select event_id from ev where event_name = 'CHECKOUT_COMPLETED' and k % 10 <> 1 and k % 12 <> 3 and k % 9 <> 0 and k % 11 <> 2 and linked and k > 0 and event_id not in (select source_event_id from dv where status = 'DELIVERED')), o as (select event_id order_id, visitor_id, event_at ordered_at from ev where event_name = 'CHECKOUT_COMPLETED' and event_id in (select event_id from w)), x as (select order_id, source, k.event_id click_id, row_number() over (partition by order_id, source order by k.event_at desc, received_at desc, k.event_id desc) n from o join ev k using (visitor_id) where event_name = 'ADD_TO_CART' and source in ('META', 'GOOGLE') and k.event_at <= ordered_at and k.event_at >= ordered_at - interval 30 day) select o.*, a.click_id meta_click_id, b.click_id google_click_id from o left join x a on a.order_id = o.order_id and a.source = 'META' and a.n = 1 left join x b on b.order_id = o.order_id and b.source = 'GOOGLE' and b.n = 1",
    "W-22_report": f"with {_FAMILIES}, {_drafts()}, {_B[len(_C) + len(_A) + 4:]} select period, orders, round(order_value, 2) order_value, spend, round(mer, 6) mer, (select count(*) from drafts where severity = 'CRITICAL') critical_recommendations, (select count(*) from drafts where severity = 'HIGH') high_recommendations, (select count(*) from drafts where severity = 'MEDIUM') medium_recommendations from bl",
    "O-48_shared_ads": f"with {_A} select provider, count(*) facts from ad where ad_id in (select ad_id from shared) group by 1",
    "O-38_json_counts": "select event_type, count(*) events from events where json_extract_string(props, '$.k') = '7' group by 1",
    "O-52_delivery_grid": f"with {_E}, {_DV}, s as (select p.provider, b.event_id, coalesce(bool_or(status = 'DELIVERED'), false) a, coalesce(bool_or(status in {_WAIT}), false) w, count(source_event_id) > 0 q from bo b cross join (values ('META'), ('PINTEREST')) p(provider) left join dv on source_event_id = b.event_id and dv.provider = p.provider group by 1, 2) select provider, count(*) orders, count(*) filter (where a) accepted, count(*) filter (where not a and w) waiting, count(*) filter (where not a and not w and q) failed, count(*) filter (where not q) not_queued from s group by 1",
}

_RES = f"""{_E}, tt as (select event_id touch_id, visitor_id, case when k % 5 = 0 then k // 32 end ce, case when k % 3 < 2 then k // 16 + k % 3 end ge, case when k % 4 = 0 then k end ae from ev),
hi as (select i ad, i // 16 g, i // 32 c from (select unnest(generate_series(0, 99, 8)) i)),
rs as (select *, case when ae is null and ge is null and ce is null then 'NONE' when ae in (select ad from hi) then case when ge <> ae // 16 or ce <> ae // 32 then 'CONFLICT' else 'EXACT' end
 when ge in (select g from hi) then case when ce <> ge // 2 then 'CONFLICT' else 'PARTIAL' end when ce in (select c from hi) then 'PARTIAL' else 'UNRESOLVED' end resolution from tt)"""
ORACLE_SQL |= {
    "O-151_touch_resolutions": f"with {_RES} select resolution, count(*) touches from rs group by 1",
    "O-152_worst_resolutions": f"with {_RES} select visitor_id, ['NONE', 'EXACT', 'PARTIAL', 'UNRESOLVED', 'CONFLICT'][max(list_position(['NONE', 'EXACT', 'PARTIAL', 'UNRESOLVED', 'CONFLICT'], resolution))] resolution from rs group by 1",
    "O-47_store_health": f"with {_E} select store_id, nullif(events, 0) events, last_event_at, nullif(sessions, 0) sessions, case when sessions > 0 then purchase_sessions end purchase_sessions, nullif(paid_touches, 0) paid_touches from (select store_id, (select count(*) from ev where visitor_id % 4 = store_id) events, (select max(received_at) from ev where visitor_id % 4 = store_id) last_event_at, (select count(*) from ses where visitor_id % 4 = store_id) sessions, (select count(*) filter (where linked_purchase) from ses where visitor_id % 4 = store_id) purchase_sessions, (select count(*) from tc where visitor_id % 4 = store_id and ad_id is not null) paid_touches from (select unnest([0, 1, 2, 3, 4]) store_id))",
}

_TOTALS = f"""{_A}, per as (select unnest(['CURRENT', 'COMPARISON']) period), acc as (select distinct account_id from ad where currency = 'EUR'),
sa as (select period, count(*) - count(s) missing_accounts, case when count(s) = count(*) then cast(sum(s) as double) end spend from per cross join acc left join (select period, account_id, sum(spend) s from ad where currency = 'EUR' group by 1, 2) using (period, account_id) group by 1),
ac as (select period, provider, coalesce(mapping_class, 'UNMAPPED') k, cast(sum(spend) as double) s from ad left join cls using (ad_id) where currency = 'EUR' group by 1, 2, 3),
su as (select period, coalesce(sum(s) filter (where k = 'EXACT'), 0.0) exact_spend, coalesce(sum(s) filter (where k = 'SHARED'), 0.0) shared_spend, coalesce(sum(s) filter (where k = 'AMBIGUOUS'), 0.0) ambiguous_spend,
 coalesce(string_agg(provider || ':' || cast(cast(round(s, 2) as decimal(20,2)) as varchar), ',' order by provider) filter (where k = 'EXACT'), '') by_provider from ac group by 1),
tt as (select *, greatest(0.0::double, spend - exact_spend - shared_spend) + 0 * spend unmapped_spend, case when spend > 0 then exact_spend / spend end mapping_coverage from sa left join su using (period))"""
_MOVED = ("spend", "exact_spend", "shared_spend", "unmapped_spend", "mapping_coverage")
ORACLE_SQL |= {
    "W-10_mapping_totals": f"with {_TOTALS} select period, missing_accounts, round(spend, 4) spend, round(exact_spend, 4) exact_spend, round(shared_spend, 4) shared_spend, round(ambiguous_spend, 4) ambiguous_spend, by_provider, round(unmapped_spend, 4) unmapped_spend, round(mapping_coverage, 9) mapping_coverage from tt",
    "W-10_mapping_changes": f"with {_TOTALS}, p as (select {', '.join(f"max({n}) filter (where period = '{p}') {n}{z}" for n in _MOVED for p, z in (('CURRENT', ''), ('COMPARISON', '0')))} from tt) select {', '.join(f'round({n}{z}, {9 if n == "mapping_coverage" else 4}) {n}{z}' for n in _MOVED for z in ('', '0'))}, {', '.join(f'round(case when {n}0 = 0 and {n} = 0 then 0.0 when {n}0 <> 0 then ({n} - {n}0) / abs({n}0) end, 9) {n}_change' for n in _MOVED)} from p",
}
