"""Queries over flows in time: chains of steps, stages and their resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescope.operators import manifests as flow
from lurescope.operators.duplicates import decide, number_closeness
from lurescope.operators.frontier import expand
from lurescope.operators.ranges import as_of, summed_in_spans
from lurescope.plans.catalog import query
from lurescope.sources.tables import table
from lurescope.streaming import chain as ch


def steps_of(events):
    """Events as steps of their user's chain."""
    return events.select(F.col("user_id").alias("kit_id"), "event_id", F.col("event_type").alias("step"), F.col("ts").cast("timestamp").alias("at"))


_CHAIN = """
with s as (
  select distinct user_id as kit_id, event_id, event_type as step, ts as "at", event_type in ('purchase', 'error') as ends,
         list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) as place
  from events where user_id is not null
), a as (
  select *, lead("at") over (partition by kit_id order by "at", event_id, step) as next,
         cast(1 + coalesce(sum(ends::int) over (partition by kit_id order by "at", event_id, step rows between unbounded preceding and 1 preceding), 0) as int) as attempt
  from s
), c as (
  select *, case when f > 1 then f end as cursor
  from (select *, max(place) over (partition by kit_id, attempt order by "at", event_id, step rows unbounded preceding) as f from a)
), d as (select *, "at" + case when cursor is null then interval 30 minute else interval 10 minute end as due from c)
select kit_id, attempt, due as "at", case when cursor is null then 'requeue' else 'resume' end as kind, step, cast(cursor as int) as cursor
from d where not ends and (next is null or due < next)
union all
select kit_id, attempt, "at", case when step = 'purchase' then 'complete' else 'fail' end, step, cast(cursor as int) from d where ends
"""


@query("chain_by_batch", _CHAIN)
def chain_by_batch(spark, sf_dir):
    """What each kit's chain of steps brings: stalls that are resumed or queued anew, and ends of attempts."""
    return ch.chain_rows(steps_of(table(spark, sf_dir, "events"))).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("stream_chain", _CHAIN)
def stream_chain(spark, sf_dir):
    """The same rows by a stream with keyed state and event-time timers."""
    path = f"{sf_dir}/events.parquet"
    return ch.follow_all(spark, lambda: ch.file_stream(spark, path), steps_of).withColumn("at", F.col("at").cast("timestamp_ntz"))


# Stages and resources -------------------------------------------------------------------------------

HOUR = 3_600_000_000


def _micros(events):
    return events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("events_within_an_hour", """
    with e as (select event_id, event_type, ts from events), s as (select event_id as stage, ts as lo, ts + interval 1 hour as hi from e where event_type = 'signup')
    select stage, count(*) as events, min(event_id) as first_id from s join e on e.ts >= lo and e.ts < hi where e.event_type <> 'signup' group by stage""")
def events_within_an_hour(spark, sf_dir):
    """Of all users' events together, as one hot key: those in the hour after each signup."""
    e = _micros(table(spark, sf_dir, "events")).filter("us is not null")
    spans = e.filter("event_type = 'signup'").select(F.col("event_id").alias("stage"), F.col("us").alias("lo"))
    return summed_in_spans(e.filter("event_type <> 'signup'").select("event_id", "us"), spans, "event_id", "us", HOUR)


@query("last_view_before", """
    with e as (select event_id, user_id, event_type, ts from events where event_type in ('purchase', 'view')), w as (
      select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over (order by ts, event_type = 'purchase', event_id rows unbounded preceding) as any_view,
             last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_type = 'purchase', event_id rows unbounded preceding) as own_view from e)
    select event_id, user_id, any_view, own_view from w where event_type = 'purchase'""")
def last_view_before(spark, sf_dir):
    """Of each purchase: the last view by anyone, all events being one hot key, and the last by its user."""
    e = _micros(table(spark, sf_dir, "events")).withColumn("k", F.lit(0))
    buys, views = e.filter("event_type = 'purchase'").select("k", "user_id", "event_id", "us"), e.filter("event_type = 'view'").withColumn("view", F.col("event_id"))
    anyone = as_of(buys, views.withColumnRenamed("view", "any_view"), "k", "us", "event_id", ["any_view"])
    own = as_of(anyone, views.withColumnRenamed("view", "own_view"), "user_id", "us", "event_id", ["own_view"])
    return own.select("event_id", "user_id", "any_view", "own_view")


_STAGES = """
with navs as (
  select user_id as kit_id, event_id, props as url, ts, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as seq, count(*) over (partition by user_id) as n
  from events where event_type = 'signup' and user_id is not null
), res as (select user_id as kit_id, event_id, props as url, ts, value, event_type from events where event_type <> 'signup' and user_id is not null
)"""


def _stages(spark, sf_dir):
    """Signups as navigations of a kit, other events as its responses; the JSON of an event stands for an address."""
    e = table(spark, sf_dir, "events").filter("user_id is not null").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.select(F.col("user_id").alias("kit_id"), "event_id", F.col("props").alias("url"), "at", "value", "event_type")
    return e.filter("event_type = 'signup'"), e.filter("event_type <> 'signup'")


@query("resource_stages", _STAGES + """
    , logged as (select kit_id, url, arg_min(cast(event_id % 4 as int), (ts, event_id)) as doc_seq from res where event_type = 'error' group by all),
    w as (select kit_id, event_id, url, ts, null as seq, 1 as side from res where event_type <> 'error' union all select kit_id, event_id, null, ts, seq, 0 from navs),
    f as (select *, last_value(seq ignore nulls) over (partition by kit_id order by ts, side, event_id rows unbounded preceding) as inside from w)
    select f.kit_id, f.event_id, cast(coalesce(l.doc_seq, f.inside, n.n - 1, 0) as int) as seq, case when l.doc_seq is not null then 'log' when f.inside is not null then 'time' when n.n is not null then 'last' else 'none' end as found_by
    from f left join logged l on l.kit_id = f.kit_id and l.url = f.url left join (select distinct kit_id, n from navs) n on n.kit_id = f.kit_id where side = 1""")
def resource_stages(spark, sf_dir):
    """The stage that each resource belongs to: the one its log names, else the one open at its time, else the last."""
    navs, res = _stages(spark, sf_dir)
    log = res.filter("event_type = 'error'").select("kit_id", "url", "at", "event_id", (F.col("event_id") % 4).cast("int").alias("doc_seq"))
    return flow.attribute(res.filter("event_type <> 'error'").select("kit_id", "event_id", "url", "at"), navs, log, "kit_id", "at", "event_id").select("kit_id", "event_id", "seq", "found_by")


@query("stage_manifest", _STAGES + """
    , resp as (select kit_id, url, arg_max(event_id, (ts, event_id)) as response, arg_max(cast(floor(value) as int), (ts, event_id)) as status from res group by all),
    ends as (select kit_id, max(ts) as last_ts from res group by 1)
    select n.kit_id, n.seq, n.url, n.seq = n.n - 1 as is_final, case when n.seq = 0 then 'initial' end as nav_method, r.response, r.status,
           case when n.seq = n.n - 1 then 'rendered' when r.response is not null then 'response' else 'none' end as body,
           greatest(n.ts, coalesce(lead(n.ts) over (partition by n.kit_id order by n.seq), e.last_ts, n.ts)) as ended_at
    from navs n left join resp r on r.kit_id = n.kit_id and r.url = n.url left join ends e on e.kit_id = n.kit_id""")
def stage_manifest(spark, sf_dir):
    """Navigations as ordered stages: end by the next start, last response of the address, the rendered page for the last stage."""
    navs, res = _stages(spark, sf_dir)
    out = flow.manifest(navs, res.withColumn("status", F.floor("value").cast("int")), "kit_id", "at", "event_id")
    return out.withColumn("ended_at", F.timestamp_micros("ended").cast("timestamp_ntz")).drop("event_id", "started", "ended")


@query("hop_manifest", """
    with h as (select user_id as kit_id, event_id, props as url, cast(300 + floor(value) as int) as status, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, count(*) over (partition by user_id) as n
               from events where event_type = 'click' and user_id is not null), r as (select *, lead(status, -1) over (partition by kit_id order by seq) as before from h)
    select kit_id, cast(seq as int) as seq, url, case when seq = 0 then 'initial' when status between 300 and 399 then 'http_3xx' else 'js_location' end as nav_method, status, false as terminal from h
    union all
    select kit_id, cast(n as int), url, case when status between 300 and 399 then 'http_3xx' else 'js_location' end, 200, true from h where seq = n - 1""")
def hop_manifest(spark, sf_dir):
    """Redirect hops as stages: one for each hop and the terminal one, by how each was reached."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click' and user_id is not null")
    hops = e.select(F.col("user_id").alias("kit_id"), "event_id", F.col("props").alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (300 + F.floor("value")).cast("int").alias("status"))
    return flow.hop_stages(hops, "kit_id", "at", "event_id").select("kit_id", "seq", "url", "nav_method", "status", "terminal")


# Repeated kits --------------------------------------------------------------------------------------


@query("repeated_kits", """
    with recursive k as (
      select o_orderkey as kit_id, case when o_orderkey >= 10 then o_orderkey // 10 end as parent, o_custkey % 20 as inv, o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') as rendered,
             o_orderpriority || '/' || floor(o_totalprice)::bigint % 40 as url, case when floor(o_totalprice)::bigint % 7 > 0 then cast(floor(o_totalprice)::bigint % 5000 as varchar) end as sha,
             case when floor(o_totalprice)::bigint % 3 > 0 then floor(o_totalprice)::bigint end as digest, o_orderdate as created from orders
    ), up as (
      select kit_id, parent as at, 1 as depth from k where rendered and parent is not null
      union all select u.kit_id, k.parent, depth + 1 from up u join k on k.kit_id = u.at where k.parent is not null and depth < 5
    ), a as (
      select c.kit_id, o.kit_id as matched, depth, case when o.rendered and o.url = c.url then 'url' when abs(c.digest - o.digest) <= 30 then 'digest' when c.sha = o.sha then 'sha256' end as via
      from up join k c on c.kit_id = up.kit_id join k o on o.kit_id = up.at
    ), anc as (select kit_id, arg_min(matched, depth) as matched, arg_min(via, depth) as via, min(depth) as depth from a where via is not null group by 1),
    rest as (select * from k where rendered and kit_id not in (select kit_id from anc)),
    s as (
      select c.kit_id, o.kit_id as matched, case when abs(c.digest - o.digest) <= 30 then 'digest' when c.sha = o.sha then 'sha256' end as via, row_number() over (partition by c.kit_id order by o.created, o.kit_id) as r
      from rest c join k o on o.parent = c.parent and o.kit_id <> c.kit_id and o.rendered where abs(c.digest - o.digest) <= 30 or c.sha = o.sha
    ), sib as (select kit_id, matched, via from s where r = 1),
    x as (
      select c.kit_id, o.kit_id as matched, row_number() over (partition by c.kit_id order by o.inv is distinct from c.inv, o.created, o.kit_id) as r
      from rest c join k o on o.sha = c.sha and o.kit_id <> c.kit_id where c.kit_id not in (select kit_id from sib)
    ), f as (
      select kit_id, matched, 'ancestor' as relation, via, depth from anc union all select kit_id, matched, 'sibling', via, null from sib union all select kit_id, matched, 'content', 'sha256', null from x where r = 1
    )
    select f.kit_id, matched, relation, via, cast(depth as int) as depth, case when p.inv is distinct from q.inv then 'correlated' when relation = 'ancestor' then 'stuck_at_gate' else 'duplicate' end as verdict
    from f join k p on p.kit_id = f.kit_id join k q on q.kit_id = f.matched""")
def repeated_kits(spark, sf_dir):
    """Which rendered kits repeat an ancestor, a sibling or another kit, and what follows. Sizes stand for digests and, by remainder, for contents and addresses."""
    o, size = table(spark, sf_dir, "orders"), F.floor("o_totalprice").cast("long")
    kits = o.select(
        F.col("o_orderkey").alias("kit_id"), F.when(F.col("o_orderkey") >= 10, F.expr("o_orderkey div 10")).alias("parent_kit_id"), (F.col("o_custkey") % 20).alias("investigation_id"),
        F.concat("o_orderpriority", F.lit("/"), (size % 40).cast("string")).alias("url"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM").alias("rendered"),
        F.when(size % 7 > 0, (size % 5000).cast("string")).alias("sha"), F.when(size % 3 > 0, size).alias("digest"), F.col("o_orderdate").alias("created_at"),
    )
    return decide(kits, number_closeness(30))


# Expansion ------------------------------------------------------------------------------------------

BUDGET, LEVELS = 2000, 4


def _expansion_sql() -> str:
    columns = "inv, key, url, parent_url, depth, source, rank"
    parts = ["""
    l as (
      select distinct 'http://k.example/' || o_orderkey // 10 as url, 'http://k.example/' || o_orderkey as target, case when o_orderkey % 3 > 0 then 1 else 2 end as kind, o_orderkey % 10 as position from orders where o_orderkey >= 10
      union all select 'http://k.example/' || o_orderkey, 'http://K.example/' || (o_orderkey // 2 + 1) || '/', 3, 0 from orders
    ), once as (select url, target, min(struct_pack(kind := kind, position := position)) as o from l where target <> url group by all),
    f as (select url, target, ['redirect', 'eml_link', 'qr_code'][o.kind] as source, rank from (select *, row_number() over (partition by url order by o, target) as rank from once) where rank <= 10),
    s0 as (select o_orderkey % 3 as inv, 'http://k.example/' || o_orderkey as key, 'http://k.example/' || o_orderkey as url, null as parent_url, 0 as depth, null as source, null as rank from orders where o_orderkey < 10)"""]  # fmt: skip
    for d in range(1, LEVELS + 1):
        parts.append(f"""
    m{d} as (
      select inv, key, min(struct_pack(parent_url := p.url, rank := f.rank, target := f.target, source := f.source)) as m
      from (select inv, url from s{d - 1} where depth = {d - 1}) p join f using (url), lateral (select lower(rtrim(f.target, '/')) as key) group by inv, key
    ), n{d} as (
      select inv, key, m, row_number() over (partition by inv order by m.parent_url, m.rank, key) as place from m{d} anti join s{d - 1} using (inv, key)
    ), s{d} as (
      select * from s{d - 1} union all
      select n.inv, key, m.target, m.parent_url, {d}, m.source, m.rank from n{d} n join (select inv, count(*) as used from s{d - 1} group by inv) u using (inv) where place + used <= {BUDGET}
    )""")
    return "with " + ",".join(parts) + f" select inv as investigation_id, url, parent_url, cast(depth as int) as depth, source, cast(rank as int) as rank from (select {columns} from s{LEVELS})"


@query("frontier_expansion", _expansion_sql())
def frontier_expansion(spark, sf_dir):
    """Pages reached from three investigations' roots along links of the tree and across it, with a budget each."""
    key, url = F.col("o_orderkey"), lambda k, host="k", end="": F.concat(F.lit(f"http://{host}.example/"), k.cast("string"), F.lit(end))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    down = o.filter("o_orderkey >= 10").select(url(F.expr("o_orderkey div 10")).alias("url"), url(key).alias("target"), F.when(key % 3 > 0, "redirect").otherwise("eml_link").alias("source"), (key % 10).alias("position"))
    across = o.select(url(key).alias("url"), url(F.expr("o_orderkey div 2 + 1"), "K", "/").alias("target"), F.lit("qr_code").alias("source"), F.lit(0).alias("position"))
    roots = o.filter("o_orderkey < 10").select((key % 3).alias("investigation_id"), url(key).alias("url"))
    return expand(roots, down.unionByName(across), LEVELS, 10, BUDGET)
