"""Lists, look-ups, junction joins, roll-ups and mutations of the model, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lurescope.functions import text as tx
from lurescope.functions import urls
from lurescope.operators import relational as rel
from lurescope.operators import scoring, stages
from lurescope.plans.catalog import query
from lurescope.sources import model
from lurescope.sources.model import with_views
from lurescope.sources.tables import table

CAMPAIGN, ACTOR, FAMILY, KIT = 7, 3, "Brand#11", 7


# Lists and look-ups -------------------------------------------------------------------------------


@query("newest_root_per_source", with_views("kits") + """
    select investigation_id, source_feed, kit_id, created_at from (select *, row_number() over (partition by investigation_id, source_feed order by created_at desc, kit_id desc) as r
      from kits where parent_kit_id is null or kit_id >= 100 and status <> 'pending') where r = 1""")
def newest_root_per_source(spark, sf_dir):
    """The newest kit that did not fail, for each exact source: one aggregate, no window."""
    k = model.kits(spark, sf_dir).filter("parent_kit_id is null or kit_id >= 100 and status <> 'pending'")
    best = k.groupBy("investigation_id", "source_feed").agg(F.max(F.struct("created_at", "kit_id")).alias("x"))
    return best.select("investigation_id", "source_feed", "x.kit_id", "x.created_at")


@query("kits_search_columns", "select o_orderkey as kit_id from orders where o_orderpriority ilike '%gent%' or o_orderstatus ilike '%gent%' or cast(o_orderdate as varchar) ilike '%1995-03-1%' or cast(o_orderkey as varchar) ilike '%77%'")
def kits_search_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"day": F.date_format("o_orderdate", "yyyy-MM-dd"), "key": F.col("o_orderkey").cast("string")})
    found = rel.ilike_any("gent", "o_orderpriority", "o_orderstatus") | rel.ilike_any("1995-03-1", "day") | rel.ilike_any("77", "key")
    return o.filter(found).select(F.col("o_orderkey").alias("kit_id"))


@query("indicators_of_kit", with_views("indicators") + f" select kit_id, line, type, value, confidence from indicators where kit_id = {KIT} and type in ('N', 'R', 'A') order by line limit 50")
def indicators_of_kit(spark, sf_dir):
    found = model.indicators(spark, sf_dir).filter(f"kit_id = {KIT} and type in ('N', 'R', 'A')").select("kit_id", "line", "type", "value", "confidence")
    return rel.page(found, ["line"])


@query("indicator_by_key", with_views("indicators") + f" select * from indicators where kit_id = {KIT} and line = 1")
def indicator_by_key(spark, sf_dir):
    return model.indicators(spark, sf_dir).filter(f"kit_id = {KIT} and line = 1")


@query("victim_by_key", with_views("victims") + " select * from victims where victim_id = 11")
def victim_by_key(spark, sf_dir):
    return model.victims(spark, sf_dir).filter("victim_id = 11")


@query("campaigns_list", with_views("campaigns") + " select campaign_id, target_brand from campaigns where target_brand ilike '%brand#1%' and not auto_generated order by target_brand, campaign_id limit 50")
def campaigns_list(spark, sf_dir):
    found = model.campaigns(spark, sf_dir).filter(rel.ilike_any("brand#1", "target_brand") & ~F.col("auto_generated"))
    return rel.page(found.select("campaign_id", "target_brand"), ["target_brand", "campaign_id"])


@query("actors_list", with_views("actor_details") + " select actor_id, name from actor_details where not auto_generated order by name, actor_id limit 50")
def actors_list(spark, sf_dir):
    return rel.page(model.actor_details(spark, sf_dir).filter("not auto_generated").select("actor_id", "name"), ["name", "actor_id"])


@query("families_newest", with_views("family_kits", "kits") + " select family, max(created_at) as newest from family_kits join kits using (kit_id) group by 1 order by newest desc, family limit 50")
def families_newest(spark, sf_dir):
    newest = model.family_kits(spark, sf_dir).join(model.kits(spark, sf_dir), "kit_id").groupBy("family").agg(F.max("created_at").alias("newest"))
    return rel.page(newest, [F.desc("newest"), "family"])


@query("results_of_kit", with_views("results") + " select event_id, kit_id, analysis_type, created_at from results where kit_id = 11 and analysis_type = 'error' order by created_at desc, event_id limit 50")
def results_of_kit(spark, sf_dir):
    found = model.results(spark, sf_dir).filter("kit_id = 11 and analysis_type = 'error'").select("event_id", "kit_id", "analysis_type", "created_at")
    return rel.page(found, [F.desc("created_at"), "event_id"])


@query("investigations_page", with_views("kits") + """
    select investigation_id, count(*) as kits, min(created_at) as opened from kits group by 1 order by opened desc, investigation_id limit 50 offset 10""")
def investigations_page(spark, sf_dir):
    opened = model.kits(spark, sf_dir).groupBy("investigation_id").agg(F.count(F.lit(1)).alias("kits"), F.min("created_at").alias("opened"))
    return rel.page(opened, [F.desc("opened"), "investigation_id"], 10)


@query("allowlist_page", "select n_nationkey as id, n_name as domain from nation order by domain limit 200")
def allowlist_page(spark, sf_dir):
    return rel.page(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("domain")), ["domain"], 0, 200)


@query("actors_search", with_views("actor_details") + " select actor_id, name from actor_details where name ilike '%000000001%' or list_contains(handles, '@h3') order by actor_id limit 50")
def actors_search(spark, sf_dir):
    found = model.actor_details(spark, sf_dir).filter(rel.ilike_any("000000001", "name") | F.array_contains("handles", "@h3"))
    return rel.page(found.select("actor_id", "name"), ["actor_id"])


_USERS = "users as (select s_suppkey as user_id, case s_nationkey % 3 when 0 then 'admin' when 1 then 'analyst' else 'viewer' end as role, case when s_nationkey % 5 = 0 then 'viewer' end as role_override, s_acctbal < 0 as disabled, s_acctbal as last_login from supplier)"


def _users(spark, sf_dir):
    n, s = F.col("s_nationkey"), table(spark, sf_dir, "supplier")
    role = F.when(n % 3 == 0, "admin").when(n % 3 == 1, "analyst").otherwise("viewer")
    return s.select(F.col("s_suppkey").alias("user_id"), role.alias("role"), F.when(n % 5 == 0, "viewer").alias("role_override"), (F.col("s_acctbal") < 0).alias("disabled"), F.col("s_acctbal").alias("last_login"))


@query("users_list", f"with {_USERS} select user_id, role, last_login from users where role = 'analyst' and disabled order by last_login desc nulls last, user_id limit 50")
def users_list(spark, sf_dir):
    return rel.page(_users(spark, sf_dir).filter("role = 'analyst' and disabled").select("user_id", "role", "last_login"), [F.desc_nulls_last("last_login"), "user_id"])


@query("users_effective_role", f"with {_USERS} select coalesce(role_override, role) as effective_role, disabled, count(*) as n from users group by all")
def users_effective_role(spark, sf_dir):
    return _users(spark, sf_dir).groupBy(F.coalesce("role_override", "role").alias("effective_role"), "disabled").agg(F.count(F.lit(1)).alias("n"))


_MONITORED = ("example.com", "example.net", "blog.ththon.example.net", "example.org.uk")


@query("allowlist_suffix_match", f"""
    with m as (select unnest([{', '.join(f"'{d}'" for d in _MONITORED)}]) as monitored), p as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host from pages)
    select page_id, host, count(*) as matches from p join m on host = monitored or host like '%.' || monitored group by all""")
def allowlist_suffix_match(spark, sf_dir):
    """A suffix match as an equality join on exploded suffixes."""
    m = spark.createDataFrame([(d,) for d in _MONITORED], "monitored string")
    p = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    hit = p.withColumn("monitored", F.explode(rel.domain_suffixes(F.col("host")))).join(F.broadcast(m), "monitored")
    return hit.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("matches"))


@query("email_split", """
    with e as (select doc_id, trim(lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')))) as email from documents)
    select distinct email, string_split(email, '@')[1] as mailbox, string_split(email, '@')[2] as domain,
      regexp_matches(string_split(email, '@')[1], '^(?:no-?reply|do-?not-?reply|admin|support|info|postmaster|webmaster|abuse)$') as service from e where len(string_split(email, '@')) = 2 and contains(string_split(email, '@')[2], '.')""")
def email_split(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(tx.all_matches(F.col("text"), tx.EMAIL)).alias("email")).select(F.trim(F.lower("email")).alias("email"))
    return rel.split_email(found, "email").distinct()


@query("campaign_with_members", with_views("campaign_kits", "kit_actors") + """
    select campaign_id, array_to_string(list_transform(list_sort(list(distinct actor_id)), lambda x: cast(x as varchar)), ',') as actors from campaign_kits join kit_actors using (kit_id) group by 1""")
def campaign_with_members(spark, sf_dir):
    members = model.campaign_kits(spark, sf_dir).join(model.kit_actors(spark, sf_dir), "kit_id").select("campaign_id", "actor_id").distinct()
    return members.groupBy("campaign_id").agg(F.array_join(F.array_sort(F.collect_list("actor_id")).cast("array<string>"), ",").alias("actors"))


@query("js_loader_pages", "select page_id, contains(lower(html), '<form') as has_form, contains(lower(html), 'password') as has_password, contains(lower(html), '<script') and not contains(lower(html), '<form') as loader from pages")
def js_loader_pages(spark, sf_dir):
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", low.contains("<form").alias("has_form"), low.contains("password").alias("has_password"), (low.contains("<script") & ~low.contains("<form")).alias("loader"))


@query("html_sniff", r"select page_id, regexp_matches(lower(substr(html, 1, 512)), '^\s*(?:<!doctype html|<html|<head|<body)') as is_html from pages union all select -1 - doc_id, regexp_matches(lower(substr(text, 1, 512)), '^\s*(?:<!doctype html|<html|<head|<body)') from documents")
def html_sniff(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", tx.looks_like_html(F.col("html")).alias("is_html"))
    return p.unionAll(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("page_id"), tx.looks_like_html(F.col("text")).alias("is_html")))


# Junction joins ------------------------------------------------------------------------------------


def _paged(name: str, junction: str, key: str, value) -> None:
    shown = f"'{value}'" if isinstance(value, str) else value

    @query(f"{name}_kits", with_views(junction, "kits") + f" select kit_id, created_at, status from kits join {junction} using (kit_id) where {key} = {shown} and status = 'analyzed' order by created_at desc, kit_id limit 50")
    def kits_of(spark, sf_dir):
        linked = getattr(model, junction)(spark, sf_dir).filter(F.col(key) == value)
        found = rel.through(model.kits(spark, sf_dir).filter("status = 'analyzed'"), linked, "kit_id")
        return rel.page(found.select("kit_id", "created_at", "status"), [F.desc("created_at"), "kit_id"])


_paged("campaign", "campaign_kits", "campaign_id", CAMPAIGN)
_paged("actor", "kit_actors", "actor_id", ACTOR)
_paged("family", "family_kits", "family", FAMILY)


@query("family_indicators", with_views("indicators", "family_kits") + f" select kit_id, line, type, value, confidence from indicators join family_kits using (kit_id) where family = '{FAMILY}' order by confidence desc, kit_id, line limit 50")
def family_indicators(spark, sf_dir):
    linked = model.family_kits(spark, sf_dir).filter(F.col("family") == FAMILY)
    found = rel.through(model.indicators(spark, sf_dir), linked, "kit_id").select("kit_id", "line", "type", "value", "confidence")
    return rel.page(found, [F.desc("confidence"), "kit_id", "line"])


@query("actor_indicators", with_views("indicators") + f" select kit_id, line, type, value, confidence from indicators where actor_id = {ACTOR} order by confidence desc, kit_id, line limit 50")
def actor_indicators(spark, sf_dir):
    found = model.indicators(spark, sf_dir).filter(F.col("actor_id") == ACTOR).select("kit_id", "line", "type", "value", "confidence")
    return rel.page(found, [F.desc("confidence"), "kit_id", "line"])


@query("campaign_actors", with_views("campaign_kits", "kit_actors", "actors") + f" select distinct actor_id, name from campaign_kits join kit_actors using (kit_id) join actors using (actor_id) where campaign_id = {CAMPAIGN}")
def campaign_actors(spark, sf_dir):
    members = model.campaign_kits(spark, sf_dir).filter(F.col("campaign_id") == CAMPAIGN).join(model.kit_actors(spark, sf_dir), "kit_id")
    return model.actors(spark, sf_dir).join(members, "actor_id", "left_semi").select("actor_id", "name")


@query("actor_campaigns", with_views("campaign_kits", "kit_actors") + " select distinct actor_id, campaign_id from kit_actors join campaign_kits using (kit_id)")
def actor_campaigns(spark, sf_dir):
    return rel.sharing(model.kit_actors(spark, sf_dir), model.campaign_kits(spark, sf_dir), "kit_id", "actor_id", "campaign_id")


@query("actor_families", with_views("family_kits", "kit_actors") + " select distinct actor_id, family from kit_actors join family_kits using (kit_id)")
def actor_families(spark, sf_dir):
    return rel.sharing(model.kit_actors(spark, sf_dir), model.family_kits(spark, sf_dir), "kit_id", "actor_id", "family")


@query("family_actors", with_views("family_kits", "kit_actors", "actors") + f" select distinct actor_id, name from family_kits join kit_actors using (kit_id) join actors using (actor_id) where family = '{FAMILY}'")
def family_actors(spark, sf_dir):
    members = model.family_kits(spark, sf_dir).filter(F.col("family") == FAMILY).join(model.kit_actors(spark, sf_dir), "kit_id")
    return model.actors(spark, sf_dir).join(members, "actor_id", "left_semi").select("actor_id", "name")


@query("linked_actors_of_tree", with_views("kits", "indicators", "actors").replace("with ", "with recursive ", 1) + """
    , tree as (select kit_id from kits where kit_id = 3 union all select k.kit_id from tree t join kits k on k.parent_kit_id = t.kit_id)
    select distinct actor_id, name from actors join indicators using (actor_id) where kit_id in (select kit_id from tree)""")
def linked_actors_of_tree(spark, sf_dir):
    from lurescope.operators import graph

    k = model.kits(spark, sf_dir)
    tree = graph.descendants(k, k.filter("kit_id = 3"))
    hit = model.indicators(spark, sf_dir).join(tree, "kit_id", "left_semi")
    return model.actors(spark, sf_dir).join(hit, "actor_id", "left_semi").select("actor_id", "name")


@query("actor_recent_kits", with_views("kits", "indicators") + f" select distinct kit_id, created_at from kits join indicators using (kit_id) where actor_id = {ACTOR} order by created_at desc, kit_id limit 20")
def actor_recent_kits(spark, sf_dir):
    hit = model.indicators(spark, sf_dir).filter(F.col("actor_id") == ACTOR)
    return model.kits(spark, sf_dir).join(hit, "kit_id", "left_semi").select("kit_id", "created_at").orderBy(F.desc("created_at"), "kit_id").limit(20)


@query("stages_with_resources", with_views("stages") + """
    select kit_id, count(*) as stages, string_agg(cast(seq as varchar) || ':' || role || ':' || cast(length(body) as varchar), ',' order by seq, role) as nested from stages group by 1""")
def stages_with_resources(spark, sf_dir):
    shown = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", F.length("body").alias("n")))), lambda x: F.concat_ws(":", x["seq"].cast("string"), x["role"], x["n"].cast("string")))
    return model.stages(spark, sf_dir).groupBy("kit_id").agg(F.count(F.lit(1)).alias("stages"), F.array_join(shown, ",").alias("nested"))


@query("stages_of_investigation", with_views("stages", "kits") + """
    select investigation_id, kit_id, seq, role, length(cast(kit_id as varchar)) - 1 as chain_depth, row_number() over (partition by investigation_id order by length(cast(kit_id as varchar)), kit_id, seq) as place
    from stages join kits using (kit_id)""")
def stages_of_investigation(spark, sf_dir):
    depth = F.length(F.col("kit_id").cast("string"))
    linked = model.stages(spark, sf_dir).join(model.kits(spark, sf_dir).select("kit_id", "investigation_id"), "kit_id")
    place = F.row_number().over(Window.partitionBy("investigation_id").orderBy(depth, "kit_id", "seq"))
    return linked.select("investigation_id", "kit_id", "seq", "role", (depth - 1).alias("chain_depth"), place.alias("place"))


@query("correlated_actors", with_views("indicators", "kit_actors") + """
    , h as (select distinct kit_id, type, value from indicators where confidence >= 80 and type in ('R', 'A')),
    r as (select type, value, kit_id, row_number() over (partition by type, value order by kit_id) as r from h),
    p as (select distinct h.kit_id, r.kit_id as peer from h join r on h.type = r.type and h.value = r.value and h.kit_id <> r.kit_id where r <= 20)
    select p.kit_id, min(actor_id) as actor_id, count(distinct peer) as peers from p join kit_actors k on k.kit_id = p.peer group by 1""")
def correlated_actors(spark, sf_dir):
    """Kits that share a strong indicator, with at most 20 peers for each indicator, and the first actor of the peers."""
    strong = model.indicators(spark, sf_dir).filter("confidence >= 80 and type in ('R', 'A')").select("kit_id", "type", "value").distinct()
    peers = rel.top_per_key(strong, ["type", "value"], 20, F.asc("kit_id")).withColumnRenamed("kit_id", "peer")
    pairs = strong.join(peers, ["type", "value"]).filter("kit_id <> peer").select("kit_id", "peer").distinct()
    linked = pairs.join(model.kit_actors(spark, sf_dir).withColumnRenamed("kit_id", "peer"), "peer")
    return linked.groupBy("kit_id").agg(F.min("actor_id").alias("actor_id"), F.countDistinct("peer").alias("peers"))


@query("canonical_same_source", """
    with d as (select doc_id, source, sha256(text) as sha from documents), f as (select *, min(doc_id) over (partition by sha) as any_first, min(doc_id) over (partition by sha, source) as own_first, count(*) over (partition by sha) as n, count(*) over (partition by sha, source) as n_own from d)
    select doc_id, case when n_own > 1 then own_first else any_first end as canonical from f where n > 1""")
def canonical_same_source(spark, sf_dir):
    """The first equal document, one of the same source before others; by aggregates, so hot texts are combined early."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    own = d.groupBy("sha", "source").agg(F.min("doc_id").alias("own_first"), F.count(F.lit(1)).alias("n_own"))
    every = own.groupBy("sha").agg(F.min("own_first").alias("any_first"), F.sum("n_own").alias("n")).filter("n > 1")
    named = own.join(every, "sha").withColumn("canonical", F.when(F.col("n_own") > 1, F.col("own_first")).otherwise(F.col("any_first"))).withColumnRenamed("source", "s").withColumnRenamed("sha", "k")
    return d.join(named, (d["sha"] == F.col("k")) & d["source"].eqNullSafe(F.col("s"))).select("doc_id", "canonical")


@query("kit_siblings", with_views("kits") + " select a.kit_id, count(*) as siblings, min(b.kit_id) as first_sibling from kits a join kits b on a.parent_kit_id = b.parent_kit_id and a.kit_id <> b.kit_id group by 1")
def kit_siblings(spark, sf_dir):
    """Siblings need no self-join: a parent's children are counted, and the two smallest tell the first that is another one."""
    k = model.kits(spark, sf_dir).filter("parent_kit_id is not null").select("kit_id", "parent_kit_id")
    own = k.groupBy("parent_kit_id").agg(F.count(F.lit(1)).alias("n"), F.min("kit_id").alias("a")).filter("n > 1")
    second = k.join(own, "parent_kit_id").filter("kit_id > a").groupBy("parent_kit_id").agg(F.min("kit_id").alias("b"))
    own = own.join(second, "parent_kit_id")
    first = F.when(F.col("kit_id") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return k.join(own, "parent_kit_id").select("kit_id", (F.col("n") - 1).alias("siblings"), first.alias("first_sibling"))


# Roll-ups ------------------------------------------------------------------------------------------


def _rules(scope: str, junction: str, key: str):
    @query(f"{scope}_rule_counts", with_views("results", junction) + f"""
        select {key}, cast(json_extract(result_data, '$.k') as bigint) as rule, count(distinct kit_id) as kits from results join {junction} using (kit_id) group by all""")
    def rule_counts(spark, sf_dir):
        hits = model.results(spark, sf_dir).select("kit_id", F.from_json("result_data", "k bigint")["k"].alias("rule")).distinct()
        return hits.join(getattr(model, junction)(spark, sf_dir), "kit_id").groupBy(key, "rule").agg(F.count(F.lit(1)).alias("kits"))


_rules("campaign", "campaign_kits", "campaign_id")
_rules("family", "family_kits", "family")


@query("rule_rollup", with_views("results") + """
    select kit_id, cast(json_extract(result_data, '$.k') as bigint) % 10 as rule, array_to_string(list_sort(list(distinct analysis_type)), ',') as files, count(*) as matches from results group by all""")
def rule_rollup(spark, sf_dir):
    r = model.results(spark, sf_dir).select("kit_id", (F.from_json("result_data", "k bigint")["k"] % 10).alias("rule"), "analysis_type")
    return r.groupBy("kit_id", "rule").agg(F.array_join(F.array_sort(F.collect_set("analysis_type")), ",").alias("files"), F.count(F.lit(1)).alias("matches"))


@query("actor_metadata", with_views("indicators", "kits") + """
    select actor_id, count(distinct value) filter (type = 'R') as emails, count(distinct value) filter (type = 'A') as handles, strftime(min(created_at), '%Y-%m-%d') as first_kit, strftime(max(created_at), '%Y-%m-%d') as last_kit
    from indicators join kits using (kit_id) group by 1""")
def actor_metadata(spark, sf_dir):
    linked = model.indicators(spark, sf_dir).join(model.kits(spark, sf_dir).select("kit_id", "created_at"), "kit_id")
    of = lambda kind: F.countDistinct(F.when(F.col("type") == kind, F.col("value")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return linked.groupBy("actor_id").agg(of("R").alias("emails"), of("A").alias("handles"), day(F.min("created_at")).alias("first_kit"), day(F.max("created_at")).alias("last_kit"))


@query("family_polymorphism", with_views("family_kits", "kits") + " select family, count(*) as kits, count(distinct file_size) as sizes, count(distinct investigation_id) as investigations, round(count(distinct file_size) / count(*), 3) as spread from family_kits join kits using (kit_id) group by 1")
def family_polymorphism(spark, sf_dir):
    li, kits = table(spark, sf_dir, "lineitem"), model.kits(spark, sf_dir).select("kit_id", "file_size", "investigation_id")
    lines = rel.dealt(li.select(F.col("l_orderkey").alias("kit_id"), F.col("l_partkey").alias("part")), "part")
    members = rel.dealt(lines.join(model.parts(spark, sf_dir).select("part", F.col("brand").alias("family")), "part").select("kit_id", "family"), "kit_id").distinct()
    linked = members.join(rel.dealt(kits, "kit_id"), "kit_id")
    counts = linked.groupBy("family").agg(F.count(F.lit(1)).alias("kits"))
    kinds = F.array(F.struct(F.lit(True).alias("size"), F.col("file_size").cast("long").alias("id")), F.struct(F.lit(False).alias("size"), F.col("investigation_id").cast("long").alias("id")))
    seen = linked.select(F.col("family").alias("_k"), F.explode(kinds).alias("_x")).filter("_x.id is not null").distinct()
    seen = seen.groupBy("_k").agg(F.count(F.when(F.col("_x.size"), 1)).alias("sizes"), F.count(F.when(~F.col("_x.size"), 1)).alias("investigations"))
    out = counts.join(seen, F.col("family").eqNullSafe(F.col("_k")), "left").drop("_k").fillna(0, ["sizes", "investigations"])
    return out.withColumn("spread", F.round(F.col("sizes") / F.col("kits"), 3))


@query("last_event_or_zero", with_views("kits", "results") + " select k.kit_id, coalesce(max(epoch_us(r.created_at)), 0) as last_us from kits k left join results r on r.kit_id = k.kit_id group by 1")
def last_event_or_zero(spark, sf_dir):
    last = model.results(spark, sf_dir).groupBy("kit_id").agg(F.max(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("last_us"))
    return model.kits(spark, sf_dir).select("kit_id").join(last, "kit_id", "left").fillna(0, ["last_us"])


@query("count_by_patterns", with_views("indicators") + " select count(*) as n from indicators where type = 'R' and (value like '1%' or value like '%77%' or value like '%9')")
def count_by_patterns(spark, sf_dir):
    v = F.col("value")
    return model.indicators(spark, sf_dir).filter((F.col("type") == "R") & (v.like("1%") | v.like("%77%") | v.like("%9"))).agg(F.count(F.lit(1)).alias("n"))


@query("phone_cleanup_count", r"select count(*) as n from customer where length(regexp_replace(c_name || ' (' || cast(c_acctbal as varchar), '[^0-9]', '', 'g')) not between 9 and 13 or regexp_matches(c_name, '\)[^(]')")
def phone_cleanup_count(spark, sf_dir):
    digits = F.length(F.regexp_replace(F.concat("c_name", F.lit(" ("), F.col("c_acctbal").cast("string")), "[^0-9]", ""))
    return table(spark, sf_dir, "customer").filter(~digits.between(9, 13) | F.col("c_name").rlike(r"\)[^(]")).agg(F.count(F.lit(1)).alias("n"))


# Windows and orders --------------------------------------------------------------------------------


@query("host_path", with_views("results") + """
    , p as (select *, lag(analysis_type) over (partition by kit_id order by created_at, event_id) as before from results)
    select kit_id, string_agg(analysis_type, '>' order by created_at, event_id) as path from p where before is null or before <> analysis_type group by 1 having count(*) >= 2""")
def host_path(spark, sf_dir):
    runs = rel.collapse_runs(model.results(spark, sf_dir), "kit_id", ["created_at", "event_id"], "analysis_type")
    return runs.filter(F.size("tokens") >= 2).select("kit_id", F.array_join("tokens", ">").alias("path"))


@query("best_peer", with_views("indicators") + """
    , k as (select distinct kit_id, type, value, case type when 'R' then 30 when 'A' then 15 else 8 end as weight from indicators),
    p as (select a.kit_id as a, b.kit_id as b, least(40, cast(sum(a.weight) as bigint)) as score from k a join k b on a.type = b.type and a.value = b.value and a.kit_id <> b.kit_id group by all)
    select a as kit_id, b as peer, score from (select *, row_number() over (partition by a order by score desc, b) as r from p) where r = 1""")
def best_peer(spark, sf_dir):
    """The best peer of each kit, in slices of kits."""
    return scoring.best_peers(model.indicators(spark, sf_dir), {"R": 30, "A": 15}, 8)


@query("first_known_actor", with_views("indicators") + """
    select type, value, first(actor_id order by confidence desc, kit_id, line) filter (confidence >= 50) as actor_id from (select * from indicators) group by all""")
def first_known_actor(spark, sf_dir):
    """The actor of the strongest match, null where none is sure."""
    sure = F.when(F.col("confidence") >= 50, F.struct(-F.col("confidence"), F.col("kit_id"), F.col("line"), F.col("actor_id")))
    best = model.indicators(spark, sf_dir).groupBy("type", "value").agg(F.min(sure).alias("x"))
    return best.select("type", "value", F.col("x.actor_id").alias("actor_id"))


@query("url_dedup", "select lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as normal, min(page_id) as first_page, count(*) as n from pages group by 1")
def url_dedup(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.normalized(F.col("url")).alias("normal")).agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))


@query("last_two_labels_count", "select array_to_string(l[-2:], '.') as domain, count(*) as n from (select string_split(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.') as l from pages) group by 1")
def last_two_labels_count(spark, sf_dir):
    return rel.count_by(table(spark, sf_dir, "pages").select(urls.last_two_labels(F.col("url")).alias("domain")), "domain")


@query("children_by_depth", with_views("kits") + " select investigation_id, kit_id, row_number() over (partition by investigation_id order by length(cast(kit_id as varchar)), created_at, kit_id) as place from kits")
def children_by_depth(spark, sf_dir):
    order = Window.partitionBy("investigation_id").orderBy(F.length(F.col("kit_id").cast("string")), "created_at", "kit_id")
    return model.kits(spark, sf_dir).select("investigation_id", "kit_id", F.row_number().over(order).alias("place"))


@query("ranked_neighbours", """
    with b as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as s from embeddings),
    p as (select a.vec_id as a, b.vec_id as b, cast(list_sum(list_transform(range(1, 65), lambda i: abs(a.s[i] - b.s[i]))) as integer) as distance from b a join b on a.vec_id <> b.vec_id)
    select a, b, distance, place from (select *, row_number() over (partition by a order by distance, b) as place from p where distance <= 18) where place <= 10""")
def ranked_neighbours(spark, sf_dir):
    """Stored neighbours, nearest first, ten at most shown."""
    from lurescope.operators.similarity import hamming_pairs

    near = hamming_pairs(model.perceptual_hashes(spark, sf_dir), "vec_id", "phash", 18)
    # Both ways from one row: a union would find all pairs twice.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")
    both = near.select("distance", ways).select("w.a", "w.b", "distance")
    place = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return both.withColumn("place", place).filter("place <= 10")


@query("cluster_sizes", with_views("stages") + " select role, count(*) as n, count(distinct kit_id) as kits from stages group by 1 order by n desc, role")
def cluster_sizes(spark, sf_dir):
    out = model.stages(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kit_id").alias("kits"))
    return out.orderBy(F.desc("n"), "role")


@query("next_children", with_views("kits") + """
    select parent_kit_id, kit_id, place from (select parent_kit_id, kit_id, row_number() over (partition by parent_kit_id order by case source_feed when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, kit_id) as place
      from kits where parent_kit_id is not null) where place <= 10""")
def next_children(spark, sf_dir):
    """Candidates by the order of their sources, ten for each parent."""
    first = F.when(F.col("source_feed") == "1-URGENT", 0).when(F.col("source_feed") == "2-HIGH", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("parent_kit_id").orderBy(first, "kit_id"))
    return model.kits(spark, sf_dir).filter("parent_kit_id is not null").select("parent_kit_id", "kit_id", place.alias("place")).filter("place <= 10")


# Sets and points -----------------------------------------------------------------------------------


@query("shared_sets", with_views("kit_actors", "campaign_kits") + """
    , c as (select campaign_id, list(distinct actor_id) as who from campaign_kits join kit_actors using (kit_id) group by 1)
    select a.campaign_id as a, b.campaign_id as b, len(list_intersect(a.who, b.who)) as shared, round(len(list_intersect(a.who, b.who)) / len(list_distinct(a.who || b.who)), 3) as jaccard,
      case when len(list_intersect(a.who, b.who)) / len(list_distinct(a.who || b.who)) >= 0.9 then 'same' when len(list_intersect(a.who, b.who)) / len(list_distinct(a.who || b.who)) >= 0.3 then 'similar' else 'different' end as verdict
    from c a join c b on a.campaign_id + 1 = b.campaign_id""")
def shared_sets(spark, sf_dir):
    own = model.campaign_kits(spark, sf_dir).join(model.kit_actors(spark, sf_dir), "kit_id").groupBy("campaign_id").agg(F.collect_set("actor_id").alias("who"))
    other = own.select((F.col("campaign_id") - 1).alias("campaign_id"), F.col("who").alias("they"))
    both = own.join(other, "campaign_id")
    score = rel.jaccard(F.col("who"), F.col("they"))
    return both.select(F.col("campaign_id").alias("a"), (F.col("campaign_id") + 1).alias("b"), F.size(F.array_intersect("who", "they")).alias("shared"), F.round(score, 3).alias("jaccard"), rel.set_verdict(score).alias("verdict"))


@query("merge_fields", """
    with c as (select n_nationkey as k, n_name as name, cast(n_regionkey as varchar) as region from nation where n_nationkey < 20),
    d as (select n_nationkey as k, case when n_nationkey % 2 = 0 then '  ' else upper(n_name) || '!' end as name, case when n_nationkey % 3 = 0 then null else 'r' end as region from nation where n_nationkey > 4)
    select coalesce(c.k, d.k) as k, coalesce(nullif(trim(d.name), ''), c.name) as name, coalesce(nullif(trim(d.region), ''), c.region) as region from c full join d on c.k = d.k""")
def merge_fields(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    changes = n.filter("k > 4").select("k", F.when(F.col("k") % 2 == 0, "  ").otherwise(F.concat(F.upper("name"), F.lit("!"))).alias("name"), F.when(F.col("k") % 3 != 0, "r").alias("region"))
    return rel.merge_fields(n.filter("k < 20"), changes, "k", ["name", "region"])


@query("endpoint_union", """
    with u as (select doc_id, unnest(regexp_extract_all(text, 'https?://[a-zA-Z0-9._/\\-]+')) as url from documents union all select page_id, url from pages)
    select doc_id, count(distinct url) as urls from u group by 1""")
def endpoint_union(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.all_matches(F.col("text"), r"https?://[a-zA-Z0-9._/\-]+")).alias("url"))
    return found.unionAll(table(spark, sf_dir, "pages").select("page_id", "url")).groupBy("doc_id").agg(F.countDistinct("url").alias("urls"))


@query("links_in_order", r"""select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as links from (select page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\shref="([^"]+)"', 1) as l from pages)""")
def links_in_order(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_distinct(tx.all_matches(F.col("html"), r'(?i)<a\b[^>]*?\shref="([^"]+)"', 1)), " ").alias("links"))


@query("script_sources", r"""select page_id, len(regexp_extract_all(html, '(?i)<script\b[^>]*?\s(?:src|href|xlink:href)="([^"]+)"', 1)) as scripts, len(regexp_extract_all(html, '(?i)<script\b')) as tags from pages""")
def script_sources(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(tx.all_matches(h, r'(?i)<script\b[^>]*?\s(?:src|href|xlink:href)="([^"]+)"', 1)).cast("long").alias("scripts"), F.size(tx.all_matches(h, r"(?i)<script\b")).cast("long").alias("tags"))


@query("duration_literals", "select d, case right(d, 1) when 's' then 1 when 'm' then 60 when 'h' then 3600 else 86400 end * cast(left(d, length(d) - 1) as bigint) as seconds from (select cast(n_nationkey + 1 as varchar) || case n_nationkey % 4 when 0 then 's' when 1 then 'm' when 2 then 'h' else 'd' end as d from nation)")
def duration_literals(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, "smhd")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "nation").select(F.concat((F.col("n_nationkey") + 1).cast("string"), unit).alias("d"))
    return d.select("d", rel.seconds_of(F.col("d")).alias("seconds"))


@query("kit_projection", with_views("kits") + " select kit_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created, status from kits")
def kit_projection(spark, sf_dir):
    return model.kits(spark, sf_dir).select("kit_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), "status")


@query("signal_points", """
    with d as (select cast(p_partkey % 200 as integer) as x, cast(p_partkey % 5 as integer) as n from part)
    select distinct x, n, case when x >= 150 then 0.0 when x <= 30 then 40.0 else 40 * (150 - x) / 120.0 end as tlsh, case when n <= 0 then 0.0 else 15 - 6 * power(0.5, n - 1) end as rules, 10 * least(1.0, n / 2.0) as hops,
      round(greatest(0.0, least(1.0, 1 - (x - 30) / 90.0)), 3) as alike, greatest(0.0, round(1 - n / 32.0, 3)) as picture from d""")
def signal_points(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") % 200).cast("int").alias("x"), (F.col("p_partkey") % 5).cast("int").alias("n")).distinct()
    x, n = F.col("x"), F.col("n")
    return d.select("x", "n", scoring.tlsh_points(x).alias("tlsh"), scoring.rule_points(n).alias("rules"), scoring.redirect_points(n).alias("hops"), stages.tlsh_signal(x).alias("alike"), stages.phash_signal(n).alias("picture"))


@query("stage_comparison", """
    with t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as w from conversations),
    p as (select a.conv_id, a.turn, case when len(list_distinct(a.w || b.w)) = 0 then null else round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 3) end as s, greatest(0.0, round(1 - (a.turn % 40) / 32.0, 3)) as g from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
    q as (select conv_id, turn, round((coalesce(s * 0.25, 0) + g * 0.1) / (case when s is null then 0 else 0.25 end + 0.1), 3) as score from p)
    select conv_id, turn, score, case when score >= 0.85 then 'same' when score >= 0.45 then 'similar' else 'different' end as verdict from q""")
def stage_comparison(spark, sf_dir):
    """Neighbouring stages by the signals that both have, renormalised."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(tx.all_matches(F.lower("text"), "[a-z]+")).alias("w"))
    both = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    score, verdict = stages.compare(None, {"script_set": stages.set_signal(F.col("w"), F.col("v")), "screenshot": stages.phash_signal(F.col("turn") % 40)})
    return both.select("conv_id", "turn", score.alias("score"), verdict.alias("verdict"))


# Trees and matrices --------------------------------------------------------------------------------


@query("kit_forest", with_views("kits") + """
    select k.kit_id, case when p.kit_id is null then null else k.parent_kit_id end as parent, k.parent_kit_id is not null and p.kit_id is null as orphan, (select count(*) from kits c where c.parent_kit_id = k.kit_id) as children from kits k left join kits p on p.kit_id = k.parent_kit_id""")
def kit_forest(spark, sf_dir):
    """Flat kits to nodes of a forest; kits whose parent is missing become roots."""
    k = model.kits(spark, sf_dir).select("kit_id", "parent_kit_id")
    known = k.select(F.col("kit_id").alias("p"))
    children = k.filter("parent_kit_id is not null").groupBy(F.col("parent_kit_id").alias("c")).agg(F.count(F.lit(1)).alias("children"))
    at = k.join(known, F.col("parent_kit_id") == F.col("p"), "left").join(children, F.col("kit_id") == F.col("c"), "left")
    return at.select("kit_id", F.when(F.col("p").isNotNull(), F.col("parent_kit_id")).alias("parent"), (F.col("parent_kit_id").isNotNull() & F.col("p").isNull()).alias("orphan"), F.coalesce("children", F.lit(0)).alias("children"))


@query("role_hosts", with_views("stages") + " select role, array_to_string(list_sort(list(distinct cast(kit_id % 50 as varchar))), ',') as hosts from stages group by 1")
def role_hosts(spark, sf_dir):
    return model.stages(spark, sf_dir).groupBy("role").agg(F.array_join(F.array_sort(F.collect_set((F.col("kit_id") % 50).cast("string"))), ",").alias("hosts"))


@query("cooccurrence_matrix", with_views("results") + """
    , d as (select distinct kit_id, analysis_type as t from results) select a.t as a, b.t as b, count(*) as investigations from d a join d b on a.kit_id = b.kit_id and a.t < b.t group by all""")
def cooccurrence_matrix(spark, sf_dir):
    """In how many investigations two kinds meet: pairs inside one small set for each investigation, no self-join."""
    own = model.results(spark, sf_dir).groupBy("kit_id").agg(F.array_sort(F.collect_set("analysis_type")).alias("kinds"))
    pairs = own.select(F.posexplode("kinds").alias("i", "a"), "kinds").select("a", F.explode(F.expr("slice(kinds, i + 2, size(kinds))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("investigations"))


# Mutations as new versions of a table --------------------------------------------------------------


@query("insert_new_kits", with_views("kits") + " select kit_id, investigation_id, status from kits where kit_id % 3 <> 0 union all select kit_id, investigation_id, status from kits k where kit_id % 3 = 0 and not exists (select 1 from kits o where o.kit_id % 3 <> 0 and o.investigation_id = k.investigation_id and o.parent_kit_id is null and o.status <> 'pending')")
def insert_new_kits(spark, sf_dir):
    """New kits but for those whose source a root kit that did not fail has already."""
    k = model.kits(spark, sf_dir)
    held = k.filter("kit_id % 3 <> 0")
    known = held.filter("parent_kit_id is null and status <> 'pending'")
    fresh = k.filter("kit_id % 3 = 0").join(known, "investigation_id", "left_anti")
    return held.unionByName(fresh.select(*held.columns)).select("kit_id", "investigation_id", "status")


@query("link_upsert", with_views("kit_actors") + " select kit_id, actor_id, max(note) as note from (select kit_id, actor_id, 'held' as note from kit_actors where actor_id % 2 = 0 union all select kit_id, actor_id, 'linked' from kit_actors where kit_id % 5 = 0) group by all")
def link_upsert(spark, sf_dir):
    """Idempotent links: a new link keeps its evidence over the held one."""
    a = model.kit_actors(spark, sf_dir)
    held, new = a.filter("actor_id % 2 = 0").withColumn("note", F.lit("held")), a.filter("kit_id % 5 = 0").withColumn("note", F.lit("linked"))
    return held.unionByName(new).groupBy("kit_id", "actor_id").agg(F.max("note").alias("note"))


@query("delete_tree", with_views("kits", "indicators").replace("with ", "with recursive ", 1) + """
    , tree as (select kit_id from kits where kit_id = 3 union all select k.kit_id from tree t join kits k on k.parent_kit_id = t.kit_id) select kit_id, line, type from indicators where kit_id not in (select kit_id from tree)""")
def delete_tree(spark, sf_dir):
    from lurescope.operators import graph

    k = model.kits(spark, sf_dir)
    return model.indicators(spark, sf_dir).join(graph.descendants(k, k.filter("kit_id = 3")), "kit_id", "left_anti").select("kit_id", "line", "type")


@query("delete_actor", with_views("indicators") + f" select kit_id, line, case when actor_id <> {ACTOR} then actor_id end as actor_id from indicators")
def delete_actor(spark, sf_dir):
    """Indicators of a deleted actor stay, without the actor."""
    return model.indicators(spark, sf_dir).select("kit_id", "line", F.when(F.col("actor_id") != ACTOR, F.col("actor_id")).alias("actor_id"))


@query("delete_by_patterns", with_views("indicators") + " select type, count(*) as kept from indicators where not (type = 'R' and (value like '1%' or regexp_matches(value, '7$')) or value in ('5', '50', '500')) group by 1")
def delete_by_patterns(spark, sf_dir):
    v: Column = F.col("value")
    gone = (F.col("type") == "R") & (v.like("1%") | v.rlike("7$")) | v.isin("5", "50", "500")
    return model.indicators(spark, sf_dir).filter(~gone).groupBy("type").agg(F.count(F.lit(1)).alias("kept"))


@query("edit_victims", with_views("victims") + " select victim_id, case when victim_id % 10 = 0 then 'watched' else domain end as kind, email from victims")
def edit_victims(spark, sf_dir):
    v = model.victims(spark, sf_dir).select("victim_id", F.col("domain").alias("kind"), "email")
    edits = v.filter("victim_id % 10 = 0").select("victim_id", F.lit("watched").alias("kind"), F.lit(None).cast("string").alias("email"))
    return rel.merge_fields(v, edits, "victim_id", ["kind", "email"])


# State over time -----------------------------------------------------------------------------------

_LATEST = "r as (select kit_id, analysis_type, created_at, row_number() over (partition by kit_id order by created_at desc, event_id desc) as n, max(created_at) over () as now from results)"


@query("stuck_kits", with_views("results") + f", {_LATEST} select kit_id, analysis_type, case when now - created_at > interval 60 minutes then 'fail' else 'resume' end as verdict from r where n = 1 and analysis_type in ('click', 'view') and now - created_at > interval 10 minutes")
def stuck_kits(spark, sf_dir):
    """Kits whose latest step is transient: resumed after 10 minutes, failed after 60, by event time."""
    r = model.results(spark, sf_dir)
    last = r.groupBy("kit_id").agg(F.max(F.struct("created_at", "event_id", "analysis_type")).alias("x")).select("kit_id", "x.*")
    now = r.agg(F.max("created_at").alias("now"))
    late = lambda minutes: F.col("now") - F.col("created_at") > F.expr(f"interval {minutes} minutes")
    return last.crossJoin(F.broadcast(now)).filter(F.col("analysis_type").isin("click", "view") & late(10)).select("kit_id", "analysis_type", F.when(late(60), "fail").otherwise("resume").alias("verdict"))


@query("progress_cursor", with_views("results") + """
    , s as (select *, list_position(['signup', 'view', 'click', 'purchase', 'error'], analysis_type) as step from results) select kit_id, max(step) as done, 5 - max(step) as left_over, count(distinct step) as seen from s group by 1""")
def progress_cursor(spark, sf_dir):
    """How far each kit's chain of steps came; a run resumes there."""
    step = F.array_position(F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error"))), F.col("analysis_type"))
    s = model.results(spark, sf_dir).select("kit_id", step.cast("int").alias("step"))
    return s.groupBy("kit_id").agg(F.max("step").alias("done"), (5 - F.max("step")).alias("left_over"), F.countDistinct("step").alias("seen"))


@query("duplicates_to_collect", """
    with d as (select doc_id, sha256(text) as sha, min(doc_id) over (partition by sha256(text)) as canonical from documents) select doc_id, canonical from d where doc_id <> canonical and doc_id - canonical >= 24""")
def duplicates_to_collect(spark, sf_dir):
    """Copies older than the grace period (here by distance of ids) that a canonical row replaces."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return d.join(first, "sha").filter("doc_id <> canonical and doc_id - canonical >= 24").select("doc_id", "canonical")


# Pages ---------------------------------------------------------------------------------------------

_HITS = {name: " + ".join(f"contains(h, '{m.lower()}')::int" for m in marks) for name, marks in tx.IDP_MARKS.items()}


@query("idp_shown", "with p as (select page_id, lower(url || chr(10) || html) as h from pages union all select -1 - doc_id, lower(coalesce(text, '') || ' login.microsoftonline.com ' || case when doc_id % 2 = 0 then 'convergedLogin GALX accounts.google.com gaia_loginform' else '' end) from documents), c as (select page_id, "
       + ", ".join(f"{hits} as {name}" for name, hits in _HITS.items())
       + " from p) select page_id, case when greatest(microsoft, google, okta, adfs) < 2 then null when microsoft = greatest(microsoft, google, okta, adfs) then 'microsoft' when google = greatest(microsoft, google, okta, adfs) then 'google' when okta = greatest(microsoft, google, okta, adfs) then 'okta' else 'adfs' end as idp from c")
def idp_shown(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    more = F.when(F.col("doc_id") % 2 == 0, "convergedLogin GALX accounts.google.com gaia_loginform").otherwise("")
    d = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("page_id"), F.lit("").alias("url"), F.concat(F.coalesce("text", F.lit("")), F.lit(" login.microsoftonline.com "), more).alias("html"))
    return p.unionByName(d).select("page_id", tx.idp_shown(F.col("html"), F.col("url")).alias("idp"))


@query("client_redirects")
def client_redirects(spark, sf_dir):
    """Redirects of all pages; the tables have none, so fixtures test the rules."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.client_redirect(F.col("html"), F.col("url"), ("/error.aspx",)).alias("target"))
    return p.filter("target is not null")
