"""The threat-intelligence model as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.sources.tables import table

#: Statuses of a kit by order status.
STATUS = {"F": "analyzed", "O": "downloaded", "P": "pending"}


def kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "analyzed").when(F.col("o_orderstatus") == "O", "downloaded").otherwise("pending")
    return o.select(
        F.col("o_orderkey").alias("kit_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), F.col("o_orderpriority").alias("source_feed"),
        F.floor("o_totalprice").cast("long").alias("file_size"), F.col("o_custkey").alias("investigation_id"),
        F.when(F.col("o_orderkey") >= 10, F.expr("o_orderkey div 10")).alias("parent_kit_id"),
    )


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("kit_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("type"), F.col("l_partkey").cast("string").alias("value"),
        F.floor(F.col("l_quantity") * 2).cast("int").alias("confidence"), F.col("l_suppkey").alias("actor_id"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


def actor_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors with handles (one for each of 20 groups) and whether they were made by the machine."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    handles = F.array(F.concat(F.lit("@h"), (key % 20).cast("string")))
    return s.select(key.alias("actor_id"), F.col("s_name").alias("name"), (key % 7 == 0).alias("auto_generated"), handles.alias("handles"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("campaign_id")).agg(F.min("p_brand").alias("target_brand"))
    return p.select("campaign_id", "target_brand", (F.col("campaign_id") % 5 == 0).alias("auto_generated"))


def kit_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kit_id"), F.col("l_suppkey").alias("actor_id")).distinct()


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its campaign (of 50), that campaign's brand per part, and its family."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 50).alias("campaign_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


def campaign_kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("kit_id"), (F.col("l_partkey") % 50).alias("campaign_id")).distinct()


def family_kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kit_id"), F.col("l_partkey").alias("part"))
    return li.join(parts(spark, sf_dir), "part").select("kit_id", F.col("brand").alias("family")).distinct()


def victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("victim_id"), F.col("c_name").alias("email"), F.col("c_mktsegment").alias("domain"), F.col("c_acctbal").alias("balance"))


def kit_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("victim_id"), F.col("o_orderkey").alias("kit_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("observed_at"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("kit_id"), F.col("event_type").alias("analysis_type"), F.col("props").alias("result_data"), F.col("ts").alias("created_at"), F.col("value").alias("duration"))


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("kit_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("body"))


def perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 sign bits of an embedding as a signed BIGINT, the first sign highest."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0).cast("long")))
    return e.select("vec_id", "label", bits.alias("phash"))


#: The same views in SQL, for oracles.
SQL = {
    "kits": """kits as (select o_orderkey as kit_id, o_orderdate as created_at,
        case o_orderstatus when 'F' then 'analyzed' when 'O' then 'downloaded' else 'pending' end as status, o_orderpriority as source_feed,
        cast(floor(o_totalprice) as bigint) as file_size, o_custkey as investigation_id, case when o_orderkey >= 10 then o_orderkey // 10 end as parent_kit_id from orders)""",
    "indicators": """indicators as (select l_orderkey as kit_id, l_linenumber as line, l_returnflag as type, cast(l_partkey as varchar) as value,
        cast(floor(l_quantity * 2) as integer) as confidence, l_suppkey as actor_id from lineitem)""",
    "actors": "actors as (select s_suppkey as actor_id, s_name as name, s_nationkey as nation from supplier)",
    "actor_details": "actor_details as (select s_suppkey as actor_id, s_name as name, s_suppkey % 7 = 0 as auto_generated, ['@h' || cast(s_suppkey % 20 as varchar)] as handles from supplier)",
    "campaigns": "campaigns as (select p_partkey % 50 as campaign_id, min(p_brand) as target_brand, p_partkey % 50 % 5 = 0 as auto_generated from part group by 1, 3)",
    "kit_actors": "kit_actors as (select distinct l_orderkey as kit_id, l_suppkey as actor_id from lineitem)",
    "parts": "parts as (select p_partkey as part, p_partkey % 50 as campaign_id, p_brand as brand, p_type as kind from part)",
    "campaign_kits": "campaign_kits as (select distinct l_orderkey as kit_id, l_partkey % 50 as campaign_id from lineitem)",
    "family_kits": "family_kits as (select distinct l_orderkey as kit_id, p_brand as family from lineitem join part on l_partkey = p_partkey)",
    "victims": "victims as (select c_custkey as victim_id, c_name as email, c_mktsegment as domain, c_acctbal as balance from customer)",
    "kit_victims": "kit_victims as (select o_custkey as victim_id, o_orderkey as kit_id, o_orderpriority as source, o_orderdate as observed_at from orders)",
    "results": "results as (select event_id, user_id as kit_id, event_type as analysis_type, props as result_data, ts as created_at, value as duration from events)",
    "stages": "stages as (select conv_id as kit_id, turn as seq, role, text as body from conversations)",
}


def with_views(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
