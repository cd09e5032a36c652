"""Queries: contagion graph tables at one snapshot."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.functions.interest import hf_band
from tremor.operators.bars import ranked as ranked_rows
from tremor.queries.registry import ORACLE_SQL, query
from tremor.queries.state import AT, STATE, frame, latest_prices
from tremor.sources import adapter as A
from tremor.sources.adapter import cte
from tremor.sources.shared import saved, shared_folder

_BAND = "case when hf is null then 'no_debt' when hf <= 1 then '<=1' when hf <= 1.1 then '1-1.1' when hf <= 1.25 then '1.1-1.25' when hf <= 1.5 then '1.25-1.5' when hf <= 2 then '1.5-2' else '>2' end"
_NODES = STATE + f""", fr as (select "user", reserve, round(greatest(collateral, 0) * coalesce(price, 0), 6) as collateral_usd, round(greatest(debt, 0) * coalesce(price, 0), 6) as debt_usd, round(greatest(collateral, 0) * coalesce(price, 0) * coalesce(threshold, 0), 6) as weighted_usd from legs),
ur as (select "user", sum(collateral_usd) as collateral_usd, sum(debt_usd) as debt_usd, case when sum(debt_usd) > 1e-12 then sum(weighted_usd) / sum(debt_usd) end as hf, sum(weighted_usd) as weighted_usd, (select reserve from fr f where f."user" = fr."user" order by collateral_usd desc, reserve limit 1) as symbol from fr group by "user"),
rk as (select *, row_number() over (order by collateral_usd desc, "user") <= 30 as whale from ur),
ids as (select *, case when whale then 'whale:' || "user" else 'bucket:p0:' || symbol || ':' || {_BAND} end as node_id from rk),
nodes as (select node_id, case when max(whale::int) = 1 then 'whale' else 'bucket' end as node_type, round(sum(collateral_usd), 6) as collateral_usd, round(sum(debt_usd), 6) as debt_usd, case when sum(debt_usd) > 1e-12 then round(sum(weighted_usd) / sum(debt_usd), 6) end as hf, count(*) as n_positions from ids group by node_id),
expo as (select node_id, reserve, channel, round(sum(w), 6) as weight from (select node_id, reserve, unnest(['collateral', 'debt']) as channel, unnest([fr.collateral_usd, fr.debt_usd]) as w from ids join fr using ("user")) group by all having sum(w) > 1e-9)"""


def rollup(spark, d):
    w = W.partitionBy("user").orderBy(F.desc("collateral_usd"), "reserve")
    f = frame(spark, d).withColumn("n", F.row_number().over(w))
    g = f.groupBy("user").agg(F.sum("collateral_usd").alias("collateral_usd"), F.sum("debt_usd").alias("debt_usd"), F.sum("weighted_usd").alias("weighted_usd"), F.max(F.when(F.col("n") == 1, F.col("reserve"))).alias("symbol"))
    return g.withColumn("hf", F.when(F.col("debt_usd") > 1e-12, F.col("weighted_usd") / F.col("debt_usd")))


def ranked(spark, d, top=30):
    """Users with `whale`: the `top` by collateral are found by a top-N and joined back, so users are never sorted in one task."""
    r = rollup(spark, d)
    top = r.orderBy(F.desc("collateral_usd"), "user").limit(top).select("user", F.lit(True).alias("w"))
    return r.join(top, "user", "left").withColumn("whale", F.coalesce("w", F.lit(False))).drop("w")


def with_ids(spark, d):
    bucket = F.concat_ws(":", F.lit("bucket:p0"), "symbol", hf_band(F.col("hf")))
    return ranked(spark, d).withColumn("node_id", F.when(F.col("whale"), F.concat(F.lit("whale:"), "user")).otherwise(bucket))


def node_table(spark, d):
    g = with_ids(spark, d).groupBy("node_id").agg(F.when(F.max("whale"), "whale").otherwise("bucket").alias("node_type"), F.sum("collateral_usd").alias("collateral_usd"), F.sum("debt_usd").alias("debt_usd"), F.sum("weighted_usd").alias("x"), F.count("*").alias("n_positions"))
    return g.select("node_id", "node_type", F.round("collateral_usd", 6).alias("collateral_usd"), F.round("debt_usd", 6).alias("debt_usd"), F.when(F.col("debt_usd") > 1e-12, F.round(F.col("x") / F.col("debt_usd"), 6)).alias("hf"), "n_positions")


def exposure(spark, d):
    rows = with_ids(spark, d).select("user", "node_id").join(frame(spark, d), "user")
    return rows.select("node_id", "reserve", F.expr("stack(2, 'collateral', collateral_usd, 'debt', debt_usd) as (channel, w)")).groupBy("node_id", "reserve", "channel").agg(F.round(F.sum("w"), 6).alias("weight")).where("weight > 1e-9")


@query(_NODES + ' select "user", collateral_usd, debt_usd, hf, symbol from ur')
def user_rollup(spark, d):
    return rollup(spark, d).select("user", "collateral_usd", "debt_usd", "hf", "symbol")


@query(_NODES + ' select "user", whale, collateral_usd from rk')
def topn_whales(spark, d):
    return ranked(spark, d).select("user", "whale", "collateral_usd")


@query(_NODES + " select * from nodes where node_type = 'bucket'")
def bucket_nodes(spark, d):
    return node_table(spark, d).where("node_type = 'bucket'")


@query(_NODES + " select * from expo")
def exposure_edges(spark, d):
    return exposure(spark, d)


#: Wrapped asset and what it stands for (fixed values).
WRAPS = [("a1", "a0"), ("a3", "a2"), ("a9", "a0")]
MOST_NODES = 10_000
_POOLS = """, depth as (select case when k % 3 = 0 then 'v2' when k % 3 = 1 then 'v3' else 'curve' end as dex, 'pool' || (k % 12) as pool, asset as symbol, block_number // 1200 as day, max(amount_usd * case when k % 3 = 1 then 2 else 1 end) as depth_usd from ev where event_type = 'Deposit' group by all),
pools as (select 'pool:' || dex || ':' || pool as node_id, symbol, max_by(depth_usd, day) as depth_usd from depth where day <= 100 group by all),
wraps as (select * from (values ('a1', 'a0'), ('a3', 'a2'), ('a9', 'a0')) v(wrapped, underlying)), symbols as (select asset as s from price_at union select wrapped from wraps union select underlying from wraps)"""


def limited(nodes):
    """The nodes of one snapshot, written once; more than MOST_NODES are an error."""
    nodes = saved(nodes)
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"a snapshot has more than {MOST_NODES} nodes")
    return nodes


def pools_now(spark, d):
    """(node_id, symbol, depth_usd): each pool's last depth of an asset as of the snapshot."""
    p = pool_depth(spark, d).where(F.col("day") <= AT // 1200)
    return p.groupBy(F.concat(F.lit("pool:"), "dex", F.lit(":"), "pool").alias("node_id"), "symbol").agg(F.max_by("depth_usd", "day").alias("depth_usd"))


@query(_NODES + _POOLS + """ select node_id, node_type, collateral_usd, debt_usd, hf, n_positions from nodes union all select 'asset:' || s, 'asset', price, null, null, 0 from symbols left join price_at on asset = s
 union all select distinct node_id, 'pool', null::double, null, null, 0 from pools union all select 'protocol:p0', 'protocol', null, null, null, 0""")
def graph_nodes(spark, d):
    """Whales, buckets, assets (with those that only wraps name), pools and the protocol."""
    wraps = spark.createDataFrame([(x,) for pair in WRAPS for x in pair], "reserve string")
    prices = latest_prices(spark, d)
    symbols = prices.select("reserve").unionByName(wraps).distinct().join(prices, "reserve", "left")
    assets = symbols.select(F.concat(F.lit("asset:"), "reserve").alias("node_id"), F.lit("asset").alias("node_type"), F.col("price").alias("collateral_usd"))
    pools = pools_now(spark, d).select("node_id", F.lit("pool").alias("node_type")).distinct()
    protocol = spark.createDataFrame([("protocol:p0", "protocol")], "node_id string, node_type string")
    rest = assets.unionByName(pools, allowMissingColumns=True).unionByName(protocol, allowMissingColumns=True).withColumn("n_positions", F.lit(0).cast("long"))
    return limited(node_table(spark, d).unionByName(rest, allowMissingColumns=True))


@query(_NODES + _POOLS + """ select node_id as src_id, 'asset:' || reserve as dst_id, channel, weight from expo union all select 'asset:' || asset, 'protocol:p0', 'listing', price from price_at
 union all select 'asset:' || symbol, node_id, 'pool_depth', depth_usd from pools union all select 'asset:' || wrapped, 'asset:' || underlying, 'wrap', coalesce((select round(sum(weight), 6) from expo where reserve = wrapped and channel = 'collateral'), 0) from wraps""")
def graph_edges(spark, d):
    """Exposures by collateral and debt, listings, pool depths and wraps, weighted by the wrapped asset's collateral."""
    asset = lambda c: F.concat(F.lit("asset:"), c)
    expo = saved(exposure(spark, d))
    edges = expo.select(F.col("node_id").alias("src_id"), asset("reserve").alias("dst_id"), "channel", "weight")
    listed = latest_prices(spark, d).select(asset("reserve").alias("src_id"), F.lit("protocol:p0").alias("dst_id"), F.lit("listing").alias("channel"), F.col("price").alias("weight"))
    deep = pools_now(spark, d).select(asset("symbol").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit("pool_depth").alias("channel"), F.col("depth_usd").alias("weight"))
    held = expo.where("channel = 'collateral'").groupBy("reserve").agg(F.round(F.sum("weight"), 6).alias("w"))
    wraps = spark.createDataFrame(WRAPS, "reserve string, underlying string").join(held, "reserve", "left")
    wraps = wraps.select(asset("reserve").alias("src_id"), asset("underlying").alias("dst_id"), F.lit("wrap").alias("channel"), F.coalesce("w", F.lit(0.0)).alias("weight"))
    return edges.unionByName(listed).unionByName(deep).unionByName(wraps)


@query(_NODES + " select avg(case when hf >= 1.0 and hf < 1.25 then 1.0::double else 0 end) as frac_at_risk, count(*) as n_whales from nodes where node_type = 'whale'")
def fragility(spark, d):
    risk = F.coalesce((F.col("hf") >= 1.0) & (F.col("hf") < 1.25), F.lit(False)).cast("double")
    return node_table(spark, d).where("node_type = 'whale'").agg(F.avg(risk).alias("frac_at_risk"), F.count("*").alias("n_whales"))


@query(_NODES + " , keep as (select node_id from nodes where node_type = 'whale' order by collateral_usd desc, node_id limit 10) select node_id, reserve, channel, weight from expo where node_id in (select node_id from keep)")
def legible_subgraph(spark, d):
    keep = node_table(spark, d).where("node_type = 'whale'").orderBy(F.desc("collateral_usd"), "node_id").limit(10).select("node_id")
    e = exposure(spark, d)
    return e.join(keep, "node_id", "left_semi").select(e.columns)


@query("""with n as (select node_id, node_type, row_number() over (partition by node_type order by node_id) - 1 as local_id, coalesce(collateral_usd, 0) as x0, coalesce(debt_usd, 0) as x1, coalesce(hf, 0) as x2, n_positions::double as x3 from (NODES)),
e as (select s.node_type as src_type, channel, t.node_type as dst_type, s.local_id as src, t.local_id as dst, weight from (EDGES) e join n s on s.node_id = e.src_id join n t on t.node_id = e.dst_id where channel <> 'listing')
select 'node' as part, node_type as src_type, null as channel, null as dst_type, local_id as src, null::bigint as dst, node_id, x0, x1, x2, x3, null::double as weight from n
union all select 'edge', src_type, channel, dst_type, src, dst, null, null, null, null, null, weight from e""".replace("NODES", ORACLE_SQL["graph_nodes"]).replace("EDGES", ORACLE_SQL["graph_edges"]))
def graph_tensor(spark, d):
    """The snapshot as tensors, with the channel `listing` left out: of each node its place in its type and four features, null being zero; of
    each edge the places of its ends, by (source type, channel, target type), and its weight."""
    return tensor(graph_nodes(spark, d), graph_edges(spark, d), without=["listing"])


def tensor(nodes, edges, without=()):
    """Node and edge rows of a snapshot's tensors. Places are dense: nodes are sorted in ranges, a range's rows follow those of the ranges
    before it, and a type's begin at its least place; the driver gets a count a range. Channels in `without` are left out, for ablations."""
    placed = ranked_rows(nodes.withColumn("at", F.struct("node_type", "node_id")), "at").drop("at")
    first = placed.groupBy("node_type").agg(F.min("place").alias("first"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    n = placed.join(F.broadcast(first), "node_type")  # a row a type
    n = saved(n.select("node_id", "node_type", (F.col("place") - F.col("first")).alias("local_id"), *[zero(c).alias(f"x{k}") for k, c in enumerate(("collateral_usd", "debt_usd", "hf", "n_positions"))]))
    end = lambda side: n.select(F.col("node_id").alias(f"{side}_id"), F.col("node_type").alias(f"{side}_type"), F.col("local_id").alias(side))
    e = edges.where(~F.col("channel").isin(*without)) if without else edges
    e = e.join(end("src"), "src_id").join(end("dst"), "dst_id").select(F.lit("edge").alias("part"), "src_type", "channel", "dst_type", "src", "dst", "weight")
    rows = n.select(F.lit("node").alias("part"), F.col("node_type").alias("src_type"), F.col("local_id").alias("src"), "node_id", "x0", "x1", "x2", "x3")
    return rows.unionByName(e, allowMissingColumns=True)


@query(_NODES + f" select {_BAND} as band, count(*) as n, sum(debt_usd) as debt_usd from ur group by 1")
def hf_bands(spark, d):
    return rollup(spark, d).groupBy(hf_band(F.col("hf")).alias("band")).agg(F.count("*").alias("n"), F.sum("debt_usd").alias("debt_usd"))


_SNAPS = ", snaps as (select block_number // 20000 as snapshot, max(block_number) as last_block, count(*) as n_edges from liq group by all)"


def snapshots(spark, d):
    from tremor.sources import adapter as A

    return A.liquidations(spark, d).groupBy(F.floor(F.col("block_number") / 20000).alias("snapshot")).agg(F.max("block_number").alias("at"), F.count("*").alias("n_edges"))


@query(cte("liq") + _SNAPS + " select arg_min(snapshot, (abs(last_block - 101000), snapshot)) as nearest, arg_max(snapshot, (n_edges, -snapshot)) as busiest, count(*) filter (where last_block between 50000 and 150000) as n_in_window from snaps")
def snapshot_pick(spark, d):
    near, busy = F.struct(F.abs(F.col("at") - 101000), "snapshot"), F.struct("n_edges", -F.col("snapshot"))
    return snapshots(spark, d).agg(F.min_by("snapshot", near).alias("nearest"), F.max_by("snapshot", busy).alias("busiest"), F.count_if(F.col("at").between(50000, 150000)).alias("n_in_window"))


_DEPTH = """, depth as (select case when k % 3 = 0 then 'v2' when k % 3 = 1 then 'v3' else 'curve' end as dex, 'pool' || (k % 12) as pool, asset as symbol, block_number // 1200 as day, max(amount_usd * case when k % 3 = 1 then 2 else 1 end) as depth_usd from ev where event_type = 'Deposit' group by all)"""


def pool_depth(spark, d):
    """Three source shapes under one schema; a v3 pool's liquidity stands for half its depth."""
    from tremor.sources import adapter as A

    e = A.events(spark, d).where("event_type = 'Deposit'").select("k", F.concat(F.lit("pool"), F.col("k") % 12).alias("pool"), F.col("asset").alias("symbol"), F.floor(F.col("block_number") / 1200).alias("day"), "amount_usd")
    part = lambda i, dex, c: e.where(F.col("k") % 3 == i).select(F.lit(dex).alias("dex"), "pool", "symbol", "day", c.alias("depth_usd"))
    usd = F.col("amount_usd")
    rows = part(0, "v2", usd).unionByName(part(1, "v3", usd * 2)).unionByName(part(2, "curve", usd))
    return rows.groupBy("dex", "pool", "symbol", "day").agg(F.max("depth_usd").alias("depth_usd"))


@query(cte("ev") + _DEPTH + " select * from depth")
def scan_pool_depth(spark, d):
    return pool_depth(spark, d)


@query(cte("liq") + _DEPTH + ", s as (select * from (select distinct block_number // 20000 * 20000 // 1200 as day from liq), (select distinct dex, pool, symbol from depth)) select s.day, s.dex, s.pool, s.symbol, depth.depth_usd from s asof join depth on s.dex = depth.dex and s.pool = depth.pool and s.symbol = depth.symbol and s.day >= depth.day")
def depth_asof(spark, d):
    from tremor.operators.asof import asof_join
    from tremor.sources import adapter as A

    taken = A.liquidations(spark, d).select(F.floor(F.col("block_number") / 20000).alias("snapshot")).distinct()
    last = taken.agg(F.max("snapshot").alias("n")).first().n or 0
    p = pool_depth(spark, d)
    pools = p.select("dex", "pool", "symbol").distinct().withColumn("snapshot", F.explode(F.sequence(F.lit(0), F.lit(int(last)))))
    keys = pools.join(taken, "snapshot", "left_semi").withColumn("day", F.floor(F.col("snapshot") * 20000 / 1200)).drop("snapshot")
    return asof_join(keys, p, ["dex", "pool", "symbol"], "day", ["depth_usd"], cell=256).where("depth_usd is not null").select("day", "dex", "pool", "symbol", "depth_usd")


def save_snapshot(nodes, edges, folder, block, protocol):
    """Writes a snapshot's nodes and edges below `folder` by block, each row with its time and protocol. One without nodes is an error, as a
    reader couldn't tell it from a snapshot that failed; an earlier one of the block is replaced, others stay."""
    nodes = saved(nodes)
    if not nodes.limit(1).count():
        raise ValueError("the snapshot has no nodes")
    at = F.timestamp_seconds(F.lit(A.GENESIS_US // 10**6 + block * (A.BLOCK_US // 10**6)))
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows = rows.select("*", at.alias("snapshot_time"), F.lit(protocol).alias("protocol"), F.lit(block).cast("long").alias("snapshot_block"))
        rows.write.partitionBy("snapshot_block").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")


def load_snapshot(spark, folder, first, last):
    """(nodes, edges) of the snapshots of blocks first to last."""
    n = "node_id string, node_type string, collateral_usd double, debt_usd double, hf double, n_positions long"
    e = "src_id string, dst_id string, channel string, weight double"
    tail = ", snapshot_time timestamp, protocol string, snapshot_block long"
    inside = F.col("snapshot_block").between(first, last)
    return tuple(spark.read.schema(c + tail).parquet(f"{folder}/{name}").where(inside) for name, c in (("nodes", n), ("edges", e)))


def _saved_sql(*blocks: int) -> str:
    rows = "select 'node' as part, node_id as a, node_type as b, null as channel, collateral_usd as value from (NODES) union all select 'edge', src_id, dst_id, channel, weight from (EDGES)"
    rows = rows.replace("NODES", ORACLE_SQL["graph_nodes"]).replace("EDGES", ORACLE_SQL["graph_edges"])
    return f"select snapshot_block, {A.GENESIS_US // 10**6} + snapshot_block * {A.BLOCK_US // 10**6} as seconds, 'p0' as protocol, x.* from ({rows}) x, (select unnest({list(blocks)})::bigint as snapshot_block)"


def snapshot_rows(nodes, edges):
    at = ["snapshot_block", F.unix_seconds("snapshot_time").alias("seconds"), "protocol"]
    n = nodes.select(*at, F.lit("node").alias("part"), F.col("node_id").alias("a"), F.col("node_type").alias("b"), F.lit(None).cast("string").alias("channel"), F.col("collateral_usd").alias("value"))
    return n.unionByName(edges.select(*at, F.lit("edge").alias("part"), F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "channel", F.col("weight").alias("value")))


@query(_saved_sql(AT))
def save_snapshots(spark, d):
    """A snapshot's nodes and edges, written twice and once for another block, as they are on disk."""
    folder = shared_folder(spark, "snapshots")
    nodes, edges = graph_nodes(spark, d), saved(graph_edges(spark, d))
    save_snapshot(nodes.limit(1), edges, folder, AT, "p0")
    save_snapshot(nodes.limit(1), edges, folder, AT - 1, "p0")
    save_snapshot(nodes, edges, folder, AT, "p0")
    return snapshot_rows(*load_snapshot(spark, folder, AT, AT))


@query(_saved_sql(AT - 100, AT))
def load_snapshots(spark, d):
    """Snapshots of a range of blocks, of three that are on disk."""
    folder = shared_folder(spark, "snapshots")
    nodes, edges = saved(graph_nodes(spark, d)), saved(graph_edges(spark, d))
    for block in (AT - 200, AT - 100, AT):
        save_snapshot(nodes, edges, folder, block, "p0")
    return snapshot_rows(*load_snapshot(spark, folder, AT - 100, AT))
