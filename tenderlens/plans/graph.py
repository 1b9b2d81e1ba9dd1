"""Queries of the co-bidding graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import above, count_if
from ..functions.storage import durable, small, stored
from ..operators import graph as G
from ..operators import text as X
from .aggregates import r
from .registry import query
from .shared import WS

PAIRS = """
pairs AS (SELECT a.vendor_id AS a, b.vendor_id AS b, count(*) AS shared FROM bids a JOIN bids b ON a.tender_id = b.tender_id AND a.vendor_id < b.vendor_id GROUP BY 1, 2),
per AS (SELECT vendor_id, count(DISTINCT tender_id) AS n, avg(total_amount) AS mean FROM bids GROUP BY 1),
edges AS (SELECT * FROM pairs WHERE shared > (SELECT avg(shared) + 1.5 * stddev_pop(shared) FROM pairs))
"""


@query(f"""
WITH {PAIRS}, m AS (SELECT a, b, shared, shared / least(x.n, y.n) AS rate, 1 - abs(x.mean - y.mean) / greatest(x.mean, y.mean) AS sim FROM pairs JOIN per x ON x.vendor_id = a JOIN per y ON y.vendor_id = b),
s AS (SELECT a.vendor_id AS a, b.vendor_id AS b, array_to_string(list(DISTINCT a.tender_id ORDER BY a.tender_id)[1:10], ',') AS shared_tenders FROM bids a JOIN bids b ON a.tender_id = b.tender_id AND a.vendor_id < b.vendor_id GROUP BY 1, 2)
SELECT a, b, shared, shared_tenders, round(100 * shared / (SELECT max(shared) FROM pairs), 4) AS heat, round(rate, 6) AS rate, round(60 * rate + 40 * sim, 5) AS suspicion, CASE WHEN 60 * rate + 40 * sim >= 70 THEN 'CRITICAL' WHEN 60 * rate + 40 * sim >= 45 THEN 'HIGH' WHEN 60 * rate + 40 * sim >= 20 THEN 'MODERATE' ELSE 'LOW' END AS level FROM m JOIN s USING (a, b)""")
def co_bid_matrix(t):
    per = small(durable(t.bids().groupBy("vendor_id").agg(F.count_distinct("tender_id").alias("n"), F.avg("total_amount").alias("mean"))))
    pairs = stored(G.co_bids(t.bids(), tenders=10))
    m = pairs.crossJoin(F.broadcast(pairs.agg(F.max("shared").alias("most")))).join(per.toDF("a", "na", "ma"), "a").join(per.toDF("b", "nb", "mb"), "b")
    rate = F.col("shared") / F.least("na", "nb")
    s = 60 * rate + 40 * (1 - F.abs(F.col("ma") - F.col("mb")) / F.greatest("ma", "mb"))
    listed = F.array_join(F.transform("tenders", lambda x: x.cast("string")), ",")
    return m.select("a", "b", "shared", listed.alias("shared_tenders"), r(100 * F.col("shared") / F.col("most"), 4).alias("heat"), r(rate).alias("rate"), r(s, 5).alias("suspicion"), above(s, [(70, "CRITICAL"), (45, "HIGH"), (20, "MODERATE")], "LOW").alias("level"))


@query("SELECT tender_id, count(DISTINCT vendor_id) AS bidders, (count(DISTINCT vendor_id) * (count(DISTINCT vendor_id) - 1) // 2)::BIGINT AS pairs FROM bids GROUP BY 1 ORDER BY bidders DESC, tender_id LIMIT 10")
def largest_tenders(t):
    """The ten tenders that make the most pairs of bidders."""
    return G.pair_load(t.bids())


@query(f"WITH {PAIRS} SELECT a, b, shared, CASE WHEN shared / least(x.n, y.n) > 0.3 THEN 'HIGH' ELSE 'MODERATE' END AS level FROM pairs JOIN per x ON x.vendor_id = a JOIN per y ON y.vendor_id = b WHERE shared >= 2")
def frequent_pairs(t, high=0.3):
    per = small(durable(t.bids().groupBy("vendor_id").agg(F.count_distinct("tender_id").alias("n"))))
    m = G.co_bids(t.bids()).filter("shared >= 2").join(per.toDF("a", "na"), "a").join(per.toDF("b", "nb"), "b")
    return m.select("a", "b", "shared", F.when(F.col("shared") / F.least("na", "nb") > high, "HIGH").otherwise("MODERATE").alias("level"))


@query(f"""
WITH {PAIRS}, d AS (SELECT node, count(*) AS degree, avg(shared) AS w FROM (SELECT a AS node, shared FROM edges UNION ALL SELECT b, shared FROM edges) GROUP BY 1), k AS (SELECT count(*) AS n FROM d)
SELECT node, round(degree / (n - 1), 6) AS centrality, round(w, 6) AS avg_weight, CASE WHEN degree / (n - 1) > 0.1 AND w > 2 THEN 'HIGH' WHEN degree / (n - 1) > 0.05 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM d, k""")
def degree_centrality(t, high=0.1, moderate=0.05):
    d = durable(G.both_ways(G.strong_edges(t.bids()), "shared").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.avg("shared").alias("w")))
    c = F.col("degree") / (F.col("n") - 1)
    out = d.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return out.select("node", r(c).alias("centrality"), r("w").alias("avg_weight"), F.when((c > high) & (F.col("w") > 2), "HIGH").when(c > moderate, "MODERATE").otherwise("LOW").alias("risk"))


BOTH = "both_ AS (SELECT a AS u, b AS v, shared FROM edges UNION ALL SELECT b, a, shared FROM edges)"
_POWER = ", ".join(
    [f"x0 AS (SELECT DISTINCT u AS node, 1.0::DOUBLE AS x FROM both_)"]
    + [f"x{i} AS MATERIALIZED (SELECT node, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT u AS node, sum(shared * x) AS x FROM both_ JOIN x{i - 1} ON node = v GROUP BY 1))" for i in range(1, 31)]
)


@query(f"WITH {PAIRS}, {BOTH}, {_POWER} SELECT node, round(x, 6) AS centrality FROM x30")
def eigenvector_centrality(t):
    return G.eigenvector(G.strong_edges(t.bids())).select("node", r("centrality").alias("centrality"))


@query()
def betweenness_centrality(t):
    return G.betweenness(G.strong_edges(t.bids())).select("node", r("betweenness").alias("betweenness"))


_LABELS = ", ".join(
    ["l0 AS (SELECT DISTINCT u AS node, u AS community FROM both_)"]
    + [
        f"l{i} AS MATERIALIZED (SELECT node, arg_max(community, (w, -community)) AS community FROM (SELECT node, community, sum(w) AS w FROM (SELECT u AS node, community, shared AS w FROM both_ JOIN l{i - 1} ON node = v UNION ALL SELECT node, community, 1 FROM l{i - 1}) GROUP BY 1, 2) GROUP BY 1)"
        for i in range(1, 11)
    ]
)


@query(f"WITH {PAIRS}, {BOTH}, {_LABELS} SELECT node, community FROM l10")
def communities(t):
    return G.label_propagation(G.strong_edges(t.bids()))


@query(f"""
WITH RECURSIVE_MARK {PAIRS}, both_ AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges), reach(u, v) AS (SELECT u, u FROM both_ UNION SELECT r.u, b.v FROM reach r JOIN both_ b ON b.u = r.v)
SELECT u AS node, min(v) AS component FROM reach GROUP BY 1""".replace("WITH RECURSIVE_MARK", "WITH"), recursive=True)
def cartel_components(t):
    return G.components(G.strong_edges(t.bids()))


SIGNALS_SQL = """
attr AS (SELECT s_suppkey AS vendor_id, s_nationkey AS subnet, round(s_acctbal / 50)::BIGINT AS address, s_suppkey % 17 AS device, s_nationkey * 100 + s_suppkey % 3 AS domain FROM supplier),
hits AS (SELECT x.vendor_id AS a, y.vendor_id AS b, 3 AS pts, 'subnet' AS sig FROM attr x JOIN attr y USING (subnet) WHERE x.vendor_id < y.vendor_id UNION ALL SELECT x.vendor_id, y.vendor_id, 4, 'address' FROM attr x JOIN attr y USING (address) WHERE x.vendor_id < y.vendor_id
 UNION ALL SELECT x.vendor_id, y.vendor_id, 2, 'device' FROM attr x JOIN attr y USING (device) WHERE x.vendor_id < y.vendor_id UNION ALL SELECT x.vendor_id, y.vendor_id, 3, 'domain' FROM attr x JOIN attr y USING (domain) WHERE x.vendor_id < y.vendor_id),
sig AS (SELECT a, b, sum(pts)::BIGINT AS score, string_agg(sig, ',' ORDER BY sig) AS signals FROM hits GROUP BY 1, 2)
"""


#: Kinds of contact attributes and their points (fixed values).
SIGNALS = {"address": 4, "device": 2, "domain": 3, "subnet": 3}


def attributes(t):
    """Contact attributes of vendors, one column a kind."""
    s = t.raw("supplier")
    values = {"address": F.round(F.col("s_acctbal") / 50), "device": F.col("s_suppkey") % 17, "domain": F.col("s_nationkey") * 100 + F.col("s_suppkey") % 3, "subnet": F.col("s_nationkey")}
    return s.select(F.col("s_suppkey").alias("vendor_id"), *[v.cast("bigint").alias(k) for k, v in values.items()])


_STYLE_RATES = [f"avg(coalesce(1000.0 * (len(text) - len(replace(text, '{c}', ''))) / nullif(len(text), 0), 0))" for c in ",.;:!"]
_APART = " + ".join(f"abs(x.r{i} - y.r{i})" for i in range(5))
COLLUSION_SQL = f"""
own AS (SELECT s_suppkey AS vendor_id, concat('10.', s_nationkey, '.', s_suppkey % 4, '.', s_suppkey % 9) AS ip, concat('10.', s_nationkey, '.', s_suppkey % 4) AS subnet, CASE WHEN s_suppkey % 3 > 0 THEN concat('n', s_nationkey, '-', s_suppkey % 3, '.example') END AS domain, s_suppkey % 17 AS device,
  s_nationkey + s_suppkey % 5 * 0.0005::DOUBLE AS lat, round(s_acctbal / 1000) * 0.0005::DOUBLE AS lon, [s_suppkey % 40, round(s_acctbal / 200)::BIGINT] AS directors, round(s_acctbal / 50)::BIGINT AS address, round(s_acctbal / 20)::BIGINT AS phone FROM supplier),
texts AS (SELECT *, list_filter({WS}, lambda x: len(x) >= 3) AS w, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'))), lambda n: n > 0) AS s FROM bid_documents),
style AS (SELECT vendor_id, doc_type, avg(len(list_distinct(w)) / len(w)) AS ttr, avg(coalesce(list_avg(s), 0)) AS sentence, {", ".join(f"{c} AS r{i}" for i, c in enumerate(_STYLE_RATES))} FROM texts WHERE len(w) > 20 AND doc_type IS NOT NULL GROUP BY 1, 2),
alike AS (SELECT DISTINCT x.vendor_id AS a, y.vendor_id AS b FROM style x JOIN style y ON x.doc_type = y.doc_type AND x.vendor_id < y.vendor_id WHERE abs(x.ttr - y.ttr) < 0.05 AND abs(x.sentence - y.sentence) < 3 AND {_APART} < 1.5),
met AS (SELECT p.a, p.b, shared, sqrt(((x.lat - y.lat) * 111000) ** 2 + ((x.lon - y.lon) * 111000 * cos(radians(x.lat))) ** 2) AS distance_m, x.ip = y.ip AS f_ip, x.subnet = y.subnet AND x.ip <> y.ip AS f_subnet, coalesce(x.domain = y.domain, FALSE) AS f_domain, x.device = y.device AS f_device,
  len(list_intersect(x.directors, y.directors)) > 0 AS f_directors, x.address = y.address AS f_address, x.phone = y.phone AS f_phone, k.a IS NOT NULL AS f_style FROM pairs p JOIN own x ON x.vendor_id = p.a JOIN own y ON y.vendor_id = p.b LEFT JOIN alike k ON k.a = p.a AND k.b = p.b),
fired AS (SELECT *, distance_m < 100 AS f_distance FROM met),
scored AS (SELECT *, ({" + ".join(f"CASE WHEN f_{k} THEN {v} ELSE 0 END" for k, v in G.COLLUSION.items())})::BIGINT AS score, concat_ws(',', {", ".join(f"CASE WHEN f_{k} THEN '{k}' END" for k in G.COLLUSION)}) AS signals FROM fired)
"""


@query(f"WITH {PAIRS.strip()}, {COLLUSION_SQL.strip()} SELECT a, b, shared, score, signals, round(distance_m, 1) AS distance_m, CASE WHEN score >= 5 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS level FROM scored WHERE score > 0")
def collusion_edges(t):
    """Vendors that bid together and share any of nine signals; the tables lack contacts, which are made from suppliers' columns, and styles are those of their documents."""
    k, n, x = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    own = t.raw("supplier").select(
        k.alias("vendor_id"), F.concat_ws(".", F.lit("10"), n, k % 4, k % 9).alias("ip"), F.when(k % 3 > 0, F.concat(F.lit("info@n"), n, F.lit("-"), k % 3, F.lit(".example"))).otherwise("info@gmail.com").alias("email"), (k % 17).alias("device"),
        (n + k % 5 * 0.0005).alias("lat"), (F.round(x / 1000) * 0.0005).alias("lon"), F.array(k % 40, F.round(x / 200).cast("bigint")).alias("directors"), F.round(x / 50).cast("bigint").alias("address"), F.round(x / 20).cast("bigint").alias("phone"),
    )
    own = own.join(X.styles(t.documents()), "vendor_id", "left")
    return G.collusion(G.co_bids(t.bids()), own).filter("score > 0").withColumn("distance_m", F.round("distance_m", 1))


@query(f"""
WITH {SIGNALS_SQL.strip()}, ends AS (SELECT a AS vendor_id, score FROM sig UNION ALL SELECT b, score FROM sig)
SELECT s_suppkey AS vendor_id, count(score) AS links, count(*) FILTER (score >= 7) AS critical, count(*) FILTER (score >= 3 AND score < 7) AS warning, coalesce(max(score), 0) AS strongest,
  CASE WHEN max(score) >= 7 THEN 'CRITICAL' WHEN max(score) >= 3 THEN 'WARNING' ELSE 'CLEAR' END AS verdict FROM supplier LEFT JOIN ends ON vendor_id = s_suppkey GROUP BY 1""")
def conflict_of_interest(t):
    """One row per vendor: how many others share contact attributes with it, by the points of what they share, without writing pairs."""
    return G.shared_attributes(attributes(t), "vendor_id", SIGNALS, critical=7, warning=3)


FEATS = """
z AS (SELECT bid_id, tender_id, CASE WHEN stddev_pop(total_amount) OVER w > 0 THEN (total_amount - avg(total_amount) OVER w) / stddev_pop(total_amount) OVER w ELSE 0 END AS za, count(*) OVER (PARTITION BY vendor_id)::DOUBLE AS co FROM bids WINDOW w AS (PARTITION BY tender_id)),
p AS (SELECT bid_id, za / (SELECT stddev_pop(za) FROM z) AS x, co / (SELECT stddev_pop(co) FROM z) AS y FROM z)
"""


def bid_points(t):
    from pyspark.sql import Window as W

    b = t.bids()
    w = W.partitionBy("tender_id")
    sd = F.stddev_pop("total_amount").over(w)
    z = stored(b.select("bid_id", F.when(sd > 0, (F.col("total_amount") - F.avg("total_amount").over(w)) / F.when(sd > 0, sd)).otherwise(0.0).alias("za"), F.count(F.lit(1)).over(W.partitionBy("vendor_id")).cast("double").alias("co")))
    s = z.agg(F.stddev_pop("za").alias("sa"), F.stddev_pop("co").alias("sc"))
    return z.crossJoin(F.broadcast(s)).select("bid_id", (F.col("za") / F.col("sa")).alias("x"), (F.col("co") / F.col("sc")).alias("y"))  # one row


@query(f"""
WITH {FEATS.strip()}, c AS (SELECT *, floor(x / 0.81) AS cx, floor(y / 0.81) AS cy FROM p),
d AS (SELECT c.*, cx + i AS nx, cy + j AS ny FROM c, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j))
SELECT q.bid_id, count(*) FILTER (d.bid_id <> q.bid_id AND (q.x - d.x) ** 2 + (q.y - d.y) ** 2 <= 0.8 ** 2) AS links FROM c q JOIN d ON d.nx = q.cx AND d.ny = q.cy GROUP BY 1""")
def epsilon_neighbour_join(t, eps=0.8):
    """Every bid: how many other bids lie within eps in scaled feature space; bid_clusters_dbscan names each bid's class."""
    points = bid_points(t)
    return G.neighbour_counts(points, points, "bid_id", "x", "y", eps)


@query()
def bid_clusters_dbscan(t, eps=0.8):
    """Clusters of two and more bids with their suspicion: with a minimum of two points, density clusters are the components of the eps graph."""
    t = t.once("bids")
    c = G.grid_components(bid_points(t), "bid_id", "x", "y", eps)
    per_vendor = t.bids().groupBy("vendor_id").agg(F.count(F.lit(1)).alias("co"))
    b = t.bids().select("bid_id", "vendor_id", "total_amount").join(small(durable(per_vendor)), "vendor_id").join(c.select(F.col("node").alias("bid_id"), F.col("component").alias("cluster")), "bid_id")
    b = stored(b)
    a = b.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.avg("total_amount").alias("m"), F.stddev_pop("total_amount").alias("s"), F.avg("co").alias("co"))
    cv = F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0)
    suspicion = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1 - cv) * 50 + 10 * F.col("co")))
    return b.join(small(durable(a.select("cluster", "members", r(suspicion).alias("suspicion")))), "cluster").select("bid_id", "cluster", "members", "suspicion")


DNA = """
f AS (SELECT vendor_id, count(*) AS bids, [count(*) FILTER (per < 0.7) / count(*), count(*) FILTER (per >= 0.7 AND per < 0.9) / count(*), count(*) FILTER (per >= 0.9 AND per < 1.05) / count(*), count(*) FILTER (per >= 1.05 AND per < 1.3) / count(*), count(*) FILTER (per >= 1.3) / count(*)] AS prices
  FROM (SELECT vendor_id, total_amount / estimated_value AS per FROM bid_fact) GROUP BY 1),
h AS (SELECT user_id AS vendor_id, list_transform(range(0, 24), lambda x: len(list_filter(list(hour(ts)), lambda y: y = x))::DOUBLE) AS hours FROM audit GROUP BY 1),
co AS (SELECT v, list_sort(list(DISTINCT o)) AS others FROM (SELECT a AS v, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs) GROUP BY 1),
wins AS (SELECT vendor_id, string_agg(category || ':' || n, ';' ORDER BY category) AS wins FROM (SELECT vendor_id, category, count(*) AS n FROM bid_fact WHERE status = 'Awarded' GROUP BY 1, 2) GROUP BY 1),
dna AS (SELECT a, b, list_cosine_similarity(x.prices, y.prices) AS price, coalesce(list_cosine_similarity(hx.hours, hy.hours), 0) AS timing, len(list_intersect(cx.others, cy.others)) / len(list_distinct(list_concat(cx.others, cy.others))) AS co
  FROM pairs JOIN f x ON x.vendor_id = a JOIN f y ON y.vendor_id = b JOIN co cx ON cx.v = a JOIN co cy ON cy.v = b LEFT JOIN h hx ON hx.vendor_id = a LEFT JOIN h hy ON hy.vendor_id = b),
sims AS (SELECT *, 0.5 * price + 0.2 * timing + 0.3 * co AS sim FROM dna)
"""


def vendor_times(t):
    """Bids have dates only: the hours of a vendor's acts are those of the audit rows of the user with its id."""
    return t.audit().select(F.col("user_id").alias("vendor_id"), F.col("ts").alias("at"))


@query(f"""
WITH {PAIRS}, {DNA.strip()} SELECT f.vendor_id, bids, {", ".join(f"round(prices[{i + 1}], 6) AS p{i}" for i in range(5))}, coalesce(array_to_string(list_transform(hours, lambda x: x::BIGINT), ','), '{",".join("0" * 24)}') AS hours,
  coalesce(len(others), 0) AS co_bidders, coalesce(wins, '') AS wins FROM f LEFT JOIN h USING (vendor_id) LEFT JOIN co ON v = f.vendor_id LEFT JOIN wins w ON w.vendor_id = f.vendor_id""")
def vendor_fingerprint(t):
    met = G.both_ways(G.co_bids(t.bids())).groupBy(F.col("node").alias("vendor_id")).agg(F.count(F.lit(1)).cast("int").alias("met"))
    f = G.fingerprints(t.bid_fact(), vendor_times(t)).join(met, "vendor_id", "left")
    hours = F.array_join(F.transform("hours", lambda x: x.cast("bigint").cast("string")), ",")
    wins = F.array_join(F.transform("wins", lambda w: F.concat(w["category"], F.lit(":"), w["n"].cast("string"))), ";")
    return f.select("vendor_id", "bids", *[r(F.get("prices", F.lit(i))).alias(f"p{i}") for i in range(5)], hours.alias("hours"), F.coalesce("met", F.lit(0)).alias("co_bidders"), wins.alias("wins"))


def dna(t):
    """Similarity of vendors with a shared tender: price and hour histograms and the Jaccard index of their co-bidders."""
    f = small(durable(G.fingerprints(t.bid_fact(), vendor_times(t)).select("vendor_id", "prices", "hours")))
    p = G.neighbour_jaccard(G.co_bids(t.bids())).join(f.toDF("a", "pa", "ha"), "a").join(f.toDF("b", "pb", "hb"), "b")
    parts = p.select("a", "b", G.cosine("pa", "pb").alias("price"), G.cosine("ha", "hb").alias("timing"), "co")
    return parts.withColumn("sim", 0.5 * F.col("price") + 0.2 * F.col("timing") + 0.3 * F.col("co"))


@query(f"""
WITH {PAIRS}, {DNA.strip()} SELECT a, b, round(price, 6) AS price_sim, round(timing, 6) AS timing_sim, round(co, 6) AS co_bid_sim, round(sim, 6) AS similarity,
  CASE WHEN sim > 0.85 THEN 'CRITICAL' WHEN sim > 0.7 THEN 'HIGH' WHEN sim > 0.5 THEN 'MODERATE' ELSE 'LOW' END AS risk, sim > 0.85 AS clone FROM sims""")
def fingerprint_similarity(t, clone=0.85):
    s = F.col("sim")
    level = F.when(s > clone, "CRITICAL").when(s > 0.7, "HIGH").when(s > 0.5, "MODERATE").otherwise("LOW")
    return dna(t).select("a", "b", r("price").alias("price_sim"), r("timing").alias("timing_sim"), r("co").alias("co_bid_sim"), r("sim").alias("similarity"), level.alias("risk"), (s > clone).alias("clone"))


@query(f"""
WITH {PAIRS}, {DNA.strip()}, near AS (SELECT a, b, sim FROM sims WHERE 1 - sim <= 0.3), ways AS (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near),
reach(u, v) AS (SELECT u, u FROM ways UNION SELECT r.u, w.v FROM reach r JOIN ways w ON w.u = r.v), c AS (SELECT u AS node, min(v) AS cluster FROM reach GROUP BY 1),
m AS (SELECT cluster, avg(sim) AS mean FROM near JOIN c ON node = a GROUP BY 1)
SELECT cluster, count(*) AS members, string_agg(node::VARCHAR, ',' ORDER BY node) AS vendors, round(any_value(mean), 6) AS mean_similarity FROM c JOIN m USING (cluster) GROUP BY 1""", recursive=True)
def shell_clusters(t, distance=0.3):
    d = stored(dna(t).filter(1 - F.col("sim") <= distance).select("a", "b", "sim"))
    c = G.components(d)
    inside = d.join(c.toDF("a", "cluster"), "a").groupBy("cluster").agg(F.avg("sim").alias("mean"))
    members = c.groupBy(F.col("component").alias("cluster")).agg(F.count(F.lit(1)).alias("members"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("vendors"))
    return members.join(inside, "cluster").select("cluster", "members", "vendors", r("mean").alias("mean_similarity"))


@query("SELECT count(*) AS vendors, count(*) FILTER (is_blacklisted) AS blacklisted FROM vendors")
def graph_nodes(t):
    return t.vendors().agg(F.count(F.lit(1)).alias("vendors"), count_if(F.col("is_blacklisted")).alias("blacklisted"))
