"""Queries over the graph of the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import agents as A
from graphloom.operators import components as C
from graphloom.operators import fusion as U
from graphloom.operators import modularity as M
from graphloom.operators import traverse as G
from graphloom.plans.base import query, table
from graphloom.sources import star
from graphloom.sources.star import EDGES_SQL, NODES_SQL, SCALE

#: Seeds of the traversals: customers, parts and a supplier by their index.
CUSTOMER, PART, OTHER, SUPPLIER, NATION, REGION = 3 * SCALE + 1, 5 * SCALE + 1, 5 * SCALE + 2, 4 * SCALE + 1, 2 * SCALE, SCALE
BOTH_SQL = f"""{EDGES_SQL},
both_ends as (select start_node_index as a, end_node_index as b, type, true as forward from edges union all select end_node_index, start_node_index, type, false from edges)"""


def seeds(spark, *values: int):
    return spark.createDataFrame([(v,) for v in values], "index long")


@query("graph_nodes", f"with {NODES_SQL} select * from nodes")
def graph_nodes(spark, d):
    return star.nodes(spark, d)


@query("graph_edges", f"with {EDGES_SQL} select * from edges")
def graph_edges(spark, d):
    return star.edges(spark, d)


@query("node_types", f"with {NODES_SQL} select distinct type from nodes")
def node_types(spark, d):
    return G.node_types(star.nodes(spark, d))


@query("edge_types", f"with {EDGES_SQL} select distinct type from edges")
def edge_types(spark, d):
    return G.edge_types(star.OpenLinks(spark, d))


@query("degree", f"with {BOTH_SQL} select a as index, count(*) as degree, count(distinct b) as neighbours from both_ends group by a")
def degree(spark, d):
    return G.degrees(star.OpenLinks(spark, d))


@query("node_lookup", f"with {NODES_SQL} select * from nodes where index in ({CUSTOMER}, {PART}, 77)")
def node_lookup(spark, d):
    nodes = star.nodes(spark, d)
    return nodes.join(F.broadcast(seeds(spark, CUSTOMER, PART, 77)), "index", "left_semi").select("index", "name", "type", "summary")


@query("nodes_of_type", f"with {NODES_SQL} select index, name from nodes where type = 'supplier'")
def nodes_of_type(spark, d):
    return star.nodes(spark, d).where("type = 'supplier'").select("index", "name")


@query("neighbours_1hop", f"with {BOTH_SQL} select distinct a as seed, b as index from both_ends where a in ({CUSTOMER}, {PART})")
def neighbours_1hop(spark, d):
    return G.neighbours(star.OpenLinks(spark, d), seeds(spark, CUSTOMER, PART))


KHOP_SQL = f"""{BOTH_SQL.replace('edges as (', 'edges as materialized (')},
h1 as materialized (select cast({SUPPLIER} as bigint) as index union select distinct b from both_ends where a = {SUPPLIER})"""
KHOP2_SQL = f"""{KHOP_SQL.replace('both_ends as (', 'both_ends as materialized (')}, h2 as materialized (select index from h1 union select b from both_ends semi join h1 on a = h1.index)"""


@query("khop2_nodes", f"with {KHOP2_SQL} select index, cast(case when index = {SUPPLIER} then 0 when index in (select index from h1) then 1 else 2 end as bigint) as hops from h2")
def khop2_nodes(spark, d):
    return G.within_hops(star.OpenLinks(spark, d), seeds(spark, SUPPLIER), 2).select("index", F.col("hops").cast("long").alias("hops"))


def _around(spark, d, k: int, boundary: bool):
    links = star.OpenLinks(spark, d)
    return G.subgraph_edges(links, G.within_hops(links, seeds(spark, SUPPLIER), k), boundary)


@query("khop_edges_boundary", f"with {KHOP_SQL} select * from edges where start_node_index in (select index from h1) or end_node_index in (select index from h1)")
def khop_edges_boundary(spark, d):
    return _around(spark, d, 1, True)


@query("khop_edges_induced", f"with {KHOP_SQL} select * from edges where start_node_index in (select index from h1) and end_node_index in (select index from h1)")
def khop_edges_induced(spark, d):
    return _around(spark, d, 1, False)


@query("khop2_edges_induced", f"with {KHOP2_SQL} select * from edges semi join h2 x on start_node_index = x.index semi join h2 y on end_node_index = y.index")
def khop2_edges_induced(spark, d):
    return _around(spark, d, 2, False)


PATHS_SQL = f"""{BOTH_SQL}, u as (select distinct a, b, type from both_ends),
pairs(src, dst) as (values ({SUPPLIER}, {SUPPLIER + 1}), ({PART}, {OTHER}), ({NATION}, {REGION}), ({CUSTOMER}, {CUSTOMER})),
paths as (select src, dst, cast(null as bigint) as middle, x.type as first, cast(null as varchar) as second from pairs join u x on x.a = src and x.b = dst where src <> dst
 union select src, dst, x.b, x.type, y.type from pairs join u x on x.a = src join u y on y.a = x.b and y.b = dst where src <> dst and x.b <> src and x.b <> dst)"""


def _paths(spark, d):
    pairs = spark.createDataFrame([(SUPPLIER, SUPPLIER + 1), (PART, OTHER), (NATION, REGION), (CUSTOMER, CUSTOMER)], "src long, dst long")
    return G.short_paths(star.OpenLinks(spark, d), pairs)


@query("paths_len2", f"with {PATHS_SQL} select * from paths")
def paths_len2(spark, d):
    return _paths(spark, d)


@query("find_connections_typed", f"with {PATHS_SQL}, {NODES_SQL} select src, dst, middle, name, first, second from paths join nodes on middle = index where nodes.type = 'part' order by src, dst, middle limit 30")
def find_connections_typed(spark, d):
    nodes = star.nodes(spark, d).where("type = 'part'").select(F.col("index").alias("middle"), "name")
    return _paths(spark, d).join(nodes, "middle").select("src", "dst", "middle", "name", "first", "second").orderBy("src", "dst", "middle").limit(30)


@query("mediator_join", f"with {EDGES_SQL} select distinct s.end_node_index as mediator from edges s join edges t on s.end_node_index = t.end_node_index where s.start_node_index = {PART} and t.start_node_index = {OTHER}")
def mediator_join(spark, d):
    a, b = (star.OpenLinks(spark, d).starting_at([x]).where("forward").select(F.col("b").alias("mediator")) for x in (PART, OTHER))
    return a.join(b, "mediator").distinct()


@query("triplet_dedup", f"""with {BOTH_SQL}, t as (select a as source, type, b as target, forward from both_ends where type = 'PART_OF')
select source, type, target from (select *, row_number() over (partition by least(source, target), type, greatest(source, target) order by source, target) as n from t) where n = 1""")
def triplet_dedup(spark, d):
    both = G.undirected(star.edges(spark, d).where("type = 'PART_OF'")).select(F.col("a").alias("source"), "type", F.col("b").alias("target"))
    return G.one_per_triplet(both, [F.col("source"), F.col("target")])


@query("expand_15", f"""with {BOTH_SQL} select seed, type, other, forward, rank from (select a as seed, type, b as other, forward, row_number() over (partition by a order by type, b, forward desc) as rank
from both_ends where a in ({CUSTOMER}, {PART}, {SUPPLIER})) where rank <= 15""")
def expand_15(spark, d):
    return G.expand(star.OpenLinks(spark, d), seeds(spark, CUSTOMER, PART, SUPPLIER), 15)


@query("search_neighbourhood", f"""with {BOTH_SQL}, {NODES_SQL},
l as (select b as index, coalesce(list_sort(list(type) filter (not forward)), []) as f, coalesce(list_sort(list(type) filter (forward)), []) as t from both_ends where a = {SUPPLIER} group by b)
select index, name, type, array_to_string(f, ',') as from_types, array_to_string(t, ',') as to_types from (select * from l union all select {SUPPLIER}, [], []) join nodes using (index)""")
def search_neighbourhood(spark, d):
    found = G.neighbourhood(star.nodes(spark, d), star.OpenLinks(spark, d), SUPPLIER)
    return found.select("index", "name", "type", F.array_join("from_types", ",").alias("from_types"), F.array_join("to_types", ",").alias("to_types"))


@query("neighbours_by_edge_type", f"with {BOTH_SQL}, {NODES_SQL} select distinct index, name, nodes.type from both_ends join nodes on b = index where a = {PART} and both_ends.type = 'SUPPLIED_BY' and nodes.type = 'supplier'")
def neighbours_by_edge_type(spark, d):
    return G.neighbourhood(star.nodes(spark, d), star.OpenLinks(spark, d), PART, "supplier", "SUPPLIED_BY").select("index", "name", "type")


@query("node_edge_in_filters", f"with {BOTH_SQL}, {NODES_SQL} select distinct index, nodes.type from both_ends join nodes on b = index where a = {CUSTOMER} and nodes.type in ('nation', 'part') and both_ends.type in ('LOCATED_IN')")
def node_edge_in_filters(spark, d):
    near = star.OpenLinks(spark, d).starting_at([CUSTOMER]).where(F.col("type").isin("LOCATED_IN")).select(F.col("b").alias("index")).distinct()
    return star.nodes(spark, d).where(F.col("type").isin("nation", "part")).join(near, "index", "left_semi").select("index", "type")


@query("lossless_format", f"""with {BOTH_SQL}, {NODES_SQL}, l as (select b as index, list_sort(list(both_ends.type) filter (not forward)) as f, list_sort(list(both_ends.type) filter (forward)) as t from both_ends where a = {SUPPLIER} group by b)
select index, concat_ws(' ', case when t is not null then '-[' || array_to_string(t, ',') || ']->' end, '[' || index || '] ' || name || ' (' || type || ')', case when f is not null then '<-[' || array_to_string(f, ',') || ']-' end) as line from l join nodes using (index)""")
def lossless_format(spark, d):
    found = G.neighbourhood(star.nodes(spark, d), star.OpenLinks(spark, d), SUPPLIER).where(F.col("index") != SUPPLIER)
    arrow = lambda c, a, b: F.when(F.size(c) > 0, F.concat(F.lit(a), F.array_join(c, ","), F.lit(b)))
    node = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), "name", F.lit(" ("), "type", F.lit(")"))
    return found.select("index", F.concat_ws(" ", arrow("to_types", "-[", "]->"), node, arrow("from_types", "<-[", "]-")).alias("line"))


def _country(spark, d):
    """Suppliers, nations and regions with their links."""
    nodes = star.nodes(spark, d).where("type in ('supplier', 'nation', 'region')")
    edges = star.edges(spark, d).join(nodes.select(F.col("index").alias("start_node_index")), "start_node_index", "left_semi").where("type in ('LOCATED_IN', 'PART_OF')")
    return nodes, edges.select(F.col("start_node_index").alias("a"), F.col("end_node_index").alias("b"))


COUNTRY_SQL = f"""{NODES_SQL}, {EDGES_SQL}, cn as (select index from nodes where type in ('supplier', 'nation', 'region')),
ce as (select start_node_index as a, end_node_index as b from edges where type in ('LOCATED_IN', 'PART_OF') and start_node_index in (select index from cn))"""


@query("connected_components", f"""with recursive {COUNTRY_SQL}, l as (select a, b from ce union all select b, a from ce),
reach as (select index, index as other from cn union select r.index, l.b from reach r join l on r.other = l.a)
select index, min(other) as component from reach group by index""")
def connected_components(spark, d):
    return C.components(*_country(spark, d))


@query("community_label_propagation")
def community_label_propagation(spark, d):
    return C.community_levels(*_country(spark, d))


MEMBERS_SQL = f"""{COUNTRY_SQL}, members as (select index, case when index >= 4000000000000000 then s_nationkey else 100 + index % 5 end as community from cn left join supplier on index - 4000000000000000 = s_suppkey)"""


def _members(spark, d):
    """Given communities: suppliers by nation, the rest by their index."""
    nodes, links = _country(spark, d)
    suppliers = table(spark, d, "supplier").select((F.col("s_suppkey") + 4 * SCALE).alias("index"), F.col("s_nationkey").cast("long").alias("nation"))
    return nodes.join(suppliers, "index", "left").select("index", F.coalesce("nation", 100 + F.col("index") % 5).alias("community")), links


@query("community_modularity", f"""with {MEMBERS_SQL}, e as (select ca.community as ca, cb.community as cb from ce join members ca on a = ca.index join members cb on b = cb.index),
deg as (select c, count(*) as d from (select ca as c from e union all select cb from e) group by c), inn as (select ca as c, count(*) as l from e where ca = cb group by ca), t as (select sum(d) / 2.0 as m from deg)
select round(cast(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))) as double), 6) as modularity, count(*) as communities from deg left join inn using (c), t""")
def community_modularity(spark, d):
    return C.modularity(*_members(spark, d)).select(F.round("modularity", 6).alias("modularity"), "communities")


@query("community_nodes", f"with {MEMBERS_SQL} select 'community_lvl0_' || community as id, 0 as level, cast(community as bigint) as community, count(*) as entity_count, '' as summary from members group by community")
def community_nodes(spark, d):
    return C.materialised(_members(spark, d)[0].withColumn("level", F.lit(0)))


@query("community_inner_edges", f"""with {MEMBERS_SQL} select community, start_node_index, end_node_index, type, rank from (select cast(ca.community as bigint) as community, start_node_index, end_node_index, type, row_number() over (partition by ca.community order by start_node_index, end_node_index, type) as rank
from edges join members ca on start_node_index = ca.index join members cb on end_node_index = cb.index where ca.community = cb.community) where rank <= 20""")
def community_inner_edges(spark, d):
    return C.inner_edges(star.OpenLinks(spark, d), _members(spark, d)[0], 20)


@query("community_report", f"""with {MEMBERS_SQL},
ent as (select community, string_agg('- ' || name || ' (' || type || ')', chr(10) order by index) as e from (select community, m.index, name, type, row_number() over (partition by community order by m.index) as n from members m join nodes on nodes.index = m.index) where n <= 20 group by community),
ie as (select ca.community, start_node_index, end_node_index, type, row_number() over (partition by ca.community order by start_node_index, end_node_index, type) as r from edges join members ca on start_node_index = ca.index join members cb on end_node_index = cb.index where ca.community = cb.community),
lk as (select community, string_agg('[R' || r || '] ' || start_node_index || ' -[' || type || ']-> ' || end_node_index, chr(10) order by r) as l from ie where r <= 30 group by community)
select cast(c.community as bigint) as community, c.n as entity_count, 'Entities:' || chr(10) || e || chr(10) || 'Relationships:' || chr(10) || coalesce(l, '') as context from (select community, count(*) as n from members group by community) c join ent using (community) left join lk using (community)""")
def community_report(spark, d):
    return C.reports(_members(spark, d)[0], star.nodes(spark, d), star.OpenLinks(spark, d))


#: Folders of the communities of stored graphs, by session and source.
_COMMUNITIES: dict[tuple[str, str], str] = {}


def _whole(spark, d):
    """All nodes of the graph, and each of its edges once."""
    return star.nodes(spark, d).select("index"), G.directed(star.links(spark, d)).select(F.col("start_node_index").alias("a"), F.col("end_node_index").alias("b"))


def found_communities(spark, d):
    """(level, index, community) of the whole graph by modularity, at two levels, found once for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COMMUNITIES:
        C.ensure_checkpoints(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/communities-{uuid.uuid4().hex}"
        M.levels(*_whole(spark, d), rounds=6, most_passes=2).write.parquet(folder)
        _COMMUNITIES[key] = folder
    return spark.read.schema("level int, index long, community long").parquet(_COMMUNITIES[key])


@query("communities_found")
def communities_found(spark, d):
    return found_communities(spark, d)


@query("communities_modularity")
def communities_modularity(spark, d):
    nodes, links = _whole(spark, d)
    ways = {"modularity": found_communities(spark, d).where("level = 0"), "label propagation": C.label_propagation(nodes, links)}
    parts = [C.modularity(members.select("index", "community"), links).select(F.lit(name).alias("method"), F.round("modularity", 6).alias("modularity"), "communities") for name, members in ways.items()]
    return parts[0].union(parts[1])


@query("communities_listed")
def communities_listed(spark, d):
    return C.materialised(found_communities(spark, d))


@query("communities_report")
def communities_report(spark, d):
    members = found_communities(spark, d).where("level = 0").select("index", "community")
    return C.reports(members, star.nodes(spark, d), star.links(spark, d))


ANSWERS_SQL = f"{BOTH_SQL}, {NODES_SQL}, ans as (select index from nodes where type = 'customer' and index % 100 = 7)"


@query("answer_seeded_sample", f"""with {ANSWERS_SQL}, kept as (select index from ans order by md5(cast(index as varchar)), index limit 8),
rest as (select index from (select distinct b as index from both_ends where a in (select index from kept)) where index not in (select index from kept) order by md5(cast(index as varchar)), index limit 2)
select index from kept union all select index from rest""")
def answer_seeded_sample(spark, d):
    nodes = star.nodes(spark, d)
    answers = nodes.where("type = 'customer' and index % 100 = 7").select("index")
    return G.seeded_sample(nodes, star.OpenLinks(spark, d), answers, 10)[0]


@query("validated_answers", f"""with {NODES_SQL}, asked(pos, index) as (values (0, {PART}), (1, 77), (2, {CUSTOMER}), (3, {PART})),
ok as (select index, min(pos) as pos from asked group by index) select ok.index, pos, nodes.index is not null as found from ok left join nodes using (index)""")
def validated_answers(spark, d):
    asked = spark.createDataFrame([(0, PART), (1, 77), (2, CUSTOMER), (3, PART)], "pos int, index long").groupBy("index").agg(F.min("pos").alias("pos"))
    known = star.nodes(spark, d).select("index", F.lit(True).alias("found"))
    return asked.join(known, "index", "left").select("index", "pos", F.coalesce("found", F.lit(False)).alias("found"))


@query("resolve_ranked", f"with {NODES_SQL}, asked(rank, index) as (values (1, {PART}), (2, 77), (3, {CUSTOMER})) select cast(rank as bigint) as rank, asked.index, coalesce(name, '') as name, coalesce(type, 'UNKNOWN') as type from asked left join nodes using (index)")
def resolve_ranked(spark, d):
    asked = spark.createDataFrame([(1, PART), (2, 77), (3, CUSTOMER)], "rank long, index long")
    return asked.join(star.nodes(spark, d), "index", "left").select("rank", "index", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("type", F.lit("UNKNOWN")).alias("type"))


@query("acl_entities", """with e as (select l_partkey, list_sort(list(distinct o_orderpriority)) as docs from lineitem join orders on l_orderkey = o_orderkey group by l_partkey)
select l_partkey, array_to_string(docs, ',') as docs from e where list_has_any(docs, ['1-URGENT'])""")
def acl_entities(spark, d):
    owners = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("docs"))
    return owners.where(F.arrays_overlap("docs", F.array(F.lit("1-URGENT")))).select("l_partkey", F.array_join("docs", ",").alias("docs"))


@query("decoded_import", f"with {NODES_SQL}, codes(code, kind) as (values (0, 'region'), (1, 'nation')) select index, code, kind from nodes join codes on kind = type")
def decoded_import(spark, d):
    codes = spark.createDataFrame([(0, "region"), (1, "nation")], "code int, kind string")
    return star.nodes(spark, d).join(F.broadcast(codes), F.col("type") == F.col("kind")).select("index", "code", "kind")


@query("graph_schema", f"with {NODES_SQL}, {EDGES_SQL} select 'node' as part, type, count(*) as n from nodes group by type union all select 'edge', type, count(*) from edges group by type")
def graph_schema(spark, d):
    count = lambda df, part: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "type", "n")
    return count(star.nodes(spark, d), "node").union(count(star.edges(spark, d), "edge"))


ROLL_SQL = f"""{BOTH_SQL}, u as (select distinct a, b from both_ends), st(question, agent, index) as (values (1, 0, {SUPPLIER}), (1, 1, {SUPPLIER + 1})),
n1 as (select distinct question, agent, b as index from st join u on a = index where (question, agent, b) not in (select question, agent, index from st)),
k1 as (select question, agent, index from (select *, row_number() over (partition by question, agent order by index % 97 desc, index) as n from n1) where n <= 3),
n2 as (select distinct question, agent, b as index from k1 join u on a = index where (question, agent, b) not in (select * from st union all select * from k1)),
k2 as (select question, agent, index from (select *, row_number() over (partition by question, agent order by index % 97 desc, index) as n from n2) where n <= 3),
seen as (select *, 0 as step from st union all select *, 1 from k1 union all select *, 2 from k2),
roll as (select question, agent, index, row_number() over (partition by question, agent order by step, index) as pos from seen)"""


def _rollout(spark, d):
    start = spark.createDataFrame([(1, 0, SUPPLIER), (1, 1, SUPPLIER + 1)], "question int, agent int, index long")
    return A.rollout(start, star.OpenLinks(spark, d), lambda df: df.withColumn("score", F.col("index") % 97))


@query("agent_rollout", f"with {ROLL_SQL} select * from roll where pos <= 10")
def agent_rollout(spark, d):
    return _rollout(spark, d)


@query("agent_fusion", f"with {ROLL_SQL}, g as (select question, index as node, count(*) as votes, min(agent * 1000 + pos) as p from roll where pos <= 10 group by question, index) select question, node, votes, row_number() over (partition by question order by votes desc, p, node) as rank from g")
def agent_fusion(spark, d):
    lists = _rollout(spark, d).withColumnRenamed("index", "node")
    return U.votes(lists, "first_agent").select("question", "node", "votes", "rank")


@query("node_summaries", """select p_partkey, '- product: ' || p_name || chr(10) || '- brand: ' || case when p_size % 7 = 0 then 'Unknown' else p_brand end || case when p_size > 25 then chr(10) || '- size: ' || p_size else '' end as summary from part""")
def node_summaries(spark, d):
    from graphloom.functions.text import lines

    brand = F.when(F.col("p_size") % 7 == 0, "-1").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", lines(("product", F.col("p_name")), ("brand", brand), ("size", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")))).alias("summary"))


@query("product_summaries", """with r as (select l_partkey as k, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) as i, l_returnflag as s, l_linestatus as t, case when l_linenumber = 1 then 0 else cast(l_quantity as bigint) * 100 end as v from lineitem),
n as (select *, row_number() over (partition by k order by v desc, i) as m from r),
t as (select k, string_agg('#' || i || ':' || chr(10) || 'summary: ' || s || chr(10) || 'text: "' || t || '"', chr(10) order by v desc, i) as reviews from n where m <= 27 group by k)
select p_partkey, md5('- product: ' || p_name || case when p_size % 7 = 0 then '' else chr(10) || '- brand: ' || p_brand end || case when p_size % 2 = 0 then chr(10) || '- dimensions: ' || p_size || ' cm' || chr(10) || '- weight: ' || p_size || ' g' else '' end
|| chr(10) || '- description: ' || p_type || ' ' || p_brand || chr(10) || '- features: ' || chr(10) || '#1: ' || p_type || chr(10) || '#3: ' || p_size || coalesce(chr(10) || '- reviews: ' || chr(10) || reviews, '')
|| chr(10) || '- Q&A: ' || chr(10) || '#1:' || chr(10) || 'question: "size?"' || chr(10) || 'answer: "' || p_size || '"') as digest from part left join t on k = p_partkey""")
def product_summaries(spark, d):
    from graphloom.operators.summaries import described_product

    number = F.col("l_linenumber")
    place = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("summary"), F.col("l_linestatus").alias("reviewText"), F.when(number != 1, F.format_number(F.col("l_quantity").cast("long") * 100, 0)).alias("vote"))
    reviews = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list(place)).alias("reviews"))
    size = F.col("p_size").cast("string")
    dimensions = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(" cm ; "), size, F.lit(" g"))).otherwise("unknown")
    rows = table(spark, d, "part").join(reviews, "p_partkey", "left")
    found = described_product(
        F.col("p_name"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")), dimensions, F.array("p_type", "p_brand"), F.array(F.col("p_type"), F.lit("ASIN: B0"), size), F.col("reviews"), F.array(F.struct(F.lit("size?").alias("question"), size.alias("answer")))
    )
    return rows.select("p_partkey", F.md5(found).alias("digest"))


@query("counted_summaries", """select s_suppkey, case s_suppkey % 3 when 0 then '- author name: ' || replace(s_name, '-1', 'Unknown') when 1 then ' - field of study: ' || replace(s_name, '-1', 'Unknown') else ' - institution: ' || replace(s_name, '-1', 'Unknown') end
|| case when s_suppkey % 5 = 0 then '' else chr(10) || '- ' || case s_suppkey % 3 when 0 then 'author' when 1 then 'field' else 'institution' end || ' paper count: ' || s_suppkey end
|| case when s_suppkey % 7 = 0 then '' else chr(10) || '- ' || case s_suppkey % 3 when 0 then 'author' when 1 then 'field' else 'institution' end || ' citation count: ' || s_nationkey end as summary from supplier""")
def counted_summaries(spark, d):
    from graphloom.operators.summaries import counted

    key = F.col("s_suppkey")
    kind = F.when(key % 3 == 0, "author").when(key % 3 == 1, "field_of_study").otherwise("institution")
    found = counted(kind, F.col("s_name"), F.when(key % 5 == 0, -1).otherwise(key), F.when(key % 7 == 0, -1).otherwise(F.col("s_nationkey")))
    return table(spark, d, "supplier").select("s_suppkey", found.alias("summary"))


@query("column_pruned_scan", "select distinct l_partkey from lineitem where l_shipdate >= timestamp '1998-01-01 00:00:00'")
def column_pruned_scan(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp '1998-01-01 00:00:00'").select("l_partkey").distinct()
