"""Distances, standardisers, similarities, fusion and top results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, standardize, vectors
from ..operators import calibration, cluster, density, nearest, similarity
from . import roles
from .roles import table, with_roles

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns))


_COS = "1 - list_dot_product(i.embedding, q.embedding) / (sqrt(list_dot_product(i.embedding, i.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding)))"
_EUC = "list_distance(i.embedding, q.embedding)"
_L1 = "list_sum(list_transform(list_zip(i.embedding, q.embedding), lambda z: abs(z[1] - z[2])))"


def _knn_sql(distance: str, k: int) -> str:
    return with_roles("ref_item", "query_item") + f"""
, pairs as (select q.query_id, q.query_pos, i.contract_id, i.pos, {distance} as d from ref_item i, query_item q)
, ranked as (select *, row_number() over (partition by query_id, query_pos order by round(d, 9), contract_id, pos) as rank from pairs)
select query_id, query_pos, contract_id, pos, round(d, 6) + 0.0 as distance, rank::int as rank from ranked where rank <= {k}"""


@query("op_c3_cosine_knn", _knn_sql(_COS, 10))
def cosine_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items(roles.ref_item(spark, sf), roles.query_item(spark, sf), 10), "distance")


@query("op_c2_cosine_knn_block", _knn_sql(_COS, 10))
def cosine_knn_block(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items_block(roles.ref_item(spark, sf), roles.query_item(spark, sf), 10), "distance")


@query("op_c3_cosine_knn_indexed", _knn_sql(_COS, 10))
def cosine_knn_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items_indexed(roles.ref_item(spark, sf), roles.query_item(spark, sf), 10), "distance")


@query("op_c12_manhattan_match_indexed", _knn_sql(_L1, 1))
def manhattan_match_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items_indexed(roles.ref_item(spark, sf), roles.query_item(spark, sf), 1, "manhattan"), "distance")


@query("op_c1_euclidean_knn", _knn_sql(_EUC, 10))
def euclidean_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items(roles.ref_item(spark, sf), roles.query_item(spark, sf), 10, "euclidean"), "distance")


@query("op_c1_euclidean_knn_block", _knn_sql(_EUC, 10))
def euclidean_knn_block(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items_block(roles.ref_item(spark, sf), roles.query_item(spark, sf), 10, "euclidean"), "distance")


@query("op_c12_manhattan_match_block", _knn_sql(_L1, 1))
def manhattan_match_block(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items_block(roles.ref_item(spark, sf), roles.query_item(spark, sf), 1, "manhattan"), "distance")


@query("op_c12_manhattan_match", _knn_sql(_L1, 1))
def manhattan_match(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items(roles.ref_item(spark, sf), roles.query_item(spark, sf), 1, "manhattan"), "distance")


@query("op_c7_nearest_one", _knn_sql(_COS, 1))
def nearest_one(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_items(roles.ref_item(spark, sf), roles.query_item(spark, sf)), "distance")


@query(
    "op_c8_nearest_from_arrays",
    with_roles("ref_item", "query_item")
    + f""", pairs as (select q.query_id, q.query_pos, i.contract_id, i.pos, {_COS} as d from ref_item i, query_item q)
, ranked as (select *, row_number() over (partition by query_id, query_pos order by round(d, 9), contract_id, pos) as rank from pairs)
select query_id, query_pos::int as query_pos, contract_id, pos::int as pos, round(d, 6) + 0.0 as distance from ranked where rank <= 3""",
)
def nearest_from_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """From rows that hold arrays of vectors, as loaders give them, on both sides."""

    def grouped(rows: DataFrame, key: str, pos: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, "embedding"))).alias("s")).select(key, F.col("s.embedding").alias("embeddings"))

    items = nearest.flattened(grouped(roles.ref_item(spark, sf), "contract_id", "pos"), "contract_id")
    queries = nearest.flattened(grouped(roles.query_item(spark, sf), "query_id", "query_pos"), "query_id").withColumnRenamed("pos", "query_pos")
    return _rounded(nearest.nearest_items(items, queries, 3), "distance").drop("rank")


@query(
    "op_c11_clustered_nearest",
    with_roles("ref_item", "query_item")
    + f""", heads as (select embedding, min(struct_pack(c := contract_id, p := pos)) as head from ref_item group by embedding)
, pairs as (select q.query_id, q.query_pos, i.head, i.embedding, {_COS} as d from heads i, query_item q)
, ranked as (select *, row_number() over (partition by query_id, query_pos order by round(d, 9), head) as rank from pairs)
select query_id, query_pos, r.contract_id, r.pos, round(d, 6) + 0.0 as distance from ranked join ref_item r using (embedding) where rank <= 1""",
)
def clustered_nearest(spark: SparkSession, sf: str) -> DataFrame:
    items = roles.ref_item(spark, sf)
    return _rounded(nearest.clustered_nearest(items, nearest.identical_clusters(items), roles.query_item(spark, sf)), "distance").drop("cluster_id")


@query(
    "op_c11_epsilon_clusters",
    with_roles("ref_item")
    + f"""select i.contract_id * 5 + i.pos as vec_id, count(*) as n_links from ref_item i join ref_item q on i.contract_id * 5 + i.pos <> q.contract_id * 5 + q.pos and {_EUC} <= 1.05 group by 1""",
)
def epsilon_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links between vectors within a distance, found by cells of a grid over random projections, confirmed exactly."""
    vecs = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return cluster.epsilon_link_counts(vecs, 1.05)


#: Dense vectors, their clusters by reachability, and every vector's cluster, named by its smallest member.
_DENSE = with_roles("ref_item").replace("with ", "with recursive ", 1) + f""", u as (select contract_id * 5 + pos as id, embedding from ref_item),
near as (select i.id as a, q.id as b from u i, u q where {_COS} <= 0.72),
core as (select a from near group by a having count(*) >= 5),
edge as (select a, b from near join core using (a) where b in (select a from core)),
reach as (select a as id, a as seen from core union select r.id, e.b from reach r join edge e on e.a = r.seen),
root as (select id, min(seen) as root from reach group by 1),
big as (select root from root group by 1 having count(*) >= 5),
member as (select u.id, case when b.root is null then u.id else b.root end as cluster, b.root is not null as dense from u left join root r on r.id = u.id left join big b on b.root = r.root)
"""


@query("op_c11_density_clusters", _DENSE + "select id as vec_id, cluster, dense, count(*) over (partition by cluster) as n_members from member")
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of unit vectors that have five within 1.2 of each other; the rest by equal vectors."""
    found = density.density_clusters(roles.ref_item(spark, sf), 1.2).withColumn("vec_id", F.col("contract_id") * 5 + F.col("pos"))
    named = found.groupBy("cluster_id").agg(F.min("vec_id").alias("cluster"), F.count("*").alias("n_members"))
    return found.join(named, "cluster_id").select("vec_id", "cluster", "dense", "n_members")


@query(
    "op_c11_density_nearest",
    _DENSE
    + f""", {with_roles("query_item").removeprefix("with ").strip()}, best as (select query_id, query_pos, id, d from (select q.query_id, q.query_pos, i.id, {_COS} as d, row_number() over (partition by query_id, query_pos order by round({_COS}, 9), i.id) as rank from u i, query_item q) where rank = 1)
select query_id, query_pos, m.id as vec_id, round(d, 6) + 0.0 as distance from best join member b on b.id = best.id join member m on m.cluster = b.cluster""",
)
def density_nearest(spark: SparkSession, sf: str) -> DataFrame:
    items = roles.ref_item(spark, sf)
    clusters = density.density_clusters(items, 1.2)
    # Distances are rounded a query, not a member of its cluster.
    near = _rounded(density.nearest_clusters(items, clusters, roles.query_item(spark, sf)), "distance")
    return density.with_members(near, clusters).select("query_id", "query_pos", (F.col("contract_id") * 5 + F.col("pos")).alias("vec_id"), "distance")


def _place_sql(distance: str, k: int = 5) -> str:
    return with_roles("location", "query_location") + f"""
, pairs as (select q.query_id, l.contract_id, {distance} as d from location l, query_location q)
, ranked as (select *, row_number() over (partition by query_id order by round(d, 9), contract_id) as rank from pairs)
select query_id, contract_id, round(d, 6) + 0.0 as distance, rank::int as rank from ranked where rank <= {k}"""


_PLANAR = "sqrt(pow((l.lat - q.lat) * 111.319::double, 2) + pow((l.lon - q.lon) * 71.941::double, 2))"
_CIRCLE = "2 * 6371.009::double * asin(least(1.0, sqrt(pow(sin(radians(l.lat - q.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(q.lat)) * pow(sin(radians(l.lon - q.lon) / 2), 2))))"


@query("op_c5_planar_nearest", _place_sql(_PLANAR))
def planar_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_places(roles.location(spark, sf), roles.query_location(spark, sf), 5), "distance")


@query("op_c6_great_circle_nearest", _place_sql(_CIRCLE))
def great_circle_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_places(roles.location(spark, sf), roles.query_location(spark, sf), 5, "great_circle"), "distance")


def _geodesic_sql(rounds: int = 12, k: int = 5) -> str:
    """The inverse formula on the ellipsoid with a fixed number of rounds; near points settle in a few."""
    f, a = f"{geo.FLATTENING!r}::double", f"{geo.AXIS_KM!r}::double"
    angles = "sqrt(pow(cos(u2) * sin(l), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l), 2)) as ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l) as cs"
    more = "*, atan2(ss, cs) as s, case when ss = 0 then 0 else cos(u1) * cos(u2) * sin(l) / ss end as sa"
    mid = "*, 1 - sa * sa as c2, case when sa * sa = 1 then 0 else cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) end as m"
    factor = f"*, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) as c"

    def measured(name: str) -> str:
        return f"(select {factor} from (select {mid} from (select {more} from (select *, {angles} from {name}))))"

    steps = [f"g0 as (select q.query_id, p.contract_id, atan((1 - {f}) * tan(radians(p.lat))) as u1, atan((1 - {f}) * tan(radians(q.lat))) as u2, radians(q.lon - p.lon) as gap, radians(q.lon - p.lon) as l from location p, query_location q)"]
    for n in range(rounds):
        steps.append(f"g{n + 1} as (select query_id, contract_id, u1, u2, gap, gap + (1 - c) * {f} * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1))) as l from {measured(f'g{n}')})")
    b = f"({a} * (1 - {f}))"
    steps.append(f"k as (select *, c2 * ({a} * {a} - {b} * {b}) / ({b} * {b}) as e from {measured(f'g{rounds}')})")
    steps.append("w as (select *, 1 + e / 16384 * (4096 + e * (-768 + e * (320 - 175 * e))) as big, e / 1024 * (256 + e * (-128 + e * (74 - 47 * e))) as small from k)")
    steps.append(f"pairs as (select query_id, contract_id, {b} * big * (s - small * ss * (m + small / 4 * (cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) as d from w)")
    steps.append("ranked as (select *, row_number() over (partition by query_id order by round(d, 9), contract_id) as rank from pairs)")
    return with_roles("location", "query_location") + ", " + ", ".join(steps) + f" select query_id, contract_id, round(d, 6) + 0.0 as distance, rank::int as rank from ranked where rank <= {k}"


@query("op_c4_geodesic_nearest", _geodesic_sql())
def geodesic_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nearest.nearest_places(roles.location(spark, sf), roles.query_location(spark, sf), 5, "geodesic"), "distance")


def _calibration_sql(passes: int = 2, candidates: int = 1001) -> str:
    """Each pass tries evenly spaced factors between the neighbours of the best one so far."""
    steps = [f"d as (select (l.lat - q.lat) * 111.319::double as y, l.lon - q.lon as x, {_CIRCLE} as km from location l join query_location q on l.contract_id // 50 = q.query_id)", f"b0 as (select 0.0::double as low, {geo.KM_LATITUDE}::double as high, 0.0::double as factor, 0.0::double as error)"]
    for n in range(1, passes + 1):
        steps.append(f"f{n} as (select k, low + (high - low) * k / {candidates - 1} as factor, (high - low) / {candidates - 1} as step from b{n - 1}, (select unnest(range({candidates})) as k))")
        steps.append(f"e{n} as (select factor, step, sum(abs(sqrt(y * y + x * factor * x * factor) - km)) / sum(km) as error from f{n}, d group by 1, 2)")
        steps.append(f"b{n} as (select factor - step as low, factor + step as high, factor, error from e{n} order by error limit 1)")
    return with_roles("location", "query_location") + ", " + ", ".join(steps) + f" select round(factor, 3) as factor, round(error, 6) as error from b{passes}"


@query("op_r13_longitude_factor", _calibration_sql())
def longitude_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Kilometres to a degree of longitude at which planar distances of customers and the places asked for err least."""
    places, asked = roles.location(spark, sf), roles.query_location(spark, sf).select("query_id", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = places.withColumn("query_id", F.expr("contract_id div 50")).join(asked, "query_id").select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "lat_b", "lon_b")
    circle = geo.great_circle_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    factor, error = calibration.longitude_factor(pairs.withColumn("distance", circle))
    return spark.createDataFrame([(round(factor, 3), round(error, 6))], "factor double, error double")


@query("op_c10_location_valid", "select count(*) as n from customer where not (((c_custkey * 37) % 250) = 0 and ((c_custkey * 53) % 670) = 0)")
def location_valid(spark: SparkSession, sf: str) -> DataFrame:
    moved = roles.location(spark, sf).select((F.col("lat") - 48.55).alias("lat"), (F.col("lon") - 12.10).alias("lon"))
    return moved.where(geo.located(F.round("lat", 6), F.round("lon", 6))).agg(F.count("*").alias("n"))


@query(
    "op_c16_word_vector_similarity",
    with_roles("ref_item", "query_item") + f"select q.query_id, q.query_pos, max(round(1 / ({_EUC} + 1), 6)) as similarity from ref_item i, query_item q group by all",
)
def word_vector_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The largest similarity is that of the least distance."""
    least = nearest.least_distances(roles.ref_item(spark, sf), roles.query_item(spark, sf), "euclidean")
    return least.select("query_id", "query_pos", F.round(vectors.distance_similarity(F.col("distance")), 6).alias("similarity"))


@query("op_c18_constant_similarity", with_roles("query_item") + "select distinct query_id, 0.5::double as similarity from query_item")
def constant_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return roles.query_item(spark, sf).select("query_id").distinct().withColumn("similarity", F.lit(0.5))


@query(
    "op_d1_to_d5_standardizers",
    """select l_orderkey, l_linenumber, round(least(1, 1 / l_quantity), 6) as inverse_capped, round((2 - l_discount) / 2, 6) as cosine,
round(case when l_quantity - 2 <= 0 then 1 else least(1, 1 / ln(1 + l_quantity - 2)) end, 6) as log1p, round(l_tax * 0.1, 6) as weighted, round(l_quantity / 50, 6) as bounded from lineitem""",
)
def standardizers(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(standardize.inverse_capped(q), 6).alias("inverse_capped"),
        F.round(standardize.cosine(F.col("l_discount")), 6).alias("cosine"),
        F.round(standardize.log1p(q - 2), 6).alias("log1p"),
        F.round(standardize.weighted(F.col("l_tax")), 6).alias("weighted"),
        F.round(standardize.bounded(q, 50.0), 6).alias("bounded"),
    )


@query("op_d6_random_bias", "select s_suppkey, true as inside from supplier")
def random_bias(spark: SparkSession, sf: str) -> DataFrame:
    biased = standardize.random_bias(F.lit(2.0), 0.25, seed=7)
    return table(spark, sf, "supplier").select("s_suppkey", biased.alias("b")).select("s_suppkey", F.col("b").between(1.5, 2.0).alias("inside"))


ITEMS = f""", mean as (select query_id, contract_id, sum(s * s) / sum(s) as similarity from (select q.query_id, i.contract_id, (2 - ({_COS})) / 2 as s from {{items}} i, query_item q) group by all)"""
PLACES = f""", near as (select query_id, contract_id, case when d <= 0 then 1 else least(1, 1 / ln(1 + d)) end as similarity from (select q.query_id, l.contract_id, {_PLANAR} as d from location l, query_location q))"""


def top_sql(source: str, k: int) -> str:
    return f"""
select query_id, contract_id, round(similarity, 6) as similarity, rank::int as rank from
(select *, row_number() over (partition by query_id order by round(similarity, 9) desc, contract_id) as rank from ({source})) where rank <= {k}"""


@query("op_e1_item_similarity", with_roles("ref_item", "query_item") + f"select q.query_id, i.contract_id, round(sum((2 - ({_COS})) / 2), 6) as total from ref_item i, query_item q group by all")
def item_similarity(spark: SparkSession, sf: str) -> DataFrame:
    sums = similarity.item_sums(roles.ref_item(spark, sf), roles.query_item(spark, sf))
    return sums.select("query_id", "contract_id", F.round("s1", 6).alias("total"))


@query("op_e2_self_weighted_mean", "select l_suppkey, round(sum(l_discount * l_discount) / nullif(sum(l_discount), 0), 6) as similarity from lineitem group by 1 having sum(l_discount) <> 0")
def self_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(similarity.self_weighted_mean(table(spark, sf, "lineitem"), ("l_suppkey",), "l_discount"), "similarity")


@query("op_e3_group_weighted_mean", "select l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as similarity from lineitem group by 1")
def group_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(similarity.self_weighted_mean(table(spark, sf, "lineitem"), ("l_suppkey",), "l_discount", "l_quantity"), "similarity")


@query("op_e4_contract_similarity_topk", with_roles("ref_item", "query_item") + ITEMS.format(items="ref_item") + top_sql("select * from mean", 10))
def contract_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(similarity.fused_top({"subject": (roles.ref_item(spark, sf), roles.query_item(spark, sf))}, 10), "similarity")


@query("op_c9_entity_similarity_topk", with_roles("entity_item", "query_item") + ITEMS.format(items="entity_item") + top_sql("select * from mean", 3))
def entity_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(similarity.fused_top({"entity_subject": (roles.entity_item(spark, sf), roles.query_item(spark, sf))}, 3), "similarity")


@query("op_e6_location_similarity_topk", with_roles("location", "query_location") + PLACES + top_sql("select * from near", 10))
def location_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(similarity.top_by_place(roles.location(spark, sf), roles.query_location(spark, sf), 10), "similarity")


def _fused(spark: SparkSession, sf: str, parts: tuple[str, ...], k: int) -> DataFrame:
    queries = roles.query_item(spark, sf)
    every = {
        "subject": (roles.ref_item(spark, sf), queries),
        "locality": (roles.location(spark, sf), roles.query_location(spark, sf)),
        "entity_subject": (roles.entity_item(spark, sf), queries),
    }
    return _rounded(similarity.fused_top({p: every[p] for p in parts}, k), "similarity")


FUSE = ", mean_entity as (select query_id, contract_id, sum(s * s) / sum(s) as similarity from (select q.query_id, i.contract_id, (2 - (" + _COS + ")) / 2 as s from entity_item i, query_item q) group by all)"
THREE = "select query_id, contract_id, sum(w * similarity) / 1.2 as similarity from (select *, 1.0::double as w from mean union all select *, 0.1::double from near union all select *, 0.1::double from mean_entity) group by all"
_TWO = "select query_id, contract_id, sum(w * similarity) / 1.1 as similarity from (select *, 1.0::double as w from mean union all select *, 0.1::double from near) group by all"
_ROLES = with_roles("ref_item", "query_item", "entity_item", "location", "query_location")


@query("op_e7_weighted_fusion_topk", _ROLES + ITEMS.format(items="ref_item") + PLACES + FUSE + top_sql(THREE, 10))
def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, ("subject", "locality", "entity_subject"), 10)


@query("op_e8_component_subset_topk", _ROLES + ITEMS.format(items="ref_item") + PLACES + top_sql(_TWO, 10))
def component_subset(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, ("subject", "locality"), 10)


@query(
    "op_e6_first_address",
    "select s_nationkey as query_id, round(min_by(48.55::double + ((s_suppkey * 37) % 250) / 100.0::double, s_suppkey), 6) as lat, round(min_by(12.10::double + ((s_suppkey * 53) % 670) / 100.0::double, s_suppkey), 6) as lon from supplier group by 1",
)
def first_address(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("pos"), F.expr("48.55D + ((s_suppkey * 37) % 250) / 100D").alias("lat"), F.expr("12.10D + ((s_suppkey * 53) % 670) / 100D").alias("lon"))
    return _rounded(similarity.first_places(rows), "lat", "lon")


@query("op_f1_topk_per_group", "select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank::int as rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 3")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return nearest.top_k(rows, F.col("l_extendedprice").desc(), 3, ["l_suppkey"], ["l_orderkey", "l_linenumber"])
