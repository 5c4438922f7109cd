"""The registered queries of the graph and record operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicates import Term, three_way
from tessera.graph import components as wcc
from tessera.graph import model, program, ranking, traversal, triangles
from tessera.operators import joins, longitem, mutation, scans, sets, sorting, stats
from tessera.plans.lineage import shared_dir, written
from tessera.sources import generate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Scans and predicates

_PART = "SELECT p_partkey, p_name, p_size FROM part WHERE "
_TERMS = [Term("p_size", ">=", 10), Term("p_size", "<", 40), Term("p_brand", "!=", "Brand#11")]


def _parts(spark: SparkSession, folder: str, connective: str) -> DataFrame:
    return scans.file_scan(read(spark, folder, "part"), _TERMS, connective).select("p_partkey", "p_name", "p_size")


@query(_PART + "p_size >= 10 AND p_size < 40 AND p_brand <> 'Brand#11'")
def scan_and(spark, folder):
    return _parts(spark, folder, "and")


@query(_PART + "p_size >= 10 OR p_size < 40 OR p_brand <> 'Brand#11'")
def scan_or(spark, folder):
    return _parts(spark, folder, "or")


@query(_PART + "NOT (p_size >= 10 AND p_size < 40 AND p_brand <> 'Brand#11')")
def scan_not(spark, folder):
    return _parts(spark, folder, "not")


@query(_PART + "true")
def scan_none(spark, folder):
    return _parts(spark, folder, "none")


@query("SELECT c_custkey, c_name FROM customer WHERE substring(c_mktsegment, 1, 1) <> 'B'")
def prefix_filter(spark, folder):
    return scans.file_scan(read(spark, folder, "customer"), [Term("c_mktsegment", "!=", "B", 1)]).select("c_custkey", "c_name")


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE "


def _orders(spark: SparkSession, folder: str, **bounds) -> DataFrame:
    return scans.index_scan(read(spark, folder, "orders"), "o_orderkey", ordered=False, **bounds).select("o_orderkey", "o_custkey", "o_totalprice")


@query(_ORDERS + "o_orderkey BETWEEN 100 AND 900")
def index_range_inclusive(spark, folder):
    return _orders(spark, folder, lower=100, upper=900)


@query(_ORDERS + "o_orderkey > 100 AND o_orderkey < 900")
def index_range_strict(spark, folder):
    return _orders(spark, folder, lower=100, upper=900, lower_op=">", upper_op="<")


@query(_ORDERS + "o_orderkey >= 700")
def index_open_bound(spark, folder):
    return _orders(spark, folder, lower=700)


@query(_ORDERS + "o_orderkey = 123")
def index_equal(spark, folder):
    return _orders(spark, folder, lower=123, lower_op="=")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey = 42 AND l_quantity >= 10")
def hash_lookup(spark, folder):
    return scans.hash_scan(read(spark, folder, "lineitem"), "l_partkey", 42, [Term("l_quantity", ">=", 10)]).select("l_orderkey", "l_partkey", "l_quantity")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return scans.numbered(read(spark, folder, "customer").select("c_name", "c_acctbal", "c_custkey"), "c_acctbal", "c_custkey")


_NUMBERED = "(SELECT c_name, c_acctbal, c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rid FROM customer)"


@query(f"SELECT rid, c_custkey, c_name FROM {_NUMBERED} WHERE rid = 17")
def rid_lookup(spark, folder):
    return scans.lookup(_numbered(spark, folder), 17).select("rid", "c_custkey", "c_name")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1")
def fetch_first(spark, folder):
    return scans.fetch_first(read(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1")
def fetch_last(spark, folder):
    return scans.fetch_last(read(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query(f"SELECT rid, c_custkey, lead(c_custkey) OVER (ORDER BY rid) AS next_c_custkey FROM {_NUMBERED}")
def fetch_next(spark, folder):
    return scans.fetch_next(_numbered(spark, folder), ["c_custkey"]).select("rid", "c_custkey", "next_c_custkey")


@query(f"SELECT rid, c_custkey, lag(c_custkey) OVER (ORDER BY rid) AS previous_c_custkey FROM {_NUMBERED}")
def fetch_previous(spark, folder):
    return scans.fetch_previous(_numbered(spark, folder), ["c_custkey"]).select("rid", "c_custkey", "previous_c_custkey")


@query(f"SELECT rid, c_custkey FROM {_NUMBERED} WHERE rid >= 50")
def set_scan(spark, folder):
    return scans.from_position(_numbered(spark, folder), 50).select("rid", "c_custkey")


@query(f"SELECT rid, c_custkey FROM {_NUMBERED} WHERE (c_acctbal, rid) > (500.0, 3)")
def bookmark(spark, folder):
    return scans.from_bookmark(_numbered(spark, folder), "c_acctbal", 500.0, 3).select("rid", "c_custkey")


# Sorting, sets, joins, cardinalities


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def sort_file(spark, folder):
    return sorting.sort(read(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_acctbal", "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_top20(spark, folder):
    return sorting.top(read(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 60")
def clustered_sort(spark, folder):
    path = f"{shared_dir(spark)}/tessera/clustered-{uuid.uuid4().hex}"
    laid = sorting.clustered(read(spark, folder, "orders").select("o_orderkey", "o_custkey"), path, "o_custkey")
    return scans.index_scan(laid, "o_custkey", 10, 60, ordered=False)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_set(spark, folder):
    return sets.distinct(read(spark, folder, "lineitem"), "l_partkey", "l_suppkey")


_A, _B = "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 45", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity <= 5"


def _key_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, folder, "lineitem")
    return tuple(lines.where(c).select(F.col("l_partkey").alias("k")).distinct() for c in ("l_quantity >= 45", "l_quantity <= 5"))


@query(f"({_A}) UNION ({_B})")
def set_union(spark, folder):
    return sets.union(*_key_sets(spark, folder))


@query(f"({_A}) INTERSECT ({_B})")
def set_intersect(spark, folder):
    return sets.intersect(*_key_sets(spark, folder))


@query(f"({_A}) EXCEPT ({_B})")
def set_except(spark, folder):
    return sets.difference(*_key_sets(spark, folder))


@query("SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey < 50 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey BETWEEN 50 AND 99")
def unique_insert(spark, folder):
    rows = read(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    more = rows.where("k BETWEEN 20 AND 99")
    return sets.unique_insert(rows.where("k < 50"), more.unionByName(more), "k")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violation(spark, folder):
    return sets.duplicates(read(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


def _self_join(op: str) -> str:
    return f"SELECT a.c_nationkey, a.c_custkey AS left_c_custkey, b.c_custkey AS right_c_custkey FROM customer a JOIN customer b USING (c_nationkey) WHERE a.c_acctbal {op} 9000 AND b.c_acctbal {op} 9000"


@query(_self_join(">"))
def self_equi_join(spark, folder):
    return joins.self_equi_join(read(spark, folder, "customer"), "c_nationkey", ["c_custkey"], F.col("c_acctbal") > 9000)


@query(_self_join(">="))
def index_nl_join(spark, folder):
    return joins.self_equi_join(read(spark, folder, "customer"), "c_nationkey", ["c_custkey"], F.col("c_acctbal") >= 9000)


@query(f"SELECT p.p_partkey, n.rid, n.c_name FROM (SELECT p_partkey, p_partkey % 100 AS pointer FROM part) p JOIN {_NUMBERED} n ON p.pointer = n.rid")
def pointer_join(spark, folder):
    pointers = read(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 100).alias("pointer"))
    return joins.pointer_join(pointers, "pointer", _numbered(spark, folder)).select("p_partkey", "rid", "c_name")


@query("SELECT a.s_suppkey AS x, b.s_suppkey AS y, CASE WHEN a.s_acctbal < b.s_acctbal THEN -1 WHEN a.s_acctbal > b.s_acctbal THEN 1 ELSE 0 END AS ordering FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def ridcompare_join(spark, folder):
    s = read(spark, folder, "supplier")
    return joins.compare_join(s, s, "s_suppkey", "<", "s_suppkey", "s_nationkey").select(F.col("l.s_suppkey").alias("x"), F.col("r.s_suppkey").alias("y"), three_way(F.col("l.s_acctbal"), F.col("r.s_acctbal")).alias("ordering"))


def _rich(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, folder, "customer").select("c_custkey", "c_name"), read(spark, folder, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, folder):
    return joins.semi(*_rich(spark, folder), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, folder):
    return joins.anti(*_rich(spark, folder), "c_custkey")


@query("SELECT count(*) AS records FROM lineitem")
def record_card(spark, folder):
    return stats.record_card(read(spark, folder, "lineitem"))


@query("SELECT count(DISTINCT l_partkey) AS keys FROM lineitem")
def key_card(spark, folder):
    return stats.key_card(read(spark, folder, "lineitem"), "l_partkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_count(spark, folder):
    return stats.group_count(read(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT count(*) AS records FROM lineitem WHERE l_quantity > 25")
def count_qualifying(spark, folder):
    return stats.record_card(scans.file_scan(read(spark, folder, "lineitem"), [Term("l_quantity", ">", 25)]))


# Mutation, long items


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer")
def bulk_update(spark, folder):
    return mutation.update(read(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") < 5, {"c_nationkey": F.col("c_nationkey") + 1})


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey BETWEEN 5 AND 15)")
def range_delete(spark, folder):
    return mutation.delete(read(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey").between(5, 15))


@query("SELECT c_custkey, c_nationkey + 1 AS c_nationkey FROM customer WHERE NOT (c_nationkey + 1 BETWEEN 5 AND 15) UNION ALL SELECT 1000000 + c_custkey, 3 FROM customer WHERE c_custkey < 10")
def update_delete_insert(spark, folder):
    rows = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    aged = mutation.update(rows, F.lit(True), {"c_nationkey": F.col("c_nationkey") + 1})
    more = rows.where("c_custkey < 10").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(3).alias("c_nationkey"))
    return mutation.insert(mutation.delete(aged, F.col("c_nationkey").between(5, 15)), more)


@query("SELECT l_partkey AS key, l_orderkey AS rid FROM lineitem WHERE l_quantity >= 49 EXCEPT SELECT l_partkey, l_orderkey FROM lineitem WHERE l_quantity <= 2")
def index_pairs(spark, folder):
    pairs = [read(spark, folder, "lineitem").where(c).select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("rid")) for c in ("l_quantity >= 49", "l_quantity <= 2")]
    return mutation.delete_index(mutation.insert_index(pairs[0].limit(0), pairs[0]), pairs[1])


def _texts(spark: SparkSession, folder: str, made) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", made.alias("part"))


@query("SELECT doc_id, substring(text, 6, 20) AS part FROM documents")
def long_read(spark, folder):
    return _texts(spark, folder, longitem.read(F.col("text"), 5, 20))


@query("SELECT doc_id, substring(text, 1, 6) || '<new>' || substring(text, 7) AS part FROM documents")
def long_insert(spark, folder):
    return _texts(spark, folder, longitem.insert_after(F.col("text"), 5, F.lit("<new>")))


@query("SELECT doc_id, substring(text, 1, 5) || substring('<new>', 1, greatest(length(text) - 5, 0)) || substring(text, 11) AS part FROM documents")
def long_update(spark, folder):
    return _texts(spark, folder, longitem.overwrite(F.col("text"), 5, F.lit("<new>")))


@query("SELECT doc_id, substring(text, 1, 5) || substring(text, 16) AS part FROM documents")
def long_delete(spark, folder):
    return _texts(spark, folder, longitem.delete(F.col("text"), 5, 10))


@query("SELECT doc_id, length(text) AS part FROM documents")
def long_length(spark, folder):
    return _texts(spark, folder, longitem.length_to_nul(F.col("text")).cast("long"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, '.'), lambda s, i: i % 2 = 1), '.') AS part FROM documents")
def text_alternate(spark, folder):
    return _texts(spark, folder, longitem.alternate_sentences(F.col("text")))


# Graphs: customers and parts that were ordered together (G1), orders and returned parts (G2), parts of one order (G3)

_G1 = "SELECT DISTINCT o_custkey AS src, l_partkey + 1000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_G2 = "SELECT DISTINCT l_orderkey AS src, l_partkey + 10000000 AS dst FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R'"
_G3 = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_quantity >= 40 AND b.l_quantity >= 40"


def g1(spark: SparkSession, folder: str) -> DataFrame:
    joined = read(spark, folder, "orders").join(read(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).distinct()


def g2(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").where("l_quantity >= 50 AND l_returnflag = 'R'")
    return lines.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10000000).alias("dst")).distinct()


def g3(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").where("l_quantity >= 40").select("l_orderkey", "l_partkey")
    pairs = lines.withColumnRenamed("l_partkey", "src").join(lines.withColumnRenamed("l_partkey", "dst"), "l_orderkey")
    return pairs.where("src < dst").select("src", "dst").distinct()


_SYM = f"g AS ({_G1}), e AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
_LEVELS = f"WITH RECURSIVE {_SYM}, walk(id, level) USING KEY (id) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, min(w.level) + 1 FROM walk w JOIN e ON e.src = w.id LEFT JOIN recurring.walk r ON r.id = e.dst WHERE r.id IS NULL GROUP BY e.dst) "


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.bfs(model.symmetric(g1(spark, folder)), 0)


@query(_LEVELS + "SELECT level, count(*) AS n FROM walk GROUP BY level")
def bfs_levels(spark, folder):
    return _levels(spark, folder).groupBy("level").agg(F.count("*").alias("n"))


@query(_LEVELS + "SELECT level - 1 AS iteration, count(*) AS visited FROM walk WHERE level > 0 GROUP BY level")
def bfs_log(spark, folder):
    return traversal.bfs_log(_levels(spark, folder))


@query(_LEVELS + "SELECT id FROM walk")
def reachable(spark, folder):
    return _levels(spark, folder).select("id")


@query(_LEVELS + "SELECT level AS hops FROM walk WHERE id = 1000007")
def shortest_path_len(spark, folder):
    return traversal.shortest_path(model.symmetric(g1(spark, folder)), 0, 1000007).agg(F.max("pos").cast("int").alias("hops"))


@query(
    f"WITH RECURSIVE {_SYM}, walk(id, level, parent) USING KEY (id) AS (SELECT 0::BIGINT, 0, NULL::BIGINT UNION SELECT e.dst, min(w.level) + 1, min(w.id) FROM walk w JOIN e ON e.src = w.id LEFT JOIN recurring.walk r ON r.id = e.dst WHERE r.id IS NULL GROUP BY e.dst), "
    "tree AS MATERIALIZED (SELECT * FROM walk), back(pos, id, parent) AS (SELECT level::BIGINT, id, parent FROM tree WHERE id = 1000007 UNION ALL SELECT t.level::BIGINT, t.id, t.parent FROM back b JOIN tree t ON t.id = b.parent) SELECT pos, id FROM back"
)
def shortest_path(spark, folder):
    return traversal.shortest_path(model.symmetric(g1(spark, folder)), 0, 1000007)


@query(
    f"WITH RECURSIVE g AS MATERIALIZED ({_G3}), adj AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS near FROM (SELECT src, dst FROM g UNION SELECT dst, src FROM g) GROUP BY src), "
    "walk(position, node, stack, marked) AS (SELECT 0::BIGINT, 1::BIGINT, []::BIGINT[], [1]::BIGINT[] UNION ALL SELECT position + 1, s[len(s)], s[:len(s) - 1], m FROM "
    "(SELECT position, stack || fresh AS s, marked || fresh AS m FROM (SELECT w.*, list_filter(coalesce(a.near, []), lambda x: NOT list_contains(w.marked, x)) AS fresh FROM walk w LEFT JOIN adj a ON a.src = w.node)) WHERE len(s) > 0) "
    "SELECT position, node AS id FROM walk"
)
def dfs_order(spark, folder):
    return traversal.dfs(model.symmetric(g3(spark, folder)), 1)


_LABELS = f"WITH RECURSIVE g AS ({_G2}), v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), e AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), reach(id, other) AS (SELECT id, id FROM v UNION SELECT r.id, e.dst FROM reach r JOIN e ON e.src = r.other), labels AS (SELECT id, min(other) AS label FROM reach GROUP BY id) "


@query(_LABELS + "SELECT id, label FROM labels")
def wcc_labels(spark, folder):
    return wcc.weakly_connected(g2(spark, folder))


@query(_LABELS + "SELECT label, count(*) AS size FROM labels GROUP BY label")
def wcc_sizes(spark, folder):
    return wcc.component_sizes(wcc.weakly_connected(g2(spark, folder)))


@query(
    _LABELS
    + ", every AS (SELECT id, label FROM labels UNION SELECT p_partkey + 10000000, p_partkey + 10000000 FROM part WHERE p_partkey + 10000000 NOT IN (SELECT id FROM v)), sizes AS (SELECT count(*) AS n FROM every GROUP BY label) SELECT count(*) AS total_components, count(*) FILTER (n = 1) AS size_one, count(*) FILTER (n > 1) AS larger FROM sizes"
)
def wcc_summary(spark, folder):
    parts = read(spark, folder, "part").select((F.col("p_partkey") + 10000000).alias("id"))
    return wcc.component_summary(wcc.weakly_connected(g2(spark, folder), parts))


@query(_LABELS + "SELECT id, label FROM labels")
def vertex_program_wcc(spark, folder):
    edges = model.symmetric(g2(spark, folder))
    return program.run(program.MinLabel(), model.vertices(edges), edges).state


def _pagerank_sql(k: int) -> str:
    steps = [f"g AS MATERIALIZED ({_G3}), v AS MATERIALIZED (SELECT src AS id FROM g UNION SELECT dst FROM g), n AS (SELECT count(*) AS n FROM v), d AS MATERIALIZED (SELECT src, count(*) AS degree FROM g GROUP BY src), r1 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for i in range(2, k + 1):
        steps.append(
            f"s{i} AS (SELECT g.dst AS id, sum(r.rank / d.degree) AS s FROM g JOIN r{i - 1} r ON r.id = g.src JOIN d ON d.src = g.src GROUP BY g.dst), r{i} AS MATERIALIZED (SELECT v.id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM v CROSS JOIN n LEFT JOIN s{i} ON s{i}.id = v.id)"
        )
    return f"WITH {', '.join(steps)} "


@query(_pagerank_sql(5) + "SELECT id, round(rank, 9) AS rank FROM r5")
def pagerank_k5(spark, folder):
    return ranking.pagerank(g3(spark, folder), 5).select("id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(5) + "SELECT id, round(rank, 9) AS rank FROM r5 ORDER BY round(rank, 9) DESC, id LIMIT 20")
def pagerank_top20(spark, folder):
    return sorting.top(pagerank_k5(spark, folder), "rank", 20, "id")


_DEGREE = f"WITH g AS ({_G3}), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY id) "


@query(_DEGREE + "SELECT id, degree FROM d")
def degree(spark, folder):
    return model.degree(g3(spark, folder))


@query(_DEGREE + "SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS position FROM d")
def degree_order(spark, folder):
    return model.degree_order(g3(spark, folder))


_TRIANGLES = f"WITH g AS MATERIALIZED ({_G3}), t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM g x JOIN g y ON x.dst = y.src JOIN g z ON z.src = x.src AND z.dst = y.dst) "


@query(_TRIANGLES + "SELECT count(*) AS triangles FROM t")
def triangle_total(spark, folder):
    return triangles.triangle_total(g3(spark, folder))


@query(_TRIANGLES + "SELECT id, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id")
def triangle_per_vertex(spark, folder):
    return triangles.triangles_per_vertex(g3(spark, folder))


@query(f"WITH g AS MATERIALIZED ({_G3}), e AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g) SELECT g.src AS a, g.dst AS b, (SELECT count(*) FROM e x JOIN e y ON x.dst = y.dst WHERE x.src = g.src AND y.src = g.dst) AS common FROM g")
def common_neighbours(spark, folder):
    edges = g3(spark, folder)
    return model.common_neighbours(edges, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def _traverse_sql(a: str, b: str, root: str, edges: str = _G3, depth: int = 3) -> str:
    return f"WITH RECURSIVE g AS MATERIALIZED ({edges}), walk(depth, id) AS (SELECT 0, ({root})::BIGINT UNION ALL SELECT depth + 1, g.{b} FROM walk JOIN g ON g.{a} = walk.id WHERE depth < {depth}) SELECT depth, id, count(*) AS paths FROM walk GROUP BY ALL"


@query(_traverse_sql("src", "dst", "1"))
def traverse_fwd_d3(spark, folder):
    return traversal.paths(g3(spark, folder), 1, 3)


@query(_traverse_sql("dst", "src", "SELECT max(dst) FROM g"))
def traverse_rev_d3(spark, folder):
    """From the part of largest number, into which all its arcs lead."""
    edges = written(g3(spark, folder), "edges")
    return traversal.paths(model.reverse(edges), edges.agg(F.max("dst")).first()[0], 3)


#: Parts of the generated part graph: the size of the published traversal figures.
PARTS = 20_000
_R = "((partId * 48271 + ({} * 40692 + {} * 69621 + 7)) % 2147483647 * 16807 % 2147483647)"
_PART_LINKS = (
    f"SELECT partId AS src, CASE WHEN {_R.format(5, 'pos')} % 10 < 9 THEN ((partId - 1 + {_R.format(6, 'pos')} % {PARTS // 100} - {PARTS // 200}) % {PARTS} + {PARTS}) % {PARTS} + 1 ELSE {_R.format(6, 'pos')} % {PARTS} + 1 END AS dst "
    f"FROM (SELECT unnest(range(1, {PARTS} + 1)) AS partId) CROSS JOIN (SELECT unnest(range(3)) AS pos)"
)


def _part_links(spark: SparkSession) -> DataFrame:
    return generate.part_graph(spark, PARTS)[1].select("src", "dst")


@query(_traverse_sql("src", "dst", "1", _PART_LINKS, 7))
def part_traverse_fwd_d7(spark, folder):
    return traversal.paths(_part_links(spark), 1, 7)


@query(_traverse_sql("dst", "src", "150", _PART_LINKS, 7))
def part_traverse_rev_d7(spark, folder):
    return traversal.paths(model.reverse(_part_links(spark)), 150, 7)


# Binary trees of objects: six levels, 1-based heap order inside each of N_TREES trees

N_TREES, TREE = 50, 63
_NODES = f"nodes AS MATERIALIZED (SELECT o * {TREE} + i AS rid, CASE WHEN 2 * i <= {TREE} THEN o * {TREE} + 2 * i END AS \"left\", CASE WHEN 2 * i + 1 <= {TREE} THEN o * {TREE} + 2 * i + 1 END AS \"right\", i * 10 AS value FROM (SELECT unnest(range({N_TREES})) AS o) CROSS JOIN (SELECT unnest(range(1, {TREE} + 1)) AS i))"
_READ = f"WITH RECURSIVE {_NODES}, walk(root, rid, level) AS (SELECT rid, rid, 0 FROM nodes WHERE (rid - 1) % {TREE} = 0 UNION ALL SELECT root, child, level + 1 FROM (SELECT w.root, w.level, unnest([n.left, n.right]) AS child FROM walk w JOIN nodes n USING (rid)) WHERE child IS NOT NULL AND level < {{}} AND {{}}) "


def _nodes(spark: SparkSession) -> DataFrame:
    i = F.col("id") % TREE + 1
    child = lambda k: F.when(2 * i + k <= TREE, F.col("id") - F.col("id") % TREE + 2 * i + k)
    return spark.range(N_TREES * TREE).select((F.col("id") + 1).alias("rid"), child(0).alias("left"), child(1).alias("right"), (i * 10).alias("value"))


def _roots(spark: SparkSession) -> DataFrame:
    return _nodes(spark).where((F.col("rid") - 1) % TREE == 0).select("rid")


@query(_READ.format(2, "true") + "SELECT root, rid, level FROM walk")
def tree_read_d2(spark, folder):
    return traversal.tree_read(_nodes(spark), _roots(spark), 2)


_FOLLOW = "child * 48271 % 2147483647 % 10 < 8"


@query(_READ.format(6, _FOLLOW) + "SELECT root, rid, level FROM walk")
def tree_partial_descent(spark, folder):
    """Four in five children are followed, by a hash of their own number."""
    return traversal.tree_read(_nodes(spark), _roots(spark), 6, F.col("rid") * 48271 % 2147483647 % 10 < 8)


@query(_READ.format(6, _FOLLOW) + 'SELECT rid, "left", "right", CASE WHEN "left" IS NULL AND "right" IS NULL AND rid IN (SELECT rid FROM walk) THEN value + 1 ELSE value END AS value FROM nodes')
def tree_leaf_rewrite(spark, folder):
    return traversal.rewrite_leaves(_nodes(spark), tree_partial_descent(spark, folder), {"value": F.col("value") + 1})


@query("SELECT round(sum(c_acctbal), 2) AS total FROM customer")
def global_sum(spark, folder):
    return stats.total(read(spark, folder, "customer"), "c_acctbal").select(F.round("total", 2).alias("total"))


@query(f"SELECT rid, CASE WHEN rid % 10 = 0 THEN 'rewritten ' || rid WHEN rid % 10 = 1 THEN c_name || '!' ELSE c_name END AS c_name FROM {_NUMBERED} WHERE rid % 10 <> 2")
def write_by_rid(spark, folder):
    rows = written(_numbered(spark, folder).select("rid", "c_name"), "records")
    tenth = lambda k: rows.where(F.col("rid") % 10 == k).select("rid")
    out = mutation.write_by_rid(rows, tenth(0).withColumn("c_name", F.concat(F.lit("rewritten "), "rid")))
    out = mutation.expand_by_rid(out, "c_name", tenth(1).withColumn("piece", F.lit("!")))
    return mutation.delete_by_rid(out, tenth(2))


@query("SELECT o_orderkey AS rid, o_custkey FROM ((SELECT * FROM orders WHERE o_custkey < 40 ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1) UNION ALL (SELECT * FROM orders WHERE o_custkey > 40 ORDER BY o_custkey, o_orderkey LIMIT 1))")
def adjacent_keys(spark, folder):
    return scans.adjacent_keys(read(spark, folder, "orders").withColumnRenamed("o_orderkey", "rid"), "o_custkey", 40)


@query("SELECT id, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM (SELECT src AS id, dst FROM (" + _G3 + ")) GROUP BY id")
def adjacency_lists(spark, folder):
    return model.adjacency(g3(spark, folder), 1 << 30).select("id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("SELECT doc_id, substring(hex(encode(text)), 11, 40) AS part, octet_length(encode(text)) AS n FROM documents")
def long_read_bytes(spark, folder):
    """Ranges of bytes, which may cut characters."""
    item = F.encode("text", "UTF-8")
    return read(spark, folder, "documents").select("doc_id", F.hex(longitem.read(item, 5, 20)).alias("part"), longitem.bytes_to_nul(item).cast("long").alias("n"))


# Generators

_SEQUENCE = "seq(step, seed) AS (SELECT 0::BIGINT, 279::BIGINT UNION ALL SELECT step + 1, seed * 279 % 1009 FROM seq WHERE step < 1007)"


@query(
    f"WITH RECURSIVE {_SEQUENCE}, w AS (SELECT (seed - 1)::INT AS unique1, (row_number() OVER (ORDER BY step) - 1)::INT AS unique2 FROM seq WHERE seed <= 1000) "
    "SELECT unique1, unique2, (unique1 % 2)::INT AS two, (unique1 % 20)::INT AS twenty, (unique1 // 100)::INT AS onePercent, (2 * (unique1 // 100) + 1)::INT AS oddOnePercent, "
    "substring(string3, 1, 1) AS s3 FROM (SELECT *, ['A', 'H', 'O', 'V'][(unique2 % 4 + 1)::INT] AS string3 FROM w)"
)
def wisconsin_gen(spark, folder):
    made = generate.wisconsin(spark, 1000)
    return made.select("unique1", "unique2", "two", "twenty", "onePercent", "oddOnePercent", F.substring("string3", 1, 1).alias("s3"))


@query("SELECT k AS k_int, 'key-' || k AS k_str FROM (SELECT unnest(range(10))::INT AS k) WHERE k <= 5 AND k <> 7 AND k // 2 < 3 AND k + 1 >= 6 AND 2 * k <> 6 AND k * k > 4.5")
def boolean_terms(spark, folder):
    terms = [Term("k_int", "<=", 5), Term("k_str", "!=", "key-7"), Term("k_short", "<", 3), Term("k_float", ">=", 6.0), Term("k_long", "!=", 6), Term("k_double", ">", 4.5)]
    return scans.file_scan(generate.boolean_records(spark), terms).select("k_int", "k_str")
