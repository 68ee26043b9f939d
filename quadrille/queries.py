"""The query catalogue over the driver's tables, each with its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.text import TextIndex
from .plans.algebra import IRI
from .sources.relational import BASE, LazyTables, RelationalGraph, Table, file_row
from .sources.store import QuadStore

KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn")}
REFS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "labels": {"doc_id": "documents"}}
PREFIXES = {"t": BASE, "g": BASE + "graph/"} | {n: f"{BASE}{n}#" for n in KEYS}


def graph(spark: SparkSession, sf_dir: str, *names: str) -> RelationalGraph:
    return RelationalGraph(spark, LazyTables(list(names or KEYS), lambda n: Table(spark.read.parquet(f"{sf_dir}/{n}.parquet"), KEYS[n], REFS.get(n, {}), row=None if KEYS[n] else file_row())))


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    return Engine(spark, graph(spark, sf_dir, *names), prefixes=PREFIXES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _q(name: str, sparql: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """Registers a query; ``tables``: those that variable predicates range over, else all."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, *tables).query(sparql)
    if sql:
        ORACLES[name] = sql


#: Columns of text, for the SQL twin of a search in all literals.
STRINGS = {"region": ("r_name",), "nation": ("n_name",), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",), "part": ("p_name", "p_brand", "p_type"), "orders": ("o_orderstatus", "o_orderpriority"), "lineitem": ("l_returnflag", "l_linestatus"), "events": ("event_type", "props"), "documents": ("text", "lang", "source"), "pages": ("url", "html"), "benchmark": ("text",), "conversations": ("role", "text")}
_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in KEYS)


def _predicates() -> str:
    """SQL for the number of triples of each predicate of the whole graph."""
    parts = [f"SELECT '{BASE}{t}#' || x AS p, n FROM (UNPIVOT (SELECT count(COLUMNS(*)) AS '\\0' FROM {t}) ON COLUMNS(*) INTO NAME x VALUE n)" for t in KEYS]
    parts += [f"SELECT '{BASE}{t}#ref-{c}', count({c}) FROM {t}" for t, found in REFS.items() for c in found]
    parts.append(f"SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', CAST(sum(n) AS BIGINT) FROM ({_ROWS})")
    return f"SELECT p, n FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


_PREDICATES = _predicates()
R4 = "floor({0} * 10000 + 0.5) / 10000"
_r4 = R4.format

# -- the flagship: revenue of each nation
_q(
    "revenue_by_nation",
    """SELECT ?nation (ROUND(SUM(?price * (1 - ?disc)) * 10000) / 10000 AS ?revenue) (COUNT(*) AS ?n) WHERE {
      ?l lineitem:ref-l_orderkey ?o ; lineitem:l_extendedprice ?price ; lineitem:l_discount ?disc .
      ?o orders:ref-o_custkey ?c . ?c customer:ref-c_nationkey ?k . ?k nation:n_name ?nation } GROUP BY ?nation""",
    f"SELECT n_name AS nation, {_r4('sum(l_extendedprice * (1 - l_discount))')} AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)

# -- scans and joins
_q("scan_full_predicate", "SELECT ?s ?n WHERE { ?s nation:n_name ?n }", "SELECT 'http://example.org/t/nation/' || n_nationkey AS s, n_name AS n FROM nation")
_q("bgp_star", 'SELECT ?k ?status ?total WHERE { ?o orders:o_orderkey ?k ; orders:o_orderstatus ?status ; orders:o_totalprice ?total ; orders:o_orderpriority "1-URGENT" FILTER(?total > 100000) }', "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
_q("bgp_chain", "SELECT ?region (COUNT(?o) AS ?n) WHERE { ?o orders:ref-o_custkey ?c . ?c customer:ref-c_nationkey ?k . ?k nation:ref-n_regionkey ?r . ?r region:r_name ?region } GROUP BY ?region", "SELECT r_name AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_q(
    "bgp_cycle",
    "SELECT ?nation (COUNT(*) AS ?n) WHERE { ?l lineitem:ref-l_orderkey ?o ; lineitem:ref-l_suppkey ?s . ?o orders:ref-o_custkey ?c . ?c customer:ref-c_nationkey ?k . ?s supplier:ref-s_nationkey ?k . ?k nation:n_name ?nation } GROUP BY ?nation",
    "SELECT n_name AS nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
_q("scan_subject_constant", "SELECT ?p ?v WHERE { <http://example.org/t/nation/3> ?p ?o BIND(STR(?o) AS ?v) }", "SELECT 'http://example.org/t/nation#n_nationkey' AS p, '3' AS v UNION ALL SELECT 'http://example.org/t/nation#n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://example.org/t/nation#n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://example.org/t/nation#ref-n_regionkey', 'http://example.org/t/region/' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/t/nation'", ("nation", "region"))
_q("scan_var_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", _PREDICATES)
_q("triple_repeated_var", "SELECT ?s ?v WHERE { ?s nation:n_nationkey ?v ; nation:n_regionkey ?v }", "SELECT 'http://example.org/t/nation/' || n_nationkey AS s, CAST(n_nationkey AS BIGINT) AS v FROM nation WHERE n_nationkey = n_regionkey")
_q("type_scan", "SELECT (COUNT(*) AS ?n) WHERE { ?s a t:supplier ; supplier:s_acctbal ?b FILTER(?b < 0) }", "SELECT count(*) AS n FROM supplier WHERE s_acctbal < 0")
_q("cartesian", "SELECT ?r ?m WHERE { ?x region:r_name ?r { SELECT DISTINCT ?m WHERE { ?c customer:c_mktsegment ?m } } }", "SELECT r_name AS r, m FROM region, (SELECT DISTINCT c_mktsegment AS m FROM customer)")

# -- filters and expressions
_q("filter_compare", "SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s ; part:p_retailprice ?v FILTER(?s >= 10 && ?s < 20 && ?v > 950.5) }", "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950.5")
_q("filter_in", 'SELECT ?k ?s WHERE { ?c customer:c_custkey ?k ; customer:c_mktsegment ?s FILTER(?s IN ("BUILDING", "MACHINERY") && ?k NOT IN (1, 2, 3)) }', "SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey NOT IN (1, 2, 3)")
_q("filter_bool3v", 'SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_name ?n ; part:p_size ?s FILTER(?n > 5 || ?s = 7) }', "SELECT p_partkey AS k FROM part WHERE p_size = 7")
_q("filter_type_error", "SELECT (COUNT(*) AS ?n) WHERE { ?p part:p_name ?a ; part:p_size ?b FILTER(?a != ?b) }", "SELECT CAST(0 AS BIGINT) AS n")
_q("bind_arith", "SELECT ?k ?net ?twice WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?t BIND(?t * 0.9 - 1 AS ?net) BIND(-?k + ?k * 3 AS ?twice) }", "SELECT o_orderkey AS k, o_totalprice * 0.9::DOUBLE - 1 AS net, o_orderkey * 2 AS twice FROM orders")
_q("bind_if_coalesce", 'SELECT ?k ?size ?c WHERE { ?p part:p_partkey ?k ; part:p_size ?s BIND(IF(?s > 25, "large", "small") AS ?size) BIND(COALESCE(?none, ?s / 0, ?s) AS ?c0) BIND(xsd:integer(?c0) AS ?c) }', "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size, CAST(p_size AS BIGINT) AS c FROM part")
_q("div_by_zero", "SELECT ?k ?r WHERE { ?p part:p_partkey ?k ; part:p_size ?s BIND(100 / (?s - 5) AS ?r) }", "SELECT p_partkey AS k, CASE WHEN p_size <> 5 THEN 100.0::DOUBLE / (p_size - 5) END AS r FROM part")
_q("bound_error", "SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?s BIND(100 / (?s - 5) AS ?r) FILTER(!BOUND(?r)) }", "SELECT p_partkey AS k FROM part WHERE p_size = 5")

# -- optional, minus, exists, union, values
_OPT = "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) x ON o_custkey = c_custkey"
_q("optional_basic", "SELECT ?k ?o WHERE { ?c customer:c_custkey ?k OPTIONAL { ?x orders:ref-o_custkey ?c ; orders:o_orderkey ?o ; orders:o_totalprice ?t FILTER(?t > 400000) } }", _OPT)
_q("optional_nested", "SELECT ?k ?o ?q WHERE { ?c customer:c_custkey ?k OPTIONAL { ?x orders:ref-o_custkey ?c ; orders:o_orderkey ?o ; orders:o_totalprice ?t FILTER(?t > 400000) OPTIONAL { ?l lineitem:ref-l_orderkey ?x ; lineitem:l_quantity ?q FILTER(?q >= 49) } } }", "SELECT c_custkey AS k, o_orderkey AS o, l_quantity AS q FROM customer LEFT JOIN (SELECT * FROM orders LEFT JOIN (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49) l ON l_orderkey = o_orderkey WHERE o_totalprice > 400000) x ON o_custkey = c_custkey")
_q("optional_outer_filter", "SELECT ?k ?o WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b OPTIONAL { ?x orders:ref-o_custkey ?c ; orders:o_orderkey ?o ; orders:o_totalprice ?t FILTER(?t > ?b * 60) } }", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60")
_q("optional_disconnected", 'SELECT ?r ?n WHERE { ?x region:r_name ?r OPTIONAL { ?y nation:n_name ?n FILTER(?n = "no such nation") } }', "SELECT r_name AS r, CAST(NULL AS VARCHAR) AS n FROM region")
_q(
    "optional_then_join_undef",
    "SELECT ?k ?s WHERE { ?c customer:c_custkey ?k OPTIONAL { ?c customer:c_mktsegment ?s ; customer:c_acctbal ?b FILTER(?b > 5000) } { SELECT DISTINCT ?s WHERE { ?d customer:c_mktsegment ?s } } }",
    "WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS s FROM customer), m AS (SELECT DISTINCT c_mktsegment AS s FROM customer) SELECT k, m.s FROM a JOIN m ON a.s IS NULL OR a.s = m.s",
)
_q("minus_basic", "SELECT ?k WHERE { ?c customer:c_custkey ?k MINUS { ?o orders:ref-o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 300000) } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_q("minus_disjoint", "SELECT ?n WHERE { ?x nation:n_name ?n MINUS { ?y region:r_name ?r } }", "SELECT n_name AS n FROM nation")
_q("exists_semi", "SELECT ?k WHERE { ?c customer:c_custkey ?k FILTER EXISTS { ?o orders:ref-o_custkey ?c ; orders:o_orderstatus \"P\" } }", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_q("not_exists_anti", "SELECT ?k WHERE { ?c customer:c_custkey ?k FILTER NOT EXISTS { ?o orders:ref-o_custkey ?c ; orders:o_orderstatus \"P\" } }", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_q("exists_in_bind", "SELECT ?k ?big WHERE { ?c customer:c_custkey ?k BIND(EXISTS { ?o orders:ref-o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 350000) } AS ?big) }", "SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AS big FROM customer")
_q("union_same", "SELECT ?n WHERE { { ?x customer:c_name ?n } UNION { ?x supplier:s_name ?n } }", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier")
_q("union_hetero", "SELECT ?a ?b WHERE { { ?x nation:n_name ?a } UNION { ?x region:r_name ?b } }", "SELECT n_name AS a, CAST(NULL AS VARCHAR) AS b FROM nation UNION ALL SELECT NULL, r_name FROM region")
_q("values_join", 'SELECT ?n ?tag WHERE { ?x nation:n_nationkey ?k ; nation:n_name ?n VALUES (?k ?tag) { (1 "one") (2 "two") (99 "none") } }', "SELECT n_name AS n, tag FROM nation JOIN (VALUES (1, 'one'), (2, 'two'), (99, 'none')) v(k, tag) ON n_nationkey = k")
_q("values_undef", 'SELECT ?k ?r ?tag WHERE { ?x nation:n_nationkey ?k ; nation:n_regionkey ?r VALUES (?k ?r ?tag) { (1 UNDEF "k") (UNDEF 2 "r") (UNDEF UNDEF "any") } }', "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r, tag FROM nation JOIN (VALUES (1, NULL, 'k'), (NULL, 2, 'r'), (NULL, NULL, 'any')) v(k, r, tag) ON (v.k IS NULL OR v.k = n_nationkey) AND (v.r IS NULL OR v.r = n_regionkey)")
_q("trailing_values", "SELECT ?n ?k WHERE { ?x nation:n_nationkey ?k ; nation:n_name ?n } VALUES ?k { 3 5 7 }", "SELECT n_name AS n, CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey IN (3, 5, 7)")

# -- subqueries, distinct, order
_q("subquery_limit", "SELECT ?k ?n WHERE { { SELECT ?c ?k WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b } ORDER BY DESC(?b) ?k LIMIT 20 } ?c customer:c_name ?n }", "SELECT c_custkey AS k, c_name AS n FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
_q("named_subquery", "WITH %rich AS { SELECT ?c ?b WHERE { ?c customer:c_acctbal ?b FILTER(?b > 9000) } } SELECT ?n ?b WHERE { INCLUDE %rich ?c customer:c_name ?n }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 9000")
_q("distinct", "SELECT DISTINCT ?a ?b WHERE { ?o orders:o_orderstatus ?a ; orders:o_orderpriority ?b }", "SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders")
_q("reduced", "SELECT REDUCED ?n WHERE { ?x region:r_name ?n }", "SELECT r_name AS n FROM region")
_q("order_limit_offset", "SELECT ?k ?t WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?t } ORDER BY DESC(?t) ?k OFFSET 10 LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 25 OFFSET 10")
_q("order_multi", "SELECT ?s ?k WHERE { ?p part:p_size ?s ; part:p_partkey ?k } ORDER BY ?s DESC(?k + 1) LIMIT 50", "SELECT CAST(p_size AS BIGINT) AS s, p_partkey AS k FROM part ORDER BY p_size, p_partkey DESC LIMIT 50")
_q("order_mixed_types", 'SELECT ?t WHERE { { ?x nation:n_nationkey ?v } UNION { ?x nation:n_name ?v } UNION { ?x nation:ref-n_regionkey ?v } BIND(STR(?v) AS ?t) } ORDER BY DESC(?v) LIMIT 26', "SELECT t FROM (SELECT 'http://example.org/t/region/' || n_regionkey AS t, 2 AS o FROM nation UNION ALL SELECT n_name, 1 FROM nation) ORDER BY o DESC, t DESC LIMIT 26")

# -- aggregation
_q("group_sum_avg", "SELECT ?f ?s (SUM(?q) AS ?qty) (ROUND(AVG(?d) * 10000) / 10000 AS ?disc) (COUNT(*) AS ?n) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?s ; lineitem:l_quantity ?q ; lineitem:l_discount ?d } GROUP BY ?f ?s", f"SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS qty, {_r4('avg(l_discount)')} AS disc, count(*) AS n FROM lineitem GROUP BY ALL")
_q("group_count_distinct", "SELECT ?u (COUNT(DISTINCT ?t) AS ?n) WHERE { ?e events:user_id ?u ; events:event_type ?t } GROUP BY ?u", "SELECT user_id AS u, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
_q("count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { { SELECT ?u ?t WHERE { ?e events:user_id ?u ; events:event_type ?t } } }", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
_q("min_max", "SELECT ?t (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) (MIN(?at) AS ?first) WHERE { ?e events:event_type ?t ; events:value ?v ; events:ts ?at } GROUP BY ?t", "SELECT event_type AS t, min(value) AS lo, max(value) AS hi, min(ts) AS first FROM events GROUP BY 1")
_q("stdev", "SELECT ?t (ROUND(STDEV(?v) * 10000) / 10000 AS ?sd) WHERE { ?e events:event_type ?t ; events:value ?v } GROUP BY ?t", f"SELECT event_type AS t, {_r4('stddev_samp(value)')} AS sd FROM events GROUP BY 1")
_q("group_concat", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?names) WHERE { ?x nation:ref-n_regionkey ?y ; nation:n_name ?n . ?y region:r_name ?r } GROUP BY ?r', "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_q("sample", "SELECT ?r (SAMPLE(?k) AS ?one) WHERE { ?x nation:n_regionkey ?r ; nation:n_nationkey ?k } GROUP BY ?r", "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(min(n_nationkey) AS BIGINT) AS one FROM nation GROUP BY 1")
_q("having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o orders:ref-o_custkey ?x . ?x customer:c_custkey ?c } GROUP BY ?c HAVING (COUNT(?o) > 14)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14")
_q("group_expression", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o orders:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
_q("implicit_group_empty", "SELECT (COUNT(*) AS ?n) (SUM(?t) AS ?s) (GROUP_CONCAT(?x) AS ?g) WHERE { ?o orders:o_totalprice ?t ; orders:o_orderstatus ?x FILTER(?t < 0) }", "SELECT CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS s, '' AS g")
_q("agg_poison", "SELECT ?r (SUM(?v) AS ?s) WHERE { ?x nation:n_regionkey ?r ; nation:n_nationkey ?k BIND(IF(?k = 3, ?none, ?k) AS ?v0) BIND(xsd:integer(?v0) AS ?v) } GROUP BY ?r", "SELECT CAST(n_regionkey AS BIGINT) AS r, CASE WHEN bool_or(n_nationkey = 3) THEN NULL ELSE CAST(sum(n_nationkey) AS BIGINT) END AS s FROM nation GROUP BY 1")
_q("alias_reuse", "SELECT ?r (COUNT(*) AS ?n) (?n * 2 AS ?twice) WHERE { ?x nation:n_regionkey ?r } GROUP BY ?r", "SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n, count(*) * 2 AS twice FROM nation GROUP BY 1")
_q("order_by_aggregate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?l lineitem:ref-l_partkey ?x . ?x part:p_partkey ?p } GROUP BY ?p ORDER BY DESC(COUNT(*)) ?p LIMIT 30", "SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, p LIMIT 30")

# -- functions
_q("str_basic", 'SELECT ?k ?len ?u ?l ?cat WHERE { ?p part:p_partkey ?k ; part:p_name ?n ; part:p_brand ?b BIND(STRLEN(?n) AS ?len) BIND(UCASE(?n) AS ?u) BIND(LCASE(?b) AS ?l) BIND(CONCAT(?n, "/", ?b) AS ?cat) }', "SELECT p_partkey AS k, length(p_name) AS len, upper(p_name) AS u, lower(p_brand) AS l, p_name || '/' || p_brand AS cat FROM part")
_q("str_find", 'SELECT ?k ?a ?b ?s WHERE { ?p part:p_partkey ?k ; part:p_name ?t FILTER(STRSTARTS(?t, "s") || STRENDS(?t, "t") || CONTAINS(?t, "ol")) BIND(STRBEFORE(?t, " ") AS ?a) BIND(STRAFTER(?t, " ") AS ?b) BIND(SUBSTR(?t, 2, 4) AS ?s) }', "SELECT p_partkey AS k, CASE WHEN position(' ' IN p_name) > 0 THEN left(p_name, position(' ' IN p_name) - 1) ELSE '' END AS a, CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, position(' ' IN p_name) + 1) ELSE '' END AS b, substr(p_name, 2, 4) AS s FROM part WHERE starts_with(p_name, 's') OR ends_with(p_name, 't') OR contains(p_name, 'ol')")
_q("regex_flags", 'SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_name ?n FILTER(REGEX(?n, "^RED.*[gt]$", "i")) }', "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, '^RED.*[gt]$', 'i')")
_q("replace_groups", 'SELECT ?k ?r WHERE { ?c customer:c_custkey ?k ; customer:c_name ?n BIND(REPLACE(?n, "([A-Za-z]+)#0*([0-9]+)", "$2-$1") AS ?r) }', r"SELECT c_custkey AS k, regexp_replace(c_name, '([A-Za-z]+)#0*([0-9]+)', '\2-\1', 'g') AS r FROM customer")
_q("encode_uri", "SELECT ?k ?e WHERE { ?p part:p_partkey ?k ; part:p_name ?t BIND(ENCODE_FOR_URI(?t) AS ?e) }", "SELECT p_partkey AS k, url_encode(p_name) AS e FROM part")
_q("hashes", "SELECT ?k ?m ?h1 ?h2 WHERE { ?c customer:c_custkey ?k ; customer:c_name ?n BIND(MD5(?n) AS ?m) BIND(SHA1(?n) AS ?h1) BIND(SHA256(?n) AS ?h2) }", "SELECT c_custkey AS k, md5(c_name) AS m, sha1(c_name) AS h1, sha256(c_name) AS h2 FROM customer")
_q("hashes_long", "SELECT ?k ?h ?g WHERE { ?c customer:c_custkey ?k ; customer:c_name ?n BIND(SHA384(?n) AS ?h) BIND(SHA512(?n) AS ?g) }")
_q("term_tests", "SELECT ?k ?i ?l ?n ?dt ?lang WHERE { ?x nation:n_nationkey ?k ; nation:ref-n_regionkey ?r ; nation:n_name ?name BIND(ISIRI(?r) AS ?i) BIND(ISLITERAL(?name) AS ?l) BIND(ISNUMERIC(?k) AS ?n) BIND(STR(DATATYPE(?name)) AS ?dt) BIND(LANG(?name) AS ?lang) }", "SELECT CAST(n_nationkey AS BIGINT) AS k, true AS i, true AS l, true AS n, 'http://www.w3.org/2001/XMLSchema#string' AS dt, '' AS lang FROM nation")
_q("num_rounding", "SELECT ?k ?a ?c ?f ?r WHERE { ?s supplier:s_suppkey ?k ; supplier:s_acctbal ?b BIND(ABS(?b) AS ?a) BIND(CEIL(?b) AS ?c) BIND(FLOOR(?b) AS ?f) BIND(ROUND(?b) AS ?r) }", "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5::DOUBLE) AS r FROM supplier")
_q("math_functions", "SELECT ?k ?l ?s ?p WHERE { ?x part:p_partkey ?k ; part:p_retailprice ?v BIND(ROUND(math:log(?v) * 1000000) AS ?l) BIND(ROUND(math:sqrt(?v) * 1000000) AS ?s) BIND(ROUND(math:pow(?v, 0.5) * 1000000) AS ?p) }", "SELECT p_partkey AS k, floor(ln(p_retailprice) * 1000000 + 0.5::DOUBLE) AS l, floor(sqrt(p_retailprice) * 1000000 + 0.5::DOUBLE) AS s, floor(pow(p_retailprice, 0.5::DOUBLE) * 1000000 + 0.5::DOUBLE) AS p FROM part")
_q("date_parts", "SELECT ?k ?y ?m ?d ?h ?mi ?s WHERE { ?e events:event_id ?k ; events:ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?mi) BIND(FLOOR(SECONDS(?t)) AS ?s) }", "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(second(ts) AS DOUBLE) AS s FROM events")
_q("date_arith", 'SELECT ?k ?later ?epoch WHERE { ?e events:event_id ?k ; events:ts ?t FILTER(?t >= "2024-01-01T00:00:00"^^xsd:dateTime) BIND(?t + "P1DT2H"^^xsd:dayTimeDuration AS ?later) BIND(ql:toEpoch(?t) AS ?epoch) }', "SELECT event_id AS k, ts + INTERVAL 26 HOUR AS later, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch FROM events WHERE ts >= TIMESTAMP '2024-01-01'")
_q("casts", 'SELECT ?k ?i ?d ?b ?s ?bad WHERE { ?p part:p_partkey ?k ; part:p_retailprice ?v ; part:p_size ?z BIND(xsd:integer(?v) AS ?i) BIND(xsd:double(STR(?z)) AS ?d) BIND(xsd:boolean(?z - 1) AS ?b) BIND(xsd:string(?z) AS ?s) BIND(xsd:integer("x") AS ?bad) }', "SELECT p_partkey AS k, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS d, p_size <> 1 AS b, CAST(p_size AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS bad FROM part")
_q("random_terms", "SELECT ?k ?ok WHERE { ?x region:r_regionkey ?k BIND(ISIRI(UUID()) && STRLEN(STRUUID()) = 36 && RAND() < 1 && ISBLANK(BNODE()) AS ?ok) }", "SELECT CAST(r_regionkey AS BIGINT) AS k, true AS ok FROM region")

# -- paths
_q("path_seq", "SELECT ?n ?r WHERE { ?c customer:c_custkey ?n ; customer:ref-c_nationkey/nation:ref-n_regionkey/region:r_name ?r }", "SELECT c_custkey AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_q("path_alt", "SELECT ?x ?n WHERE { ?x nation:n_name|region:r_name ?n }", "SELECT 'http://example.org/t/nation/' || n_nationkey AS x, n_name AS n FROM nation UNION ALL SELECT 'http://example.org/t/region/' || r_regionkey, r_name FROM region")
_q("path_inverse", "SELECT ?r ?n WHERE { ?x region:r_name ?r ; ^nation:ref-n_regionkey ?y . ?y nation:n_name ?n }", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
_q("path_negated", "SELECT ?s (COUNT(*) AS ?n) WHERE { ?s !(nation:n_name|nation:n_regionkey|rdf:type) ?o } GROUP BY ?s")  # subjects without a key have no name in SQL; a test compares with brute force
_EDGES = "(customer:ref-c_nationkey|nation:ref-n_regionkey)"
_q("path_plus", f"SELECT ?k ?to WHERE {{ ?c customer:c_custkey ?k . ?c {_EDGES}+ ?x BIND(STR(?x) AS ?to) }}", "SELECT c_custkey AS k, 'http://example.org/t/nation/' || c_nationkey AS \"to\" FROM customer UNION ALL SELECT c_custkey, 'http://example.org/t/region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
_q("path_star", f"SELECT ?k (COUNT(?x) AS ?n) WHERE {{ ?c customer:c_custkey ?k . ?c {_EDGES}* ?x }} GROUP BY ?k", "SELECT c_custkey AS k, CAST(3 AS BIGINT) AS n FROM customer")
_q("path_opt", f"SELECT ?k (COUNT(?x) AS ?n) WHERE {{ ?c customer:c_custkey ?k . ?c {_EDGES}? ?x }} GROUP BY ?k", "SELECT c_custkey AS k, CAST(2 AS BIGINT) AS n FROM customer")
_q("path_range", f"SELECT ?k ?to WHERE {{ ?c customer:c_custkey ?k . ?c {_EDGES}{{2,3}} ?x BIND(STR(?x) AS ?to) }}", "SELECT c_custkey AS k, 'http://example.org/t/region/' || n_regionkey AS \"to\" FROM customer JOIN nation ON c_nationkey = n_nationkey")
_q("path_plus_to_constant", f"SELECT ?k WHERE {{ ?c {_EDGES}+ <http://example.org/t/region/2> . ?c customer:c_custkey ?k }}", "SELECT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
_q("path_search_all", "SELECT ?a ?b ?path ?edge WHERE { SERVICE pathSearch: { _:p pathSearch:algorithm pathSearch:allPaths ; pathSearch:source <http://example.org/t/supplier/1> ; pathSearch:start ?a ; pathSearch:end ?b ; pathSearch:pathColumn ?path ; pathSearch:edgeColumn ?edge { { ?a supplier:ref-s_nationkey ?b } UNION { ?a nation:ref-n_regionkey ?b } } } }", "WITH s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1) SELECT 'http://example.org/t/supplier/1' AS a, 'http://example.org/t/nation/' || n_nationkey AS b, CAST(p AS BIGINT) AS path, CAST(0 AS BIGINT) AS edge FROM s, range(2) t(p) UNION ALL SELECT 'http://example.org/t/nation/' || n_nationkey, 'http://example.org/t/region/' || n_regionkey, 1, 1 FROM s")
_q("path_search_maxdepth", "SELECT ?a ?b WHERE { SERVICE pathSearch: { _:p pathSearch:algorithm pathSearch:allPaths ; pathSearch:source <http://example.org/t/supplier/1>, <http://example.org/t/supplier/2> ; pathSearch:maxDepth 1 ; pathSearch:start ?a ; pathSearch:end ?b ; pathSearch:pathColumn ?path ; pathSearch:edgeColumn ?edge { { ?a supplier:ref-s_nationkey ?b } UNION { ?a nation:ref-n_regionkey ?b } } } }", "SELECT 'http://example.org/t/supplier/' || s_suppkey AS a, 'http://example.org/t/nation/' || s_nationkey AS b FROM supplier WHERE s_suppkey IN (1, 2)")

# -- other forms and graphs
_q("ask", 'ASK { ?x region:r_name "ASIA" }', "SELECT count(*) > 0 AS ask FROM region WHERE r_name = 'ASIA'")
_q("ask_none", 'ASK { ?x region:r_name "ATLANTIS" }', "SELECT count(*) > 0 AS ask FROM region WHERE r_name = 'ATLANTIS'")
_q("has_predicate", "SELECT ?p (COUNT(?s) AS ?n) WHERE { ?s ql:has-predicate ?p } GROUP BY ?p", _PREDICATES)
_q("predicate_counts", "SELECT ?p (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", _PREDICATES)
_q("graph_named", "SELECT ?n WHERE { GRAPH g:nation { ?x nation:n_name ?n } }", "SELECT n_name AS n FROM nation")
_q("graph_wrong", "SELECT ?n WHERE { GRAPH g:region { ?x nation:n_name ?n } }", "SELECT n_name AS n FROM nation WHERE false")
_q("graph_var", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?o } } GROUP BY ?g", f"SELECT '{BASE}graph/' || t AS g, n FROM ({_ROWS}) WHERE n > 0")
_q("from_named", "SELECT ?n FROM g:region FROM NAMED g:nation WHERE { { ?x region:r_name ?n } UNION { ?x nation:n_name ?n } UNION { GRAPH g:nation { ?x nation:n_name ?n } } }", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _triples(df: DataFrame) -> DataFrame:
    """s, p and the object's text: what SQL can make too."""
    o = F.col("o")
    return df.select("s", "p", F.coalesce(o["s"], o["i"].cast("string"), o["d"].cast("string")).alias("o"))


@_query("construct", "SELECT 'http://example.org/t/nation/' || n_nationkey AS s, 'http://example.org/in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def construct(spark, sf_dir):
    return _triples(engine(spark, sf_dir).query("CONSTRUCT { ?x <http://example.org/in> ?r } WHERE { ?x nation:ref-n_regionkey ?y . ?y region:r_name ?r }"))


@_query("describe", ORACLES["scan_subject_constant"].replace(" AS v ", " AS o ").replace("AS p,", "AS p,"))
def describe(spark, sf_dir):
    return _triples(engine(spark, sf_dir, "nation", "region").query("DESCRIBE <http://example.org/t/nation/3>")).select("p", "o")


ORACLES["describe"] = "SELECT p, v AS o FROM (" + ORACLES["scan_subject_constant"] + ")"


def store(spark: SparkSession, sf_dir: str, *names: str) -> QuadStore:
    """The triples of some tables as a store of quads."""
    df, c = graph(spark, sf_dir, *names).any_predicate(None, "g")
    s = c["s"].col if c["s"].kind in ("iri", "res") else F.concat(F.lit(c["s"].kind[4:]), c["s"].col.cast("string"))
    return QuadStore.write(df.select(s.alias("s"), "p", "o", "g"))


@_query("store_star", "SELECT n_name AS n, r_name AS r, CAST(n_nationkey AS BIGINT) AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def store_star(spark, sf_dir):
    e = Engine(spark, store(spark, sf_dir, "nation", "region"), prefixes=PREFIXES)
    return e.query("SELECT ?n ?r ?k WHERE { ?x nation:n_name ?n ; nation:n_nationkey ?k ; nation:ref-n_regionkey ?y . ?y region:r_name ?r }")


@_query("store_path", "SELECT 'http://example.org/t/supplier/' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def store_path(spark, sf_dir):
    e = Engine(spark, store(spark, sf_dir, "supplier", "nation"), prefixes=PREFIXES)
    return e.query("SELECT ?s WHERE { ?s a t:supplier ; (supplier:ref-s_nationkey|nation:ref-n_regionkey)+ <http://example.org/t/region/1> }")


@_query("update_insert_delete", "SELECT r_name AS n FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'ATLANTIS'")
def update_insert_delete(spark, sf_dir):
    e = Engine(spark, store(spark, sf_dir, "region"), prefixes=PREFIXES)
    gone = spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey = 2").first()["r_name"]
    e.update(f'DELETE DATA {{ GRAPH g:region {{ <{BASE}region/2> region:r_name "{gone}" }} }} ; INSERT DATA {{ <{BASE}region/9> region:r_name "ATLANTIS" }}')
    return e.query("SELECT ?n WHERE { ?x region:r_name ?n }")


@_query("update_modify", "SELECT CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS n FROM nation")
def update_modify(spark, sf_dir):
    e = Engine(spark, store(spark, sf_dir, "nation"), prefixes=PREFIXES)
    e.update("WITH g:nation DELETE { ?x nation:n_name ?n } INSERT { ?x nation:n_name ?m } WHERE { ?x nation:n_name ?n ; nation:n_regionkey 0 BIND(LCASE(?n) AS ?m) }")
    return e.query("SELECT ?n WHERE { ?x nation:n_name ?n }")


@_query("graph_copy_move", "SELECT 'http://example.org/a' AS g, 3 * count(*) AS n FROM region UNION ALL SELECT 'http://example.org/b', 3 * count(*) FROM region")
def graph_copy_move(spark, sf_dir):
    e = Engine(spark, store(spark, sf_dir, "region"), prefixes=PREFIXES)
    e.update("COPY g:region TO <http://example.org/a> ; MOVE g:region TO <http://example.org/b>")
    return e.query("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


# -- text search over documents
_indexes: dict[tuple[str, str], TextIndex] = {}


def _texts(spark: SparkSession, sf_dir: str, scoring: str) -> Engine:
    """The text index of the documents is built once in a session and serves every scoring."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("rec"), "text")
        ent = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("rec"), F.concat(F.lit(BASE + "source/"), F.col("source")).alias("entity"))
        _indexes[key] = TextIndex.build(docs, ent, "bm25", record_kind=f"ref:{BASE}documents/")
    return Engine(spark, graph(spark, sf_dir), _indexes[key].scored_by(scoring), prefixes=PREFIXES)


_TOK = r"WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), nn AS (SELECT count(*) AS n FROM documents), av AS (SELECT avg(dl) AS m FROM dl)"


def _text(name: str, scoring: str, sparql: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _texts(spark, sf_dir, scoring).query(sparql)
    ORACLES[name] = _TOK + sql


_text("text_word", "count", 'SELECT ?k ?ql_score_word_d_the WHERE { ?d ql:contains-word "the" ; documents:doc_id ?k }', " SELECT doc_id AS k, CAST(tf AS DOUBLE) AS ql_score_word_d_the FROM tf WHERE word = 'the'")
_text("text_prefix", "count", 'SELECT ?k ?m ?s WHERE { SERVICE textSearch: { ?d textSearch:contains ?c . ?c textSearch:word "lice*" ; textSearch:prefix-match ?m ; textSearch:score ?s } ?d documents:doc_id ?k }', " SELECT doc_id AS k, word AS m, CAST(tf AS DOUBLE) AS s FROM tf WHERE starts_with(word, 'lice')")
_text("text_and", "count", 'SELECT ?k ?l WHERE { ?d ql:contains-word "the and" ; documents:doc_id ?k ; documents:lang ?l }', " SELECT a.doc_id AS k, lang AS l FROM tf a JOIN tf b ON a.doc_id = b.doc_id JOIN documents d ON d.doc_id = a.doc_id WHERE a.word = 'the' AND b.word = 'and'")
_text("text_tfidf", "tfidf", 'SELECT ?k (ROUND(?s * 10000) AS ?score) WHERE { SERVICE textSearch: { ?d textSearch:contains ?c . ?c textSearch:word "and" ; textSearch:score ?s } ?d documents:doc_id ?k }', " SELECT doc_id AS k, floor(tf * log2(n / df::DOUBLE) * 10000 + 0.5::DOUBLE) AS score FROM tf JOIN df USING (word), nn WHERE word = 'and'")
_text("text_bm25", "bm25", 'SELECT ?k (ROUND(?s * 10000) AS ?score) WHERE { SERVICE textSearch: { ?d textSearch:contains ?c . ?c textSearch:word "and" ; textSearch:score ?s } ?d documents:doc_id ?k }', " SELECT doc_id AS k, floor(tf * 2.75::DOUBLE / (1.75::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / m) + tf) * log2(n / df::DOUBLE) * 10000 + 0.5::DOUBLE) AS score FROM tf JOIN df USING (word) JOIN dl USING (doc_id), nn, av WHERE word = 'and'")
_text("text_entity", "count", 'SELECT ?e (COUNT(?d) AS ?n) WHERE { ?d ql:contains-word "and" ; ql:contains-entity ?e } GROUP BY ?e', " SELECT 'http://example.org/t/source/' || source AS e, count(*) AS n FROM tf JOIN documents USING (doc_id) WHERE word = 'and' GROUP BY 1")
_text("textlimit", "count", 'SELECT ?e ?d ?ql_score_s WHERE { SERVICE textSearch: { ?d textSearch:contains ?c . ?c textSearch:word "and" ; textSearch:score ?ql_score_s . ?d textSearch:contains ?f . ?f textSearch:entity ?e } } TEXTLIMIT 2', " SELECT 'http://example.org/t/source/' || source AS e, 'http://example.org/t/documents/' || doc_id AS d, CAST(tf AS DOUBLE) AS ql_score_s FROM tf JOIN documents USING (doc_id) WHERE word = 'and' QUALIFY row_number() OVER (PARTITION BY source ORDER BY tf DESC, doc_id DESC) <= 2")
_STRINGS = " UNION ALL ".join(f"SELECT {c} AS s FROM {t}" for t, found in STRINGS.items() for c in found)
_q("has_word", 'SELECT ?w (COUNT(*) AS ?n) WHERE { ?o ql:has-word ?w } GROUP BY ?w', rf"SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(s), '[^\p{{L}}\p{{N}}]+')) AS w FROM ({_STRINGS})) WHERE w <> '' GROUP BY 1")

# -- space: points made of keys
_A = 'BIND(STRDT(CONCAT("POINT(", STR(((?k * 7919) - 1000 * FLOOR((?k * 7919) / 1000)) * 0.36 - 180), " ", STR(((?k * 104729) - 1000 * FLOOR((?k * 104729) / 1000)) * 0.17 - 85), ")"), geo:wktLiteral) AS ?g)'
_PT = "((({0} * 7919) % 1000) * 0.36::DOUBLE - 180) AS x, ((({0} * 104729) % 1000) * 0.17::DOUBLE - 85) AS y"
_KM = "2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))))"
_GEO = f"WITH a AS (SELECT c_custkey AS k, {_PT.format('c_custkey')} FROM customer), b AS (SELECT s_suppkey + 500 AS k, {_PT.format('(s_suppkey + 500)')} FROM supplier)"
_LEFT = f"{{ SELECT ?c ?ga WHERE {{ ?x customer:c_custkey ?c BIND(?c AS ?k) {_A} BIND(?g AS ?ga) }} }}"
_RIGHT = f"SELECT ?s ?gb WHERE {{ ?y supplier:s_suppkey ?s BIND(?s + 500 AS ?k) {_A} BIND(?g AS ?gb) }}"
_q("spatial_maxdist", f"SELECT ?c ?s ?m WHERE {{ {_LEFT} SERVICE spatialSearch: {{ _:c spatialSearch:algorithm spatialSearch:s2 ; spatialSearch:left ?ga ; spatialSearch:right ?gb ; spatialSearch:maxDistance 1000000 ; spatialSearch:bindDistance ?d {{ {_RIGHT} }} }} BIND(ROUND(?d * 1000) AS ?m) }}", f"{_GEO} SELECT a.k AS c, b.k - 500 AS s, floor({_KM} * 1000 + 0.5::DOUBLE) AS m FROM a, b WHERE {_KM} <= 1000")
_q("spatial_filter", f"SELECT ?c ?s WHERE {{ {_LEFT} {{ {_RIGHT} }} FILTER(geof:distance(?ga, ?gb) <= 700) }}", f"{_GEO} SELECT a.k AS c, b.k - 500 AS s FROM a, b WHERE {_KM} <= 700")
_q("spatial_knn", f"SELECT ?c ?m WHERE {{ {_LEFT} SERVICE spatialSearch: {{ _:c spatialSearch:algorithm spatialSearch:s2 ; spatialSearch:left ?ga ; spatialSearch:right ?gb ; spatialSearch:numNearestNeighbors 3 ; spatialSearch:bindDistance ?d {{ {_RIGHT} }} }} BIND(ROUND(?d * 1000) AS ?m) }}", f"{_GEO} SELECT a.k AS c, floor({_KM} * 1000 + 0.5::DOUBLE) AS m FROM a, b QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY {_KM}) <= 3")
_q("geo_functions", f"SELECT ?k ?x ?y ?t WHERE {{ ?p supplier:s_suppkey ?k {_A} BIND(ROUND(geof:longitude(?g) * 100) AS ?x) BIND(ROUND(geof:latitude(?g) * 100) AS ?y) BIND(STR(geof:geometryType(?g)) AS ?t) }}", "SELECT s_suppkey AS k, floor((((s_suppkey * 7919) % 1000) * 0.36::DOUBLE - 180) * 100 + 0.5::DOUBLE) AS x, floor((((s_suppkey * 104729) % 1000) * 0.17::DOUBLE - 85) * 100 + 0.5::DOUBLE) AS y, 'http://www.opengis.net/ont/sf#Point' AS t FROM supplier")
_BOX = 'BIND(STRDT(CONCAT("POLYGON((", STR(?k), " 0,", STR(?k + 2), " 0,", STR(?k + 2), " 2,", STR(?k), " 2,", STR(?k), " 0))"), geo:wktLiteral) AS {0})'
_q("spatial_intersects", f"SELECT ?a ?b WHERE {{ {{ SELECT ?a ?ga WHERE {{ ?x nation:n_nationkey ?a BIND(?a AS ?k) {_BOX.format('?ga')} }} }} {{ SELECT ?b ?gb WHERE {{ ?y nation:n_nationkey ?b BIND(?b + 1.5 AS ?k) {_BOX.format('?gb')} }} }} FILTER(geof:sfIntersects(?ga, ?gb)) }}", "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a, nation b WHERE abs(b.n_nationkey + 1.5 - a.n_nationkey) <= 2")

_RECT = 'BIND(STRDT(CONCAT("POLYGON((", STR({x}), " {lo},", STR({x} + {w}), " {lo},", STR({x} + {w}), " {hi},", STR({x}), " {hi},", STR({x}), " {lo}))"), geo:wktLiteral) AS {g})'
#: Of a square at a key and a rectangle made of another key: its place, and when the relation holds.
_RELATIONS = {
    "contains": (dict(x="?b + 0.5", w=1, lo=0.5, hi=1.5), "a.n_nationkey = b.n_nationkey"),
    "within": (dict(x="?b - 1", w=4, lo=-1, hi=3), "abs(a.n_nationkey - b.n_nationkey) <= 1"),
    "touches": (dict(x="?b + 2", w=1, lo=0, hi=2), "a.n_nationkey - b.n_nationkey IN (0, 3)"),
    "overlaps": (dict(x="?b + 1", w=2, lo=1, hi=3), "b.n_nationkey - a.n_nationkey > -3 AND b.n_nationkey - a.n_nationkey < 1"),
    "equals": (dict(x="?b", w=2, lo=0, hi=2), "a.n_nationkey = b.n_nationkey"),
}
for _name, (_rect, _when) in _RELATIONS.items():
    _q(
        f"spatial_{_name}",
        f"SELECT ?a ?b WHERE {{ {{ SELECT ?a ?ga WHERE {{ ?x nation:n_nationkey ?a {_RECT.format(x='?a', w=2, lo=0, hi=2, g='?ga')} }} }} {{ SELECT ?b ?gb WHERE {{ ?y nation:n_nationkey ?b {_RECT.format(**_rect, g='?gb')} }} }} FILTER(geof:sf{_name.title()}(?ga, ?gb)) }}",
        f"SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a, nation b WHERE {_when}",
    )
_q(
    "spatial_crosses",
    f"SELECT ?a ?b WHERE {{ {{ SELECT ?a ?ga WHERE {{ ?x nation:n_nationkey ?a BIND(STRDT(CONCAT(\"LINESTRING(\", STR(?a + 0.5), \" -1,\", STR(?a + 0.5), \" 1)\"), geo:wktLiteral) AS ?ga) }} }} {{ SELECT ?b ?gb WHERE {{ ?y nation:n_nationkey ?b {_RECT.format(x='?b', w=2, lo=0, hi=2, g='?gb')} }} }} FILTER(geof:sfCrosses(?ga, ?gb)) }}",
    "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a, nation b WHERE a.n_nationkey - b.n_nationkey IN (0, 1)",
)
_q(
    "spatial_relate",
    f"SELECT ?a ?b WHERE {{ {{ SELECT ?a ?ga WHERE {{ ?x nation:n_nationkey ?a {_RECT.format(x='?a', w=2, lo=0, hi=2, g='?ga')} }} }} {{ SELECT ?b ?gb WHERE {{ ?y nation:n_nationkey ?b {_RECT.format(x='?b + 0.5', w=1, lo=0.5, hi=1.5, g='?gb')} }} }} FILTER(geof:relate(?ga, ?gb, \"T*****FF*\")) }}",
    "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM nation",
)
_q(
    "spatial_de9im",
    f"SELECT ?a ?b WHERE {{ {{ SELECT ?a ?ga WHERE {{ ?x nation:n_nationkey ?a {_RECT.format(x='?a', w=2, lo=0, hi=2, g='?ga')} }} }} SERVICE spatialSearch: {{ _:c spatialSearch:algorithm spatialSearch:libspatialjoin ; spatialSearch:left ?ga ; spatialSearch:right ?gb ; spatialSearch:joinType spatialSearch:de9im ; spatialSearch:de9imFilter \"FT*******\" {{ SELECT ?b ?gb WHERE {{ ?y nation:n_nationkey ?b {_RECT.format(x='?b + 2', w=1, lo=0, hi=2, g='?gb')} }} }} }} }}",
    "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a, nation b WHERE a.n_nationkey - b.n_nationkey IN (0, 3)",
)
_q("spatial_magic_distance", f"SELECT ?c ?s WHERE {{ {_LEFT} {{ {_RIGHT} }} ?ga <max-distance-in-meters:700000> ?gb }}", f"{_GEO} SELECT a.k AS c, b.k - 500 AS s FROM a, b WHERE {_KM} <= 700")
_q("spatial_magic_nearest", f"SELECT ?c (COUNT(?s) AS ?n) WHERE {{ {_LEFT} {{ {_RIGHT} }} ?ga <nearest-neighbors:2:3000000> ?gb }} GROUP BY ?c", f"{_GEO}, r AS (SELECT a.k AS c FROM a, b WHERE {_KM} <= 3000 QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY {_KM}) <= 2) SELECT c, count(*) AS n FROM r GROUP BY c")

# -- order and distinct, values after the pattern, cycles, languages, more functions
_q("distinct_order_unselected", "SELECT DISTINCT ?s WHERE { ?o orders:o_orderstatus ?s ; orders:o_totalprice ?p } ORDER BY DESC(?p) LIMIT 2", "SELECT o_orderstatus AS s FROM orders GROUP BY 1 ORDER BY max(o_totalprice) DESC LIMIT 2")
_q("values_after_pattern", 'SELECT ?k ?r WHERE { ?x nation:n_nationkey ?k ; nation:n_regionkey ?r } ORDER BY DESC(?k) LIMIT 3 VALUES ?r { 1 2 }', "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_regionkey IN (1, 2) ORDER BY n_nationkey DESC LIMIT 3")
_BOTH = "(nation:ref-n_regionkey|^nation:ref-n_regionkey)"
_NEAR = "SELECT CAST(a.n_nationkey AS BIGINT) AS k, CAST(count(*) + 1 AS BIGINT) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1"
_q("path_plus_cycle", f"SELECT ?k (COUNT(?y) AS ?n) WHERE {{ ?x nation:n_nationkey ?k . ?x {_BOTH}+ ?y }} GROUP BY ?k", _NEAR)
_q("path_star_cycle", f"SELECT ?k (COUNT(?y) AS ?n) WHERE {{ ?x nation:n_nationkey ?k . ?x {_BOTH}* ?y }} GROUP BY ?k", _NEAR)
_q("path_opt_alternative", "SELECT ?k ?to WHERE { ?x nation:n_nationkey ?k . ?x (nation:ref-n_regionkey)? ?y BIND(STR(?y) AS ?to) }", "SELECT CAST(n_nationkey AS BIGINT) AS k, 'http://example.org/t/region/' || n_regionkey AS \"to\" FROM nation UNION ALL SELECT n_nationkey, 'http://example.org/t/nation/' || n_nationkey FROM nation")
_q(
    "path_search_limited",
    "SELECT ?r (COUNT(*) AS ?n) WHERE { ?x region:r_regionkey ?r SERVICE pathSearch: { _:p pathSearch:algorithm pathSearch:allPaths ; pathSearch:source ?x ; pathSearch:target <http://example.org/t/nation/1> ; pathSearch:numPathsPerTarget 1 ; pathSearch:start ?a ; pathSearch:end ?b ; pathSearch:pathColumn ?path ; pathSearch:edgeColumn ?edge { { ?b nation:ref-n_regionkey ?a } UNION { ?a nation:ref-n_regionkey ?b } UNION { ?b nation:ref-n_regionkey ?a } } } } GROUP BY ?r",
    "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(1 AS BIGINT) AS n FROM nation WHERE n_nationkey = 1",
)
_q("math_trigonometry", "SELECT ?k ?s ?c ?t ?e WHERE { ?x part:p_partkey ?k BIND(?k / 1000 AS ?v) BIND(ROUND(math:sin(?v) * 1000000) AS ?s) BIND(ROUND(math:cos(?v) * 1000000) AS ?c) BIND(ROUND(math:tan(?v / 10) * 1000000) AS ?t) BIND(ROUND(math:exp(?v / 10) * 1000000) AS ?e) }", "SELECT p_partkey AS k, floor(sin(p_partkey / 1000::DOUBLE) * 1000000 + 0.5::DOUBLE) AS s, floor(cos(p_partkey / 1000::DOUBLE) * 1000000 + 0.5::DOUBLE) AS c, floor(tan(p_partkey / 1000::DOUBLE / 10) * 1000000 + 0.5::DOUBLE) AS t, floor(exp(p_partkey / 1000::DOUBLE / 10) * 1000000 + 0.5::DOUBLE) AS e FROM part")


def _tagged(spark: SparkSession, sf_dir: str) -> Engine:
    """The texts of documents as literals in their languages."""
    from .functions.terms import K_LIT, struct

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and lang is not null")
    quads = d.select(F.concat(F.lit(BASE + "documents/"), F.col("doc_id").cast("string")).alias("s"), F.lit(BASE + "documents#text").alias("p"), struct(k=F.lit(K_LIT), s=F.col("text"), lang=F.col("lang")).alias("o"), F.lit("").alias("g"))
    return Engine(spark, QuadStore(spark, quads.distinct(), {}, True), prefixes=PREFIXES)


@_query("language_predicate", "SELECT count(DISTINCT doc_id) AS n FROM documents WHERE lang = 'en' AND text IS NOT NULL")
def language_predicate(spark, sf_dir):
    return _tagged(spark, sf_dir).query("SELECT (COUNT(*) AS ?n) WHERE { ?d @en@documents:text ?t }")


@_query("langtag", "SELECT lang AS l, count(DISTINCT text) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def langtag(spark, sf_dir):
    return _tagged(spark, sf_dir).query("SELECT ?l (COUNT(*) AS ?n) WHERE { ?o ql:langtag ?l } GROUP BY ?l")


@_query("text_from_literals", r"SELECT 'http://example.org/t/customer/' || c_custkey AS e FROM customer WHERE regexp_matches(lower(c_name), '(^|[^\p{L}\p{N}])customer([^\p{L}\p{N}]|$)') AND c_name IS NOT NULL")
def text_from_literals(spark, sf_dir):
    """The graph's own literals as text: records are the literals, entities their subjects."""
    g = graph(spark, sf_dir, "customer")
    return Engine(spark, g, TextIndex.from_literals(g), prefixes=PREFIXES).query('SELECT ?e WHERE { ?t ql:contains-word "customer" ; ql:contains-entity ?e }')


@_query("store_log", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || '!' AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1 UNION ALL SELECT 100, 'new'")
def store_log(spark, sf_dir):
    """Updates that a log of quads holds over an unchanged base."""
    e = Engine(spark, QuadStore.write(_quads(spark, sf_dir)), prefixes=PREFIXES)
    e.update('INSERT DATA { <http://example.org/t/nation/100> nation:n_nationkey 100 ; nation:n_name "new" }')
    e.update('DELETE { ?x nation:n_name ?n } INSERT { ?x nation:n_name ?m } WHERE { ?x nation:n_regionkey 1 ; nation:n_name ?n BIND(CONCAT(?n, "!") AS ?m) }')
    e.update("DELETE WHERE { ?x nation:n_regionkey 0 ; nation:n_name ?n }")
    return e.query("SELECT ?k ?n WHERE { ?x nation:n_nationkey ?k ; nation:n_name ?n }")


def _quads(spark, sf_dir):
    df, c = graph(spark, sf_dir, "nation").any_predicate(None, None)
    from .functions.terms import to_term

    return df.select(to_term(c["s"])["s"].alias("s"), to_term(c["p"])["s"].alias("p"), to_term(c["o"]).alias("o"), F.lit("").alias("g"))


@_query("view_scan", "SELECT n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY 1")
def view_scan(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.write_view("rich", "SELECT ?c ?n ?b WHERE { ?c customer:c_acctbal ?b ; customer:ref-c_nationkey ?k . ?k nation:n_name ?n }")
    return e.query("SELECT ?n (COUNT(*) AS ?c) WHERE { SERVICE view:rich { _:v view:column-n ?n ; view:column-b ?b } FILTER(?b > 5000) } GROUP BY ?n")


@_query("view_predicate", "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'")
def view_predicate(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.write_view("balance", "SELECT ?c ?b WHERE { ?c customer:c_acctbal ?b }")
    return e.query('SELECT ?k ?b WHERE { ?c customer:c_mktsegment "BUILDING" ; customer:c_custkey ?k ; view:balance-b ?b }')


@_query("cached_result", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def cached_result(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.pin("pairs", "SELECT ?x ?r WHERE { ?x nation:ref-n_regionkey ?y . ?y region:r_name ?r }")
    return e.query("SELECT ?r (COUNT(*) AS ?n) WHERE { SERVICE ql:cached-result-with-name-pairs {} } GROUP BY ?r")


@_query("service_federated", "SELECT n_name AS n, CAST(n_nationkey * 10 AS BIGINT) AS pop FROM nation WHERE n_nationkey < 3")
def service_federated(spark, sf_dir):
    """An endpoint is a function here; a service that fails silently changes nothing."""

    def fetch(url: str, query: str) -> dict:
        if url != "http://example.org/sparql":
            raise OSError(url)
        rows = [{"x": {"type": "uri", "value": f"{BASE}nation/{k}"}, "pop": {"type": "literal", "value": str(10 * k), "datatype": "http://www.w3.org/2001/XMLSchema#integer"}} for k in range(3)]
        return {"head": {"vars": ["x", "pop"]}, "results": {"bindings": rows}}

    e = Engine(spark, graph(spark, sf_dir), prefixes=PREFIXES, fetch=fetch)
    return e.query("SELECT ?n (xsd:integer(?pop) AS ?pop2) WHERE { ?x nation:n_name ?n SERVICE <http://example.org/sparql> { ?x <http://example.org/pop> ?pop } SERVICE SILENT <http://example.org/down> { ?a ?b ?c } }").withColumnRenamed("pop2", "pop")


@_query("load_ntriples", "SELECT n_name AS n FROM nation")
def load_ntriples(spark, sf_dir):
    """Writes triples as N-Triples and loads them into a store."""
    from .results import triple_lines
    from .shared import fresh_path

    path = fresh_path(spark, "export") + ".nt"
    made = engine(spark, sf_dir, "nation").query("CONSTRUCT { ?x nation:n_name ?n } WHERE { ?x nation:n_name ?n }")
    triple_lines(made).write.text(path)
    e = Engine(spark, prefixes=PREFIXES)
    e.update(f"LOAD <{path}> INTO GRAPH <http://example.org/loaded>")
    return e.query("SELECT ?n WHERE { GRAPH <http://example.org/loaded> { ?x nation:n_name ?n } }")


__all__ = ["IRI", "ORACLES", "QUERIES", "engine", "graph", "store"]
