"""Queries over the driver's tables. Each runs an operator of the library on a relation derived by plain SQL.

The relations are scaffolding: orders and line items stand for packages,
entries, references and edits, and arithmetic on keys makes every outcome
occur. A query has the same SQL for DuckDB where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codes import CODES
from .operators import nested, rules, scan
from .operators import relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views that both engines can read; {t} is a table.
VIEWS = {
    "b_items": """SELECT l_orderkey AS package_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS entry_index,
        CAST(floor(l_quantity) AS BIGINT) AS decoded_size, l_partkey AS k FROM lineitem""",
    "b_regions": """SELECT package_id, entry_index, 100 * entry_index + CASE WHEN package_id % 5 = 1 THEN 7 WHEN package_id % 5 = 2 AND entry_index = 1 THEN 3 ELSE 0 END AS start_,
        100 * (entry_index + 1) + CASE WHEN package_id % 5 = 3 AND entry_index = 0 THEN 9 ELSE 0 END AS end_ FROM b_items""",
    "b_named": """SELECT o_custkey AS package_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS entry_index, o_orderkey AS k,
        CASE WHEN o_orderkey % 11 = 0 THEN 'mimetype' WHEN o_orderkey % 13 = 0 THEN 'x/mimetype'
          ELSE concat(CASE o_orderkey % 3 WHEN 0 THEN 'KRX/OCD/' WHEN 1 THEN 'OCD/' ELSE '' END, 'Payload/ID-', CAST(o_orderkey AS STRING), '/f.pdf') END AS name,
        CAST(floor(o_totalprice) AS BIGINT) AS size_ FROM orders""",
    "b_refs": """SELECT o_custkey AS package_id, o_orderkey AS ref, o_orderkey - CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS number,
        concat('KRX/OCD/Payload/ID-', CAST(o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 100000000 ELSE 0 END AS STRING), '/f.pdf') AS declared_path,
        CASE WHEN o_custkey % 2 = 0 THEN 'KRX/OCD/' WHEN o_custkey % 3 = 0 THEN 'other/' END AS root_prefix FROM orders""",
    "b_edits": """SELECT o_custkey AS package_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, CAST(floor(o_totalprice) AS BIGINT) AS content FROM orders""",
}


def _tables(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridge relation, with the tables that it stands on."""
    _tables(spark, sf_dir, "lineitem" if name in ("b_items", "b_regions") else "orders")
    if name == "b_regions":
        _view(spark, sf_dir, "b_items").createOrReplaceTempView("b_items")
    return spark.sql(VIEWS[name])


def _with(sql: str, *views: str) -> str:
    held = ", ".join(f"{v} AS ({VIEWS[v].replace('AS STRING', 'AS VARCHAR')})" for v in views)
    return f"WITH {held}, {sql.strip().removeprefix('WITH ')}" if sql.strip().startswith("WITH ") else f"WITH {held} {sql}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = _with(sql, *views) if views else sql
        return f

    return add


# -- archive ----------------------------------------------------------------------


@query(
    "coverage_tiling",
    """WITH d AS (SELECT package_id, max(100 * (entry_index + 1)) + CASE WHEN package_id % 5 = 4 THEN package_id % 2 * 20 - 10 ELSE 0 END AS ends FROM b_items GROUP BY package_id),
    r AS (SELECT package_id, start_, end_, 0 AS last_ FROM b_regions UNION ALL SELECT package_id, ends, ends, 1 FROM d),
    w AS (SELECT *, row_number() OVER o AS place, coalesce(lag(end_) OVER o, 0) AS reached FROM r WINDOW o AS (PARTITION BY package_id ORDER BY last_, start_, end_)),
    c AS (SELECT package_id, place, CASE WHEN start_ < reached THEN 'archive.malformed.overlapping_ranges' WHEN start_ > reached AND reached = 0 THEN 'archive.malformed.prefix_bytes' WHEN start_ > reached THEN 'archive.malformed.unclaimed_bytes' END AS code FROM w)
    SELECT package_id, arg_min(code, place) FILTER (WHERE code IS NOT NULL) AS code FROM c GROUP BY package_id""",
    ("b_items", "b_regions"),
)
def coverage_tiling(spark, sf_dir):
    regions = _view(spark, sf_dir, "b_regions").select("package_id", F.col("start_").alias("start"), F.col("end_").alias("end"))
    off = F.when(F.col("package_id") % 5 == 4, F.col("package_id") % 2 * 20 - 10).otherwise(0)
    ends = _view(spark, sf_dir, "b_items").groupBy("package_id").agg(F.max(100 * (F.col("entry_index") + 1)).alias("m")).select("package_id", (F.col("m") + off).alias("directory_start"))
    return rel.coverage(regions, ends)


@query(
    "running_decoded_total",
    """SELECT package_id, entry_index, (sum(decoded_size) OVER o)::BIGINT AS total, CASE WHEN sum(decoded_size) OVER o > 100 THEN 'archive.over_limit.total_decoded_bytes' END AS code FROM b_items
    WINDOW o AS (PARTITION BY package_id ORDER BY entry_index ROWS UNBOUNDED PRECEDING)""",
    ("b_items",),
)
def running_decoded_total(spark, sf_dir):
    return rel.running_total(_view(spark, sf_dir, "b_items"), 100).select("package_id", "entry_index", "total", "code")


@query(
    "limit_first_violation",
    """SELECT package_id, entry_index, CASE WHEN entry_index > 5 THEN 'archive.over_limit.entries' WHEN decoded_size > 40 THEN 'archive.over_limit.entry_decoded_bytes' WHEN k % 100 > 90 THEN 'archive.over_limit.name_bytes' END AS code,
    CASE WHEN entry_index > 5 THEN 5 WHEN decoded_size > 40 THEN 40 WHEN k % 100 > 90 THEN 90 END AS limit_value, CASE WHEN entry_index > 5 THEN entry_index WHEN decoded_size > 40 THEN decoded_size WHEN k % 100 > 90 THEN k % 100 END AS observed FROM b_items""",
    ("b_items",),
)
def limit_first_violation(spark, sf_dir):
    v = rules.over_limit([("archive.over_limit.entries", F.col("entry_index"), 5), ("archive.over_limit.entry_decoded_bytes", F.col("decoded_size"), 40), ("archive.over_limit.name_bytes", F.col("k") % 100, 90)])
    return _view(spark, sf_dir, "b_items").select("package_id", "entry_index", v.alias("v")).select("package_id", "entry_index", "v.*")


@query(
    "flag_method_predicates",
    """WITH e AS (SELECT package_id, entry_index, k % 20000 AS f, k % 13 AS m, ((k % 7) * 256 + 20)::BIGINT AS made_by, CASE k % 5 WHEN 0 THEN 2175008768 WHEN 1 THEN 1107296256 WHEN 2 THEN 2717908992 WHEN 3 THEN 16 ELSE 0 END AS att, CASE WHEN k % 9 = 0 THEN 'd/' ELSE 'f' END AS name FROM b_items)
    SELECT package_id, entry_index, CASE WHEN f & 8257 != 0 THEN 'archive.unsupported.encryption' WHEN f & 32 != 0 THEN 'archive.unsupported.patched_data' END AS flag_code, CASE WHEN m NOT IN (0, 8) THEN 'archive.unsupported.method' END AS method_code,
    CASE WHEN name LIKE '%/' THEN 'directory' WHEN made_by >> 8 IN (3, 19) THEN CASE (att >> 16) & 61440 WHEN 32768 THEN 'regular' WHEN 16384 THEN 'directory' WHEN 40960 THEN 'symlink' ELSE 'special' END
      WHEN made_by >> 8 IN (0, 10, 11, 14) THEN CASE WHEN att & 16 = 0 THEN 'regular' ELSE 'directory' END ELSE 'unknown' END AS kind FROM e""",
    ("b_items",),
)
def flag_method_predicates(spark, sf_dir):
    k = F.col("k")
    att = F.when(k % 5 == 0, 2175008768).when(k % 5 == 1, 1107296256).when(k % 5 == 2, 2717908992).when(k % 5 == 3, 16).otherwise(0).cast("long")
    kind = rules.kind((k % 7) * 256 + 20, att, F.when(k % 9 == 0, "d/").otherwise("f"))
    return _view(spark, sf_dir, "b_items").select("package_id", "entry_index", rules.flags(k % 20000).alias("flag_code"), rules.method(k % 13).alias("method_code"), kind.alias("kind"))


@query(
    "entry_lookup_first",
    """WITH s AS (SELECT package_id, entry_index, name, CASE WHEN entry_index = 0 AND name = 'mimetype' THEN -1 ELSE entry_index END AS r FROM b_named WHERE name = 'mimetype' OR name LIKE '%/mimetype'),
    m AS (SELECT package_id, arg_min(entry_index, r) AS i, arg_min(name, r) AS n FROM s GROUP BY package_id), f AS (SELECT package_id, min(entry_index) AS j FROM b_named WHERE name = 'mimetype' GROUP BY package_id)
    SELECT m.package_id, i AS entry_index, CASE WHEN n <> 'mimetype' THEN 'prefixed' WHEN i <> 0 THEN 'not_first' ELSE 'first' END AS marker, j = 0 AS is_first FROM m LEFT JOIN f USING (package_id)""",
    ("b_named",),
)
def entry_lookup_first(spark, sf_dir):
    return rel.marker(_view(spark, sf_dir, "b_named")).select("package_id", "entry_index", "marker", (F.col("exact") == 0).alias("is_first"))


# -- names ---------------------------------------------------------------------------

#: Names of every class from urls and their ids.
SPOILED = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN concat(url, chr(7)) WHEN 2 THEN concat('a', chr(92), url) WHEN 3 THEN concat('/', url) WHEN 4 THEN concat('C:', url) WHEN 5 THEN concat('x/../', url)
    WHEN 6 THEN 'dir/' ELSE url END AS name, page_id % 2 = 0 AS has_data FROM pages"""


@query(
    "name_safety",
    f"""SELECT page_id, CASE WHEN name = '' THEN 'empty' WHEN regexp_matches(name, '[\\x00-\\x1f\\x7f]') THEN 'control_byte' WHEN contains(name, chr(92)) THEN 'backslash' WHEN name LIKE '/%' THEN 'absolute_path'
    WHEN regexp_matches(name, '^[A-Za-z]:') THEN 'drive_prefix' WHEN list_contains(string_split(name, '/'), '..') THEN 'parent_component' WHEN name LIKE '%/' AND has_data THEN 'directory_with_data' END AS unsafe FROM ({SPOILED})""",
)
def name_safety(spark, sf_dir):
    _tables(spark, sf_dir, "pages")
    return spark.sql(SPOILED).select("page_id", rules.unsafe_name(F.col("name"), F.col("has_data")).alias("unsafe"))


PARTS = """SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'a//b' WHEN 1 THEN './b' WHEN 2 THEN 'a/..' WHEN 3 THEN concat('a', chr(9), 'b') WHEN 4 THEN 'a/b./c' WHEN 5 THEN 'a /b' WHEN 6 THEN 'a/ b' WHEN 7 THEN 'x/Com1.txt' WHEN 8 THEN repeat('d/', 20)
    WHEN 9 THEN repeat('n', 300) WHEN 10 THEN repeat('pqrstuvwxy/', 100) ELSE replace(url, '//', '/') END AS path FROM pages"""

_UNSAFE = "CASE WHEN c = '' THEN 'empty_component' WHEN c = '.' THEN 'current_component' WHEN c = '..' THEN 'parent_component' WHEN regexp_matches(c, '[\\x00-\\x1f\\x7f]') THEN 'control_character' WHEN c LIKE '%.' THEN 'trailing_dot' WHEN c LIKE '% ' THEN 'trailing_space' WHEN c LIKE ' %' THEN 'leading_space' WHEN regexp_matches(upper(string_split(c, '.')[1]), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN 'reserved_device_name' WHEN contains(c, ':') THEN 'colon' WHEN regexp_matches(c, '[*?<>|\"]') THEN 'reserved_character' END"


@query(
    "component_safety",
    f"""WITH p AS ({PARTS}), e AS (SELECT page_id, path, unnest(string_split(path, '/')) AS c, generate_subscripts(string_split(path, '/'), 1) AS i FROM p),
    b AS (SELECT page_id, i, coalesce('extract.unsafe_path.' || {_UNSAFE}, CASE WHEN strlen(c) > 255 THEN 'extract.over_limit.component_bytes' END) AS code FROM e),
    f AS (SELECT page_id, arg_min(code, i) AS code FROM b WHERE code IS NOT NULL GROUP BY page_id)
    SELECT p.page_id, CASE WHEN strlen(path) > 1024 THEN 'extract.over_limit.path_bytes' WHEN len(string_split(path, '/')) > 16 THEN 'extract.over_limit.depth' ELSE f.code END AS code FROM p LEFT JOIN f USING (page_id)""",
)
def component_safety(spark, sf_dir):
    _tables(spark, sf_dir, "pages")
    return spark.sql(PARTS).select("page_id", rules.unsafe_path(F.col("path")).alias("code"))


FOLDED = "SELECT CAST(p_size AS BIGINT) AS package_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS entry_index, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS name FROM part"


@query(
    "fold_collision",
    f"""WITH e AS ({FOLDED}), w AS (SELECT *, row_number() OVER (PARTITION BY package_id, lower(name) ORDER BY entry_index) AS f, row_number() OVER (PARTITION BY package_id, name ORDER BY entry_index) AS x FROM e),
    c AS (SELECT package_id, min(entry_index) AS entry_index FROM w WHERE f > 1 GROUP BY package_id)
    SELECT package_id, entry_index, CASE WHEN x > 1 THEN 'archive.ambiguous.duplicate_name' ELSE 'archive.ambiguous.case_folded_duplicate_name' END AS code FROM c JOIN w USING (package_id, entry_index)""",
)
def fold_collision(spark, sf_dir):
    _tables(spark, sf_dir, "part")
    return rel.fold_collisions(spark.sql(FOLDED))


#: Composed and decomposed letters in two cases: NFC and lower case decide whether paths collide.
NFC = """SELECT doc_id % 8 AS package_id, doc_id AS entry_index, concat(lang, '/', CASE doc_id % 4 WHEN 0 THEN concat('e', chr(769)) WHEN 1 THEN chr(233) WHEN 2 THEN concat('E', chr(769)) ELSE 'plain' END, CASE WHEN doc_id % 7 = 0 THEN 'X' ELSE CAST(doc_id % 11 AS STRING) END) AS path FROM documents"""


@query(
    "output_collision_nfc",
    f"""WITH e AS ({NFC.replace("AS STRING", "AS VARCHAR")}), w AS (SELECT *, row_number() OVER (PARTITION BY package_id, lower(nfc_normalize(path)) ORDER BY entry_index) AS n FROM e)
    SELECT package_id, min(entry_index) AS entry_index, 'extract.ambiguous.collision' AS code FROM w WHERE n > 1 GROUP BY package_id""",
)
def output_collision_nfc(spark, sf_dir):
    _tables(spark, sf_dir, "documents")
    # Spark's chr stops at 255
    return rel.collisions(scan.add_keys(spark.sql(NFC.replace("chr(769)", "decode(unhex('CC81'), 'UTF-8')"))).withColumn("entry_index", F.col("entry_index").cast("int"))).withColumn("entry_index", F.col("entry_index").cast("long"))


KEYS = "SELECT package_id, CAST(entry_index AS INT) AS entry_index, CASE WHEN k % 29 = 0 THEN 'payload' WHEN k % 31 = 0 THEN 'krx/ocd' ELSE lower(name) END AS key_ FROM b_named"


@query(
    "file_dir_conflict",
    f"""WITH f AS (SELECT package_id, key_, min(entry_index) AS entry_index FROM ({KEYS}) GROUP BY ALL), u AS (SELECT package_id, entry_index, string_split(key_, '/') AS p, unnest(range(1, len(string_split(key_, '/')))) AS d FROM f),
    h AS (SELECT u.package_id, greatest(u.entry_index, f.entry_index) AS e FROM u JOIN f ON f.package_id = u.package_id AND f.key_ = array_to_string(u.p[1:u.d], '/'))
    SELECT package_id, min(e) AS entry_index, 'extract.ambiguous.file_directory_conflict' AS code FROM h GROUP BY package_id""",
    ("b_named",),
)
def file_dir_conflict(spark, sf_dir):
    _view(spark, sf_dir, "b_named").createOrReplaceTempView("b_named")
    # files that stand twice are told apart, as only conflicts with directories are asked for
    keys = spark.sql(KEYS).withColumnRenamed("key_", "key").groupBy("package_id", "key").agg(F.min("entry_index").alias("entry_index"))
    return rel.collisions(keys)


@query(
    "implicit_directories",
    "SELECT DISTINCT package_id, array_to_string(p[1:d], '/') AS directory FROM (SELECT page_id % 20 AS package_id, string_split(url, '/') AS p, unnest(range(1, len(string_split(url, '/')))) AS d FROM pages)",
)
def implicit_directories(spark, sf_dir):
    _tables(spark, sf_dir, "pages")
    return rel.directories(spark.sql("SELECT page_id % 20 AS package_id, url AS path FROM pages"))


# -- references and checks ----------------------------------------------------------------

_RESOLVED = """t AS (SELECT *, CASE WHEN declared_path LIKE 'KRX/OCD/%' THEN substr(declared_path, 9) ELSE declared_path END AS tail, coalesce(root_prefix, '') AS seen FROM b_refs),
    c AS (SELECT package_id, ref, 0 AS rank, declared_path AS name FROM t UNION ALL SELECT package_id, ref, 1, seen || tail FROM t WHERE seen || tail <> declared_path
      UNION ALL SELECT package_id, ref, r, p || tail FROM t, (VALUES (2, 'KRX/OCD/'), (3, 'OCD/'), (4, 'KRX/'), (5, '')) v(r, p) WHERE p <> seen AND p || tail <> declared_path),
    b AS (SELECT c.package_id, ref, min(rank) AS rank, arg_min(entry_index, rank) AS entry_index FROM c JOIN b_named n ON n.package_id = c.package_id AND n.name = c.name GROUP BY c.package_id, ref),
    z AS (SELECT t.package_id, t.ref, CASE WHEN rank IS NULL THEN 'missing' WHEN rank = 0 THEN 'resolved' ELSE 'prefix_variant' END AS resolution, entry_index FROM t LEFT JOIN b USING (package_id, ref))"""


def _resolved(spark, sf_dir):
    return rel.resolve(_view(spark, sf_dir, "b_refs"), _view(spark, sf_dir, "b_named"))


@query("reference_resolution", f"WITH {_RESOLVED} SELECT package_id, ref, resolution, entry_index FROM z", ("b_named", "b_refs"))
def reference_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("package_id", "ref", "resolution", "entry_index")


@query(
    "reference_outcome",
    f"""WITH {_RESOLVED}, g AS (SELECT package_id, bool_or(resolution = 'missing') AS m, bool_or(resolution = 'prefix_variant') AS p FROM z GROUP BY package_id)
    SELECT package_id, CASE WHEN m THEN 'fail' WHEN p THEN 'unresolved' ELSE 'pass' END AS outcome, CASE WHEN m THEN 'metadata.reference.missing_entry' END AS code, CASE WHEN NOT m AND p THEN 'M14' END AS rule FROM g""",
    ("b_named", "b_refs"),
)
def reference_outcome(spark, sf_dir):
    return rel.reference_outcomes(_resolved(spark, sf_dir))


DECLARED = """SELECT o_orderkey AS package_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 8 END AS declared, coalesce(n, 0) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


@query("declared_count_agrees", f"SELECT package_id, CASE WHEN ok THEN 'pass' WHEN NOT ok THEN 'fail' ELSE 'not_applicable' END AS outcome FROM (SELECT package_id, bool_and(declared = actual) FILTER (WHERE declared IS NOT NULL) AS ok FROM ({DECLARED}) GROUP BY package_id)")
def declared_count_agrees(spark, sf_dir):
    _tables(spark, sf_dir, "orders", "lineitem")
    return rel.count_agrees(spark.sql(DECLARED))


@query("reference_uniqueness", "SELECT package_id, CASE WHEN count(*) > count(DISTINCT number) OR count(*) > count(DISTINCT declared_path) THEN 'fail' ELSE 'pass' END AS outcome FROM (SELECT package_id, number % 50 AS number, declared_path FROM b_refs) GROUP BY package_id", ("b_refs",))
def reference_uniqueness(spark, sf_dir):
    return rel.uniqueness(_view(spark, sf_dir, "b_refs").withColumn("number", F.col("number") % 50))


OUTCOMES = """SELECT o_orderkey AS package_id, 'metadata_location' AS check, 'pass' AS outcome, CAST(NULL AS STRING) AS code, CAST(NULL AS STRING) AS rule FROM orders
    UNION ALL SELECT o_orderkey, 'root_prefix', 'unresolved', NULL, 'A19' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'marker_entry', 'unresolved', NULL, 'A19' FROM orders WHERE o_orderkey % 6 = 0
    UNION ALL SELECT o_orderkey, 'declared_size', 'unresolved', NULL, 'M13' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'attachment_count', 'fail', 'metadata.count_mismatch', NULL FROM orders WHERE o_orderkey % 7 = 0"""

_ORD = ", ".join(f"({i}, '{c}')" for i, c in enumerate(nested.CHECKS))


@query(
    "check_matrix_summary",
    f"""WITH o AS ({OUTCOMES.replace("AS STRING", "AS VARCHAR").replace("AS check", 'AS "check"')}), d AS (SELECT * FROM (VALUES {_ORD}) v(ord, name)),
    m AS (SELECT p.package_id, d.ord, coalesce(o.outcome, 'not_applicable') AS outcome, o.rule FROM (SELECT o_orderkey AS package_id FROM orders) p CROSS JOIN d LEFT JOIN o ON o.package_id = p.package_id AND o."check" = d.name)
    SELECT package_id, CASE WHEN bool_or(outcome = 'fail') THEN 'inconsistent' WHEN bool_or(outcome = 'unresolved') THEN 'unresolved' ELSE 'consistent' END AS summary,
      CASE WHEN bool_or(outcome = 'fail') THEN 3 WHEN bool_or(outcome = 'unresolved') THEN 4 ELSE 0 END AS exit_status, count(*) FILTER (WHERE outcome = 'not_applicable') AS not_applicable,
      coalesce(string_agg(rule, ',' ORDER BY ord) FILTER (WHERE outcome = 'unresolved' AND (rule <> 'A19' OR ord = 2)), '') AS rules FROM m GROUP BY package_id""",
)
def check_matrix_summary(spark, sf_dir):
    _tables(spark, sf_dir, "orders")
    done = rel.summaries(rel.check_matrix(spark.sql("SELECT o_orderkey AS package_id FROM orders"), spark.sql(OUTCOMES)))
    na = F.size(F.filter("checks", lambda c: c["outcome"] == "not_applicable")).cast("long")
    return done.select("package_id", "summary", "exit_status", na.alias("not_applicable"), F.array_join("unresolved_rules", ",").alias("rules"))


@query(
    "optional_fields_complete",
    """SELECT o_custkey AS package_id, bool_and(o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 1) AND o_custkey % 6 <> 0 AS complete, bool_or(o_orderkey % 9 = 0) AS has_instructions FROM orders GROUP BY o_custkey""",
)
def optional_fields_complete(spark, sf_dir):
    _tables(spark, sf_dir, "orders")
    rows = spark.sql("""SELECT o_custkey AS package_id, collect_list(struct(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'd' END AS description, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END AS size_value)) AS a,
        collect_list(o_orderkey % 9 = 0) AS i FROM orders GROUP BY o_custkey""")
    every = F.forall("a", lambda x: x["description"].isNotNull() & x["size_value"].isNotNull())
    return rows.select("package_id", (every & (F.col("package_id") % 6 != 0)).alias("complete"), F.exists("i", lambda x: x).alias("has_instructions"))


@query(
    "saturating_count",
    "SELECT l_orderkey AS package_id, CASE WHEN count(v) = 0 THEN NULL ELSE least(sum(v::HUGEINT), 9223372036854775807)::VARCHAR END AS declared FROM (SELECT l_orderkey, CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN 9223372036854775800 ELSE l_partkey END AS v FROM lineitem) GROUP BY l_orderkey",
)
def saturating_count(spark, sf_dir):
    _tables(spark, sf_dir, "lineitem")
    rows = spark.sql("SELECT l_orderkey AS package_id, transform(collect_list(struct(CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN 9223372036854775800 ELSE l_partkey END AS v)), x -> x.v) AS d FROM lineitem GROUP BY l_orderkey")
    return rows.select("package_id", rules.saturating_sum(F.col("d")).cast("string").alias("declared"))


# -- plan, writer, editor --------------------------------------------------------------------

PLANNED = """SELECT package_id, entry_index, CASE WHEN k % 37 = 0 THEN NULL WHEN k % 23 = 0 THEN 'a/con/b' WHEN k % 41 = 0 THEN 'Payload' ELSE name END AS name,
    CASE WHEN k % 43 = 0 THEN 'symlink' WHEN k % 47 = 0 THEN 'special' WHEN k % 19 = 0 THEN 'directory' ELSE 'regular' END AS kind, size_ AS decoded_size FROM b_named"""


@query(
    "extraction_plan",
    f"""WITH e AS ({PLANNED}), r AS (SELECT *, count(*) OVER o AS n, sum(decoded_size) OVER o AS upto FROM e WHERE kind <> 'directory' WINDOW o AS (PARTITION BY package_id ORDER BY entry_index ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, CASE WHEN kind = 'symlink' THEN 'extract.unsupported.link' WHEN kind = 'special' THEN 'extract.unsupported.special_file' WHEN name IS NULL THEN 'extract.unsupported.non_utf8_name'
      WHEN name LIKE '%/con/%' THEN 'extract.unsafe_path.reserved_device_name' WHEN n > 12 THEN 'extract.over_limit.files' WHEN upto > 3000000 THEN 'extract.over_limit.total_bytes' END AS code FROM r),
    f1 AS (SELECT package_id, min(entry_index) AS entry_index, arg_min(code, entry_index) AS code FROM c WHERE code IS NOT NULL GROUP BY package_id),
    k1 AS (SELECT package_id, entry_index, lower(name) AS key_, decoded_size FROM c WHERE package_id NOT IN (SELECT package_id FROM f1)),
    d AS (SELECT package_id, entry_index, row_number() OVER (PARTITION BY package_id, key_ ORDER BY entry_index) AS n FROM k1),
    f2 AS (SELECT package_id, min(entry_index) AS entry_index, 'extract.ambiguous.collision' AS code FROM d WHERE n > 1 GROUP BY package_id),
    k2 AS (SELECT * FROM k1 WHERE package_id NOT IN (SELECT package_id FROM f2)),
    u AS (SELECT package_id, entry_index, string_split(key_, '/') AS p, unnest(range(1, len(string_split(key_, '/')))) AS x FROM k2),
    f3 AS (SELECT u.package_id, min(greatest(u.entry_index, k2.entry_index)) AS entry_index, 'extract.ambiguous.file_directory_conflict' AS code FROM u JOIN k2 ON k2.package_id = u.package_id AND k2.key_ = array_to_string(u.p[1:u.x], '/') GROUP BY u.package_id)
    SELECT package_id, entry_index, code FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)
    UNION ALL SELECT package_id, entry_index, 'planned' FROM k2 WHERE package_id NOT IN (SELECT package_id FROM f3)""",
    ("b_named",),
)
def extraction_plan(spark, sf_dir):
    _view(spark, sf_dir, "b_named").createOrReplaceTempView("b_named")
    e = scan.add_keys(spark.sql(PLANNED).withColumnRenamed("name", "path").withColumn("entry_index", F.col("entry_index").cast("int")))
    made = rel.plan(e, files=12, total=3_000_000)
    entry = lambda i, code: F.struct(i.cast("long").alias("entry_index"), code.alias("code"))
    rows = F.when(F.col("failure").isNotNull(), F.array(entry(F.col("failure.entry_index"), F.col("failure.code")))).otherwise(F.transform("items", lambda i: entry(i["entry_index"], F.lit("planned"))))
    return made.select("package_id", F.inline(rows))


@query(
    "derive_references",
    "SELECT package_id, k, number, 'KRX/OCD/Payload/ID-' || number AS location, (((size_ + 1023) // 1024))::VARCHAR AS size_text FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY k) AS number FROM b_named)",
    ("b_named",),
)
def derive_references(spark, sf_dir):
    return rel.derive_references(_view(spark, sf_dir, "b_named").select("package_id", "k", F.col("k").alias("ordinal"), F.col("size_").alias("size"))).select("package_id", "k", "number", "location", "size_text")


STAMPS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(y, '-02-30T01:02:03') WHEN 1 THEN '1979-12-31T23:59:59' WHEN 2 THEN concat(y, '-', m, '-', d, ' 01:02:03') WHEN 3 THEN concat(y, '-', m, '-', d, 'T24:00:00') ELSE concat(y, '-', m, '-', d, 'T13:', m, ':5', CAST(o_orderkey % 10 AS STRING)) END AS t
    FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d FROM orders)"""


@query(
    "dos_timestamp",
    f"""WITH s AS ({STAMPS.replace("AS STRING", "AS VARCHAR")}), p AS (SELECT o_orderkey, try_strptime(t, '%Y-%m-%dT%H:%M:%S') AS x FROM s)
    SELECT o_orderkey, CASE WHEN year(x) BETWEEN 1980 AND 2107 THEN ((year(x) - 1980) * 512 + month(x) * 32 + day(x))::INT END AS dos_date, CASE WHEN year(x) BETWEEN 1980 AND 2107 THEN (hour(x) * 2048 + minute(x) * 32 + second(x) // 2)::INT END AS dos_time FROM p""",
)
def dos_timestamp(spark, sf_dir):
    _tables(spark, sf_dir, "orders")
    return spark.sql(STAMPS).select("o_orderkey", rules.timestamp_fields(F.col("t")).alias("f")).select("o_orderkey", F.col("f.date").alias("dos_date"), F.col("f.time").alias("dos_time"))


LEAVES = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat(' ', text) WHEN 1 THEN concat('<', text, '&>') WHEN 2 THEN concat('x', chr(13), text, 'y') WHEN 3 THEN concat('x', chr(1), 'y') ELSE text END AS t FROM documents"


@query(
    "xml_escape",
    f"""WITH s AS ({LEAVES}), c AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '^[\\t-\\r ]') OR regexp_matches(t, '[\\t-\\r ]$') THEN 'create.invalid.untrimmed_text' WHEN regexp_matches(t, '[\\x00-\\x08\\x0b-\\x1f]') THEN 'create.invalid.text' END AS code FROM s)
    SELECT doc_id, code, CASE WHEN code IS NULL THEN strlen(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) END AS escaped_bytes FROM c""",
)
def xml_escape(spark, sf_dir):
    _tables(spark, sf_dir, "documents")
    return spark.sql(LEAVES).select("doc_id", rules.xml_escape(F.col("t")).alias("e")).select("doc_id", "e.code", F.octet_length("e.escaped").cast("long").alias("escaped_bytes"))


EDITS = """SELECT package_id, 'remove' AS op, CAST(number AS INT) AS ord, number, CAST(NULL AS BIGINT) AS content FROM b_edits WHERE k % 5 = 0
    UNION ALL SELECT package_id, 'replace', CAST(number AS INT), number, content + 1 FROM b_edits WHERE k % 5 = 1 UNION ALL SELECT package_id, 'add', CAST(number AS INT), CAST(NULL AS BIGINT), content * 2 FROM b_edits WHERE k % 5 = 2"""


@query(
    "edit_plan",
    f"""WITH e AS ({EDITS}), a AS (SELECT b.package_id, 0 AS part, b.number AS place, b.number AS old_number, CASE WHEN c.number IS NULL THEN 'preserved' ELSE 'changed' END AS action, CASE WHEN c.number IS NULL THEN b.content ELSE c.content END AS content
      FROM b_edits b LEFT JOIN (SELECT * FROM e WHERE op = 'replace') c USING (package_id, number) WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.op = 'remove' AND r.package_id = b.package_id AND r.number = b.number)
      UNION ALL SELECT package_id, 1, ord, NULL, 'added', content FROM e WHERE op = 'add')
    SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY part, place) AS number, old_number, action, content FROM a""",
    ("b_edits",),
)
def edit_plan(spark, sf_dir):
    _view(spark, sf_dir, "b_edits").createOrReplaceTempView("b_edits")
    return rel.edit_plan(spark.table("b_edits").select("package_id", F.col("number").cast("long").alias("number"), "content"), spark.sql(EDITS).withColumn("number", F.col("number").cast("long")))


TARGETS = """SELECT package_id, 'remove' AS op, CAST(number AS INT) AS ord, CASE WHEN k % 15 = 0 THEN number + 100 WHEN k % 25 = 0 THEN 0 ELSE number END AS number FROM b_edits WHERE k % 5 = 0
    UNION ALL SELECT package_id, 'replace', CAST(number AS INT), CASE WHEN k % 10 = 1 THEN number - 1 ELSE number END FROM b_edits WHERE k % 5 IN (0, 1) AND k % 3 = 1"""


@query(
    "edit_targets",
    f"""WITH e AS ({TARGETS}), n AS (SELECT package_id, count(*) AS n FROM b_edits GROUP BY package_id), p AS (SELECT e.*, n, CASE WHEN op = 'remove' THEN 0 ELSE 1 END AS o FROM e JOIN n USING (package_id)),
    w AS (SELECT *, row_number() OVER (PARTITION BY package_id, number ORDER BY o, ord) AS again FROM p), c AS (SELECT *, CASE WHEN number < 1 OR number > n THEN 'repack.invalid.no_such_attachment' WHEN again > 1 THEN 'repack.invalid.duplicate_target' END AS code FROM w)
    SELECT package_id, arg_min(number, (o, ord)) AS number, arg_min(code, (o, ord)) AS code FROM c WHERE code IS NOT NULL GROUP BY package_id""",
    ("b_edits",),
)
def edit_targets(spark, sf_dir):
    _view(spark, sf_dir, "b_edits").createOrReplaceTempView("b_edits")
    return rel.edit_targets(spark.sql(TARGETS), spark.table("b_edits").groupBy("package_id").agg(F.count("*").alias("n")))


@query("tri_state_edits", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name END AS note FROM customer")
def tri_state_edits(spark, sf_dir):
    _tables(spark, sf_dir, "customer")
    op = F.when(F.col("c_custkey") % 3 == 0, "keep").when(F.col("c_custkey") % 3 == 1, "set").otherwise("clear")
    return spark.table("customer").select("c_custkey", rules.edit(op, F.col("c_name"), F.col("c_mktsegment")).alias("note"))


LAYOUT = """SELECT package_id, entry_index, CASE WHEN entry_index = 0 AND package_id % 7 <> 1 THEN 'KRX/OCD/mimetype'
    WHEN entry_index = 1 AND package_id % 7 = 2 THEN 'OCD/Metalayer/KULDEMENY_META.xml' WHEN entry_index = 1 AND package_id % 7 = 3 THEN 'KRX/OCD/metalayer/KULDEMENY_META.xml' WHEN entry_index = 1 THEN 'KRX/OCD/Metalayer/KULDEMENY_META.xml'
    WHEN entry_index = 3 AND package_id % 7 = 4 THEN 'KRX/OCD/Payload/ID-1/f' WHEN entry_index = 2 AND package_id % 7 = 5 THEN 'KRX/OCD/Metalayer/KULDEMENY_META.xml' ELSE concat('KRX/OCD/Payload/ID-', CAST(entry_index - 1 AS STRING), '/f.pdf') END AS name FROM b_named"""


@query(
    "layout_recognition",
    f"""WITH e AS ({LAYOUT.replace("AS STRING", "AS VARCHAR")}), s AS (SELECT *, regexp_matches(lower(name), '(^|/)metalayer/kuldemeny_meta[.]xml$') AS shaped FROM e),
    g AS (SELECT package_id, count(*) FILTER (WHERE shaped) AS found, max(name) FILTER (WHERE shaped) AS d, arg_max(entry_index, name) FILTER (WHERE shaped) AS i, max(name) FILTER (WHERE entry_index = 0) AS head,
      coalesce(bool_or(NOT regexp_matches(name, '^KRX/OCD/Payload/ID-' || (entry_index - 1) || '/[^/]+$')) FILTER (WHERE entry_index >= 2), FALSE) AS stray FROM s GROUP BY package_id)
    SELECT package_id, CASE WHEN found <> 1 THEN 'repack.unsupported.metadata_missing' WHEN left(d, length(d) - 28) <> 'KRX/OCD/' THEN 'repack.unsupported.root_prefix' WHEN d <> 'KRX/OCD/Metalayer/KULDEMENY_META.xml' THEN 'repack.unsupported.metadata_name'
      WHEN head <> 'KRX/OCD/mimetype' THEN 'repack.unsupported.marker' WHEN i <> 1 OR stray THEN 'repack.unsupported.extra_entry' END AS code FROM g""",
    ("b_named",),
)
def layout_recognition(spark, sf_dir):
    _view(spark, sf_dir, "b_named").createOrReplaceTempView("b_named")
    return rel.layout(spark.sql(LAYOUT))


# -- requests, codes, reports ------------------------------------------------------------------

REQUESTS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[1]' WHEN 1 THEN '{"k": 1, "extra": 2}' WHEN 2 THEN '{}' ELSE props END AS request FROM events"""


@query(
    "strict_json_keys",
    f"""SELECT event_id, CASE WHEN json_type(request) <> 'OBJECT' THEN 'manifest.invalid.syntax' WHEN len(list_filter(json_keys(request), lambda x: x <> 'k')) > 0 THEN 'manifest.invalid.unknown_field' WHEN NOT list_contains(json_keys(request), 'k') THEN 'manifest.invalid.missing_field' END AS code FROM (SELECT event_id, request::JSON AS request FROM ({REQUESTS}))""",
)
def strict_json_keys(spark, sf_dir):
    _tables(spark, sf_dir, "events")
    return rel.strict_keys(spark.sql(REQUESTS), "request", ("k",), ("k",)).select("event_id", "code")


CODED = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 8 WHEN 0 THEN 'input.unreadable' WHEN 1 THEN 'archive.over_limit.entries' WHEN 2 THEN 'metadata.unsupported.dtd' WHEN 3 THEN 'metadata.missing' WHEN 4 THEN 'output.exists'
    WHEN 5 THEN 'extract.unsafe_path.colon' WHEN 6 THEN 'metadata.reference.duplicate' ELSE 'create.internal.self_check_failed' END AS code FROM lineitem"""


@query(
    "classify_codes",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, code, c AS category, CASE c WHEN 'input' THEN 5 WHEN 'limit' THEN 8 WHEN 'unsupported' THEN 7 WHEN 'inconsistent' THEN 3 WHEN 'output' THEN 9 ELSE 6 END AS exit_status
    FROM (SELECT *, CASE WHEN string_split(code, '.')[1] IN ('input', 'output') THEN string_split(code, '.')[1] WHEN string_split(code, '.')[2] = 'over_limit' THEN 'limit' WHEN string_split(code, '.')[2] = 'unsupported' THEN 'unsupported' WHEN string_split(code, '.')[2] IN ('missing', 'reference', 'count_mismatch') THEN 'inconsistent' ELSE 'package' END AS c FROM ({CODED}))""",
)
def classify_codes(spark, sf_dir):
    _tables(spark, sf_dir, "lineitem")
    c = rules.category(F.col("code"))
    return spark.sql(CODED).select("*", c.alias("category"), rules.exit_status(c).alias("exit_status"))


@query("hex_listing", "SELECT p_partkey, lpad(lower(hex(p_partkey)), 8, '0') AS crc32, CASE WHEN p_partkey % 3 = 0 THEN 'ff' || lower(hex(p_name)) END AS name_hex FROM part")
def hex_listing(spark, sf_dir):
    _tables(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.unhex(F.lit("FF")), F.col("p_name").cast("binary"))).otherwise(F.col("p_name").cast("binary"))
    return spark.table("part").select("p_partkey", rules.crc_hex(F.col("p_partkey")).alias("crc32"), rules.hex_unless_text(raw).alias("name_hex"))


@query("crc32_column")
def crc32_column(spark, sf_dir):
    _tables(spark, sf_dir, "pages")
    return spark.table("pages").select("page_id", F.crc32(F.col("html").cast("binary")).alias("crc32"), rules.crc_hex(F.crc32(F.col("html").cast("binary"))).alias("crc32_hex"))


_HIDDEN = "[\\x{00}-\\x{1f}\\x{7f}-\\x{9f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{feff}\\x{fff9}-\\x{fffb}]"


@query(
    "terminal_escape",
    f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(substr(text, 1, 200), '(?s).'), lambda c: CASE WHEN regexp_matches(c, '{_HIDDEN}') THEN printf('\\u{{%04x}}', unicode(c)) ELSE c END), '') || CASE WHEN length(text) > 200 THEN chr(8230) || '[+' || (length(text) - 200) || ']' ELSE '' END AS shown FROM documents""",
)
def terminal_escape(spark, sf_dir):
    _tables(spark, sf_dir, "documents")
    return spark.table("documents").select("doc_id", scan.terminal_safe(F.col("text").cast("binary")).alias("shown"))


@query(
    "code_catalogue",
    f"""SELECT code, c AS category, CASE c WHEN 'input' THEN 5 WHEN 'limit' THEN 8 WHEN 'unsupported' THEN 7 WHEN 'inconsistent' THEN 3 WHEN 'output' THEN 9 ELSE 6 END AS exit_status
    FROM (SELECT code, CASE WHEN a IN ('input', 'output') THEN a WHEN b = 'over_limit' THEN 'limit' WHEN b = 'unsupported' THEN 'unsupported' WHEN b IN ('missing', 'reference', 'count_mismatch') THEN 'inconsistent' ELSE 'package' END AS c
      FROM (SELECT code, string_split(code, '.')[1] AS a, string_split(code, '.')[2] AS b FROM (VALUES {", ".join(f"('{c}')" for c in CODES)}) v(code)))""",
)
def code_catalogue(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c in CODES], "code string")
    return rows.withColumn("category", rules.category(F.col("code"))).withColumn("exit_status", rules.exit_status(F.col("category")))


@query("declared_path", "SELECT page_id, CASE WHEN rtrim(l, '/') = '' THEN url ELSE rtrim(l, '/') || '/' || url END AS path FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a/b//' ELSE 'c' END AS l FROM pages)")
def declared_path(spark, sf_dir):
    _tables(spark, sf_dir, "pages")
    at = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "a/b//").otherwise("c")
    return spark.table("pages").select("page_id", rules.declared_path(at, F.col("url")).alias("path"))
