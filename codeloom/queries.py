"""Registered queries of the detectors and other operators, and the SQL that tells what they must find.

The driver's tables hold no source code. Queries of the first kind write source from columns by a template, and run the
extractor and the detector on it; the SQL finds the same from the columns, without any source. Those of the second kind
take rows as facts and run the detector or operator on these.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .operators.detectors import DETECTORS, PROJECT, SEVERAL, dealt, effect_sets, facts_for, function_effects, tasks_of
from .operators.suppress import baseline_of, evidence_hash, inline_ignores, unsuppressed
from .plans.facts import Facts, module_of
from .plans.report import excerpt, summary, tolerant_json, with_verdicts
from .sources.code import own_effects

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task should turn into files.
ROWS_EACH = 20_000


def _spread(rows: DataFrame, key: str, files_each: int = 1) -> DataFrame:
    """rows dealt out for the parsing of the files written from them: a task for each ROWS_EACH files, one a core at least.
    The files are written after that, so that no source is shuffled."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-rows.count() * files_each // ROWS_EACH)), key)


def _lines(n: str, each: str, sep: str = "\\n") -> str:
    """SQL for `each` (an expression of i) for i from 1 to n."""
    return f"array_join(transform(IF(({n}) > 0, sequence(1, int({n})), array()), i -> {each}), '{sep}')"


def _of_parts(name: str, source: str, sql: str, measure: bool = True, **params) -> None:
    """A query that runs a detector on a file for each part, written by an SQL expression; its result has the parts'
    keys, the findings' lines and measures."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
        files = part.selectExpr("concat('pkg/p', p_partkey, '.py') AS path", f"{source} AS source")
        found = DETECTORS[name](facts_for(files, [name], keep=name in PROJECT | SEVERAL), **params)
        columns = [F.regexp_extract("file", r"p(\d+)\.py", 1).cast("long").alias("p_partkey"), F.col("line").cast("int").alias("line")]
        return found.select(*columns, *([F.round("measure", 6).alias("measure")] if measure else []))

    QUERIES[name], SQL[name] = run, sql


def _config_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")  # parsing is the work here
    rows = lines.selectExpr("concat(l_orderkey, '_', l_linenumber, '.py') AS path", f"""concat('def f(', {_lines("l_linenumber + 3", "concat('p', i)", ", ")}, '):\\n    pass\\n') AS source""")
    key = F.split(F.regexp_replace("file", r"\.py$", ""), "_")
    return DETECTORS["config_explosion"](facts_for(rows, ["config_explosion"])).select(key[0].cast("long").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), F.col("measure").cast("int").alias("n_params"))


QUERIES["config_explosion"] = _config_explosion
SQL["config_explosion"] = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber + 3 AS INTEGER) AS n_params FROM lineitem WHERE l_linenumber + 3 >= 7"

_of_parts("vague_name", "concat(element_at(array('data', 'weight', 'total_v2', 'real_total', 'User', 'q', 'x', 'item3', 'data2_raw', 'data_1', 'DATA7', 'my_data2', 'database'), int(p_partkey % 13 + 1)), ' = 1\\n')",
          "SELECT p_partkey, CAST(1 AS INTEGER) AS line FROM part WHERE p_partkey % 13 IN (0, 2, 3, 5, 7, 8, 10, 11)", measure=False)
_of_parts("hard_to_describe", f"""concat('def build():\\n', IF(p_partkey % 3 = 0, '    "A sentence of some length."\\n', ''), {_lines("p_size % 8 + 1", "concat('    a', i, ' = ', i)")}, '\\n')""",
          "SELECT p_partkey, CAST(1 AS INTEGER) AS line FROM part WHERE p_partkey % 3 <> 0 AND p_size % 8 + 1 > 3", measure=False)
_of_parts("shallow_class", f"""concat(element_at(array('', '@attr.s\\n', '@dataclasses.dataclass\\n', '@attr.define(frozen=True)\\n'), int(p_partkey % 4 + 1)), 'class A:\\n', {_lines("2 + p_partkey % 3", f"concat('    def m', i, '(self):\\n', {_lines('1 + p_size % 7', "concat('        a', i, ' = 1')")})")}, '\\n')""".replace("transform(IF((1 + p_size % 7) > 0, sequence(1, int(1 + p_size % 7)), array()), i -> concat('        a', i, ' = 1'))", "transform(sequence(1, int(1 + p_size % 7)), k -> concat('        a', k, ' = 1'))"),
          "SELECT p_partkey, CAST(1 + p_partkey % 2 AS INTEGER) AS line, CAST(1 + p_size % 7 AS DOUBLE) AS measure FROM part WHERE p_partkey % 4 < 2 AND 1 + p_size % 7 < 4")
_of_parts("wide_interface", f"""concat('class A:\\n    b = 1\\n', {_lines("p_size % 20", "concat('    def m', i, '(self):\\n        return ', i)")}, '\\n')""",
          "SELECT p_partkey, CAST(1 AS INTEGER) AS line, CAST(p_size % 20 AS DOUBLE) AS measure FROM part WHERE p_size % 20 >= 12")
_of_parts("comment_repeats_code", f"""concat('# ', {_lines("4", "concat('word', i)", " ")}, '\\n', {_lines("p_size % 5", "concat('word', i)", " + ")}, IF(p_size % 5 between 1 and 3, ' + ', ''), {_lines("4 - p_size % 5", "concat('other', i)", " + ")}, '\\n')""",
          "SELECT p_partkey, CAST(1 AS INTEGER) AS line, round((p_size % 5) / CAST(8 - p_size % 5 AS DOUBLE), 6) AS measure FROM part WHERE (p_size % 5) / CAST(8 - p_size % 5 AS DOUBLE) >= 0.6")
_of_parts("pass_through_method", f"""concat('class A:\\n    def m(self', {_lines("p_size % 4", "concat(', p', i)", "")}, '):\\n        return self.b.m(', {_lines("p_size % 4", "concat('p', IF(p_partkey % 2 = 0, i, p_size % 4 + 1 - i))", ", ")}, ')\\n',
                                         IF(p_partkey % 3 = 0, '    def n(self, *a):\\n        return self.b.n(*a)\\n    def o(self, *rest):\\n        ...\\n        return self.b.o(*args)\\n', ''))""",
          """SELECT p_partkey, CAST(2 AS INTEGER) AS line FROM part WHERE p_size % 4 > 0 AND (p_partkey % 2 = 0 OR p_size % 4 = 1)
          UNION ALL SELECT p_partkey, CAST(6 AS INTEGER) FROM part WHERE p_partkey % 3 = 0""", measure=False)  # fmt: skip
_of_parts("conjoined_methods", f"""concat('class A:\\n    def one(self):\\n        return self._help()\\n    def two(self):\\n        return ', IF(p_partkey % 2 = 0, '1', 'self._help()'), '\\n    def _help(self):\\n', IF(p_partkey % 3 = 0, '        ...\\n', ''), {_lines("1 + p_size % 6", "concat('        a', i, ' = 1')")}, '\\n',
                                       IF(p_partkey % 10 = 0, '    def _help(self):\\n        a = 1\\n        b = 2\\n        c = 3\\n', ''))""",
          """SELECT p_partkey, CAST(IF(p_partkey % 10 = 0, 8 + IF(p_partkey % 3 = 0, 1, 0) + p_size % 6, 6) AS INTEGER) AS line, CAST(IF(p_partkey % 10 = 0, 3, 1 + p_size % 6) AS DOUBLE) AS measure
          FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 10 = 0 OR 1 + p_size % 6 >= 3)""")  # fmt: skip
_of_parts("special_general_mixture", f"""concat(element_at(array('', '@singledispatch\\n', '@functools.singledispatch\\n', '@functools.wraps(x)\\n'), int(p_partkey % 4 + 1)), 'def ', IF(p_partkey % 3 = 0, 'render', 'apply'), '(v):\\n    a = 0\\n', {_lines("p_size % 5", "concat('    a += isinstance(v, int)')")}, '\\n')""",
          "SELECT p_partkey, CAST(IF(p_partkey % 4 = 3, 2, 1) AS INTEGER) AS line, CAST(p_size % 5 AS DOUBLE) AS measure FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 IN (0, 3) AND p_size % 5 >= 2")
_of_parts("repurposed_variable", "concat('def f():\\n    a = []\\n    a = None\\n    a = ', element_at(array('list()', '{}', '1', 'g()'), int(p_partkey % 4 + 1)), '\\n')",
          "SELECT p_partkey, CAST(2 AS INTEGER) AS line FROM part WHERE p_partkey % 4 IN (1, 2)", measure=False)
_of_parts("impl_leaks_into_interface", """concat('def f(a):\\n    "', element_at(array('Adds one.', 'Internally a tree.', 'Reads self._cache of it.', 'Is implemented as a loop.', 'Concurrently run.'), int(p_partkey % 5 + 1)), '"\\n')""",
          "SELECT p_partkey, CAST(1 AS INTEGER) AS line FROM part WHERE p_partkey % 5 IN (1, 2, 3)", measure=False)
_of_parts("forwarded_parameter", f"""concat('def f(', {_lines("p_size % 5", "concat('p', i)", ", ")}, '):\\n', {_lines("p_size % 5", "concat('    a = p', i, ' + p', i)")}, '\\n    return g(', IF(p_size % 5 > 0 AND p_partkey % 2 = 0, 'p1', '0'), ')\\ndef h(a, b, c):\\n    d = b + c\\n    return g(a', IF(p_partkey % 3 = 0, ' + 1', ''), ', d)\\n')""",
          "SELECT p_partkey, CAST(p_size % 5 + IF(p_size % 5 = 0, 4, 3) AS INTEGER) AS line FROM part WHERE p_partkey % 3 <> 0", measure=False)
_of_parts("required_call_ordering", "concat(element_at(array('', '@dataclass(frozen=True)\\n', '@dataclass\\n'), int(p_size % 3 + 1)), 'class A:\\n    def start_x(self): pass\\n    def ', element_at(array('stop_x', 'stop_y', 'stop'), int(p_partkey % 3 + 1)), '(self): pass\\n', IF(p_partkey % 2 = 0, '    def __enter__(self): pass\\n    def __exit__(self): pass\\n', ''))",
          "SELECT p_partkey, CAST(IF(p_size % 3 = 0, 1, 2) AS INTEGER) AS line FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1 AND p_size % 3 <> 2", measure=False)
_of_parts("duplicate_code", f"""concat('def f(x):\\n', {_lines("1 + p_size % 6", "concat('    a', i, ' = x + ', i)")}, '\\ndef g(y):\\n', {_lines("1 + p_size % 6", "concat('    b', i, ' = y ', IF(p_partkey % 2 = 0, '+', '*'), ' ', 2 * i)")}, '\\n')""",
          "SELECT p_partkey, CAST(1 AS INTEGER) AS line, CAST(2 AS DOUBLE) AS measure FROM part WHERE p_partkey % 2 = 0 AND 1 + p_size % 6 >= 4")
_of_parts("cyclomatic_complexity", f"""concat('def f(x):\\n    y = 0\\n', {_lines("p_size % 30", "concat('    if x > ', i, ':\\n        y = 1')")}, '\\n')""",
          "SELECT p_partkey, CAST(1 AS INTEGER) AS line, CAST(1 + p_size % 30 AS DOUBLE) AS measure FROM part WHERE 1 + p_size % 30 >= 10")
_of_parts("pass_through_variable", f"""concat({_lines("p_size % 5", "concat('def f', i, '(a):\\n    return f', i + 1, '(a)')")}, '\\ndef f', p_size % 5 + 1, '(a):\\n    return a + 1\\n')""",
          "SELECT p_partkey, CAST(2 * j - 1 + IF(p_size % 5 = 0, 1, 0) AS INTEGER) AS line, CAST(p_size % 5 + 1 - j AS DOUBLE) AS measure FROM part, range(1, 6) AS r(j) WHERE j <= p_size % 5 AND p_size % 5 + 1 - j BETWEEN 2 AND 3")
_of_parts("forbidden_import", "concat('import os\\nfrom ', element_at(array('sqlite3', 'json', 'sqlite3.dbapi2', 'sqlite34'), int(p_partkey % 4 + 1)), ' import x\\n')",
          "SELECT p_partkey, CAST(2 AS INTEGER) AS line FROM part WHERE p_partkey % 4 IN (0, 2)", measure=False, rules={"pkg/*": ["sqlite3"]})


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


@_query("overexposure", """
WITH p AS (SELECT p_partkey, p_brand || '/' || p_size % 2 AS module, p_size % 2 AS odd FROM part),
s AS (SELECT module FROM p GROUP BY module HAVING count(DISTINCT p_partkey) >= 10),
i AS (SELECT module, CASE odd WHEN 0 THEN 'o' || l_orderkey ELSE 's' || l_suppkey END AS importer, count(DISTINCT l_partkey) AS k FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY ALL)
SELECT module, round(avg(k), 6) AS measure FROM i JOIN s USING (module) GROUP BY module HAVING count(*) >= 3 AND avg(k) <= 2""")  # fmt: skip
def _overexposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("p_size") % 2
    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", odd).alias("module"), odd.alias("odd"))
    lines = _table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.lit("s"), F.col("p_partkey"))
    importer = F.when(F.col("odd") == 0, F.concat(F.lit("o"), "l_orderkey")).otherwise(F.concat(F.lit("s"), "l_suppkey"))
    files = part.groupBy("module").agg(F.collect_list(name).alias("top_names")).withColumn("path", F.col("module"))
    imports = lines.select(importer.alias("path"), F.col("module").alias("x_module"), name.alias("name"), F.lit(True).alias("is_from"))
    return DETECTORS["overexposure"](Facts(files=files, imports=imports)).select(F.col("file").alias("module"), F.round("measure", 6).alias("measure"))


@_query("temporal_decomposition", """
SELECT CAST(p_size AS VARCHAR) AS dir, CAST(count(*) AS DOUBLE) AS measure FROM part WHERE p_partkey % 4 < 2 GROUP BY p_size HAVING count(*) >= 3""")  # fmt: skip
def _temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("RowReader", "RowWriter", "Row", "Readers"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    classes = _table(spark, sf_dir, "part").select(F.concat_ws("/", "p_size", F.concat("p_partkey", F.lit(".py"))).alias("path"), name.alias("name"), F.lit(0).alias("place"), F.lit(1).alias("line"))
    return DETECTORS["temporal_decomposition"](Facts(classes=classes)).select(F.split("file", "/")[0].alias("dir"), "measure")


@_query("info_leakage", """
WITH r AS (SELECT l_partkey, CASE l_partkey % 3 WHEN 0 THEN l_suppkey % 3 ELSE l_suppkey END AS reader, CASE l_partkey % 2 WHEN 0 THEN l_linenumber ELSE l_linenumber % 2 END AS attr FROM lineitem)
SELECT l_partkey, CAST(count(DISTINCT attr) AS DOUBLE) AS measure FROM r WHERE reader <> l_partkey % 100 GROUP BY l_partkey
HAVING count(DISTINCT reader) >= 4 AND count(DISTINCT attr) >= 3""")  # fmt: skip
def _info_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey") % 3).otherwise(F.col("l_suppkey"))
    attr = F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") % 2)
    rows = _table(spark, sf_dir, "lineitem").select(reader.cast("string").alias("path"), F.col("l_partkey").cast("string").alias("name"), F.concat(F.lit("a"), attr).alias("attr"))
    classes = rows.select("name").distinct().select("name", (F.col("name").cast("long") % 100).cast("string").alias("path"), F.lit(0).alias("place"), F.lit(1).alias("line"))
    types = dealt(rows.select("path", F.concat(F.lit("v"), "name").alias("v"), F.col("name").alias("type")), tasks_of(rows), "path", "v").distinct().select("path", F.col("v").alias("name"), "type")
    attrs = rows.select("path", F.concat(F.lit("v"), "name").alias("receiver"), "attr", F.lit(1).alias("line"))
    found = DETECTORS["info_leakage"](Facts(classes=classes.withColumn("line", F.col("name").cast("int")), local_types=types, attrs=attrs))
    return found.select(F.col("line").cast("long").alias("l_partkey"), "measure")


#: Each order calls two others of its dozen.
_GRAPH = """SELECT DISTINCT o_orderkey AS src, o_orderkey - o_orderkey % 12 + k AS dst
FROM (SELECT o_orderkey, unnest([o_custkey % 12, (o_orderkey * 7 + o_custkey) % 12]) AS k FROM orders) WHERE o_orderkey % 12 <> k"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    targets = F.explode(F.array(other % 12, (key * 7 + other) % 12))
    return _table(spark, sf_dir, "orders").select(key.alias("src"), targets.alias("k")).select("src", (F.col("src") - F.col("src") % 12 + F.col("k")).alias("dst")).where("src <> dst").distinct()


@_query("import_cycle", f"""
WITH RECURSIVE e AS ({_GRAPH}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r AS a JOIN r AS b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT component, CAST(count(*) AS DOUBLE) AS measure FROM m GROUP BY component""")  # fmt: skip
def _import_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _edges(spark, sf_dir).select(F.format_string("%012d", "src").alias("path"), F.format_string("%012d", "dst").alias("target"))
    return DETECTORS["import_cycle"](Facts(import_targets=targets)).select(F.col("file").cast("long").alias("component"), "measure")


@_query("reachable", f"WITH RECURSIVE e AS ({_GRAPH}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def _reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir))


@_query("boundary_violation", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey % 3 = 0 AND l_suppkey % 3 = 1) OR (l_partkey % 3 = 1 AND l_suppkey % 3 = 0 AND false) OR (l_partkey % 3 = 2 AND l_suppkey % 3 <> 2)""")  # fmt: skip
def _boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = lambda c: F.element_at(F.array(*map(F.lit, ("domain", "infra", "ui"))), (F.col(c) % 3 + 1).cast("int"))
    lines = _table(spark, sf_dir, "lineitem")
    path = lambda c: F.concat(folder(c), F.lit("/"), F.col(c), F.lit(".py"))
    files = lines.select(path("l_partkey").alias("path")).union(lines.select(path("l_suppkey"))).distinct().withColumn("rel_path", F.col("path"))
    imports = lines.select(path("l_partkey").alias("path"), path("l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("line"))
    layers, allowed = {"domain": ["domain/*"], "infra": ["infra/*"], "ui": ["ui/*"]}, {"domain": ["ui"], "infra": ["domain", "ui"]}
    found = DETECTORS["boundary_violation"](Facts(files=files, import_targets=imports), layers=layers, allowed=allowed)
    return found.select(F.floor(F.col("line") / 10).alias("l_orderkey"), (F.col("line") % 10).cast("int").alias("l_linenumber"))


@_query("unstable_interface", """
WITH r AS (SELECT l_partkey, CASE l_partkey % 2 WHEN 0 THEN l_suppkey ELSE l_suppkey % 10 END AS importer FROM lineitem)
SELECT l_partkey, CAST(count(DISTINCT importer) AS DOUBLE) AS measure FROM r WHERE l_partkey % 5 <> 0 GROUP BY l_partkey HAVING count(DISTINCT importer) >= 10""")
def _unstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    importer = F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey")).otherwise(F.col("l_suppkey") % 10)
    imports = _table(spark, sf_dir, "lineitem").select(importer.cast("string").alias("path"), F.col("l_partkey").cast("string").alias("name"))
    bases = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("Protocol"))).otherwise(F.array(F.lit("Base")))
    classes = _table(spark, sf_dir, "part").select(F.lit("c.py").alias("path"), F.col("p_partkey").cast("string").alias("name"), bases.alias("generic_bases"), F.col("p_partkey").cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"))
    return DETECTORS["unstable_interface"](Facts(imports=imports, classes=classes)).select(F.col("line").cast("long").alias("l_partkey"), "measure")


_EFFECTS = f"""
WITH RECURSIVE e AS ({_GRAPH}), d AS (SELECT o_orderkey AS node, 'e' || o_custkey % 40 AS effect FROM orders WHERE o_custkey % 40 < 5),
r(node, effect) AS (SELECT node, effect FROM d UNION SELECT e.src, r.effect FROM r JOIN e ON e.dst = r.node)"""


def _effect_facts(spark: SparkSession, sf_dir: str) -> tuple[Facts, DataFrame]:
    name = lambda c: F.format_string("m.compute_%012d", c)
    edges = _edges(spark, sf_dir).select(name("src").alias("caller"), name("dst").alias("callee"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 40).alias("k"))
    calls = rows.select(name("node").alias("caller"), F.concat(F.when(F.col("node") % 2 == 0, "x.").otherwise(""), F.lit("lib.f"), "k").alias("symbol"))
    # of the forty functions that are called, five have a known effect
    effects = spark.range(5).select(F.concat(F.lit("lib.f"), "id").alias("symbol"), F.concat(F.lit("e"), "id").alias("category"))
    nodes = edges.select(F.col("caller").alias("q")).union(edges.select("callee")).union(calls.select("caller")).distinct()
    number = F.expr("int(substring(q, -12))")
    functions = nodes.select(F.lit("m.py").alias("path"), F.lit("m").alias("module"), number.alias("place"), number.alias("line"), number.alias("end_line"), F.when(number % 3 == 0, "run").otherwise("compute_x").alias("name"), F.expr("substring(q, 3)").alias("owner"))
    return Facts(call_edges=edges, external_calls=calls, functions=functions), effects


@_query("function_effects", f"{_EFFECTS} SELECT node, effect FROM r")
def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_effects(*_effect_facts(spark, sf_dir)).select(F.expr("bigint(substring(qualname, -12))").alias("node"), "effect")


@_query("function_effects_chain", """
WITH top AS (SELECT 'e' || o_custkey % 40 AS effect, max(o_orderkey) AS last FROM orders WHERE o_custkey % 40 < 5 GROUP BY 1)
SELECT o_orderkey AS node, effect FROM orders JOIN top ON o_orderkey <= last""")  # fmt: skip
def _effects_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain of calls through all orders, in the order of their keys."""
    facts, effects = _effect_facts(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    name = lambda c: F.format_string("m.compute_%012d", c)
    last = F.broadcast(orders.agg(F.max("o_orderkey").alias("last")))
    chain = orders.join(last, F.col("o_orderkey") < F.col("last")).select(name("o_orderkey").alias("caller"), name(F.col("o_orderkey") + 1).alias("callee"))
    found = function_effects(Facts(call_edges=chain, external_calls=facts.external_calls), effects)
    return found.select(F.expr("bigint(substring(qualname, -12))").alias("node"), "effect")


@_query("pure_function_violation", f"{_EFFECTS} SELECT node, CAST(count(*) AS DOUBLE) AS measure FROM r WHERE node % 3 <> 0 GROUP BY node")
def _pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, effects = _effect_facts(spark, sf_dir)
    return DETECTORS["pure_function_violation"](facts, effects=effects).select(F.col("line").cast("long").alias("node"), "measure")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of line items."""
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_suppkey")).alias("file"), F.col("l_partkey").cast("int").alias("line"), (F.col("l_partkey") + F.col("l_linenumber")).cast("int").alias("end_line"),
        F.concat(F.lit("d"), F.col("l_linenumber")).alias("detector"), F.col("l_orderkey").cast("string").alias("evidence"), "l_orderkey", "l_linenumber",
    )


@_query("suppressed", """
WITH f AS (SELECT *, 'f' || l_suppkey AS file FROM lineitem),
k AS (SELECT 'f' || p_size AS file, p_partkey AS line, p_partkey % 4 AS kind FROM part)
SELECT l_orderkey, l_linenumber FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = f.file AND (kind = 3 AND line % 50 = 3 OR NOT (kind = 3 AND line % 50 = 3) AND line BETWEEN l_partkey AND l_partkey + l_linenumber AND (kind = 0 OR kind = 1 AND l_linenumber = 1)))
AND NOT (l_orderkey % 10 = 0 AND l_linenumber = 2)""")  # fmt: skip
def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    text = F.when((kind == 3) & (F.col("p_partkey") % 50 == 3), "# codeloom: ignore-file").when(kind == 0, "# codeloom: ignore").when(kind == 1, "# codeloom: ignore[d1, d9]").otherwise("# plain")
    comments = _table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_size").alias("path"), F.col("p_partkey").cast("int").alias("line"), text.alias("text"))
    findings = _findings(spark, sf_dir)
    baseline = baseline_of(findings.where("l_orderkey % 10 = 0 and l_linenumber = 2"), F.col("file"))
    return unsuppressed(findings, inline_ignores(comments), baseline).select("l_orderkey", "l_linenumber")


@_query("evidence_hash", "SELECT l_orderkey, l_linenumber, substr(sha256('d' || l_linenumber || chr(0) || l_orderkey), 1, 12) AS hash FROM lineitem")
def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("l_orderkey", "l_linenumber", evidence_hash().alias("hash"))


@_query("summary", "SELECT 'd' || l_linenumber AS detector, count(*) AS total, CAST(0 AS BIGINT) AS real, CAST(0 AS BIGINT) AS borderline, count(*) AS unjudged FROM lineitem GROUP BY ALL")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(with_verdicts(_findings(spark, sf_dir)))


def _verdict(row: dict) -> dict:
    """A judge without a model: by line, and for some none at all."""
    return {"judge_verdict": ("real", "borderline", "false_positive", "no such verdict")[row["line"] % 4]}


@_query("summary_judged", """
SELECT 'd' || l_linenumber AS detector, count(*) AS total, CAST(count(*) FILTER (l_partkey % 4 = 0) AS BIGINT) AS real, CAST(count(*) FILTER (l_partkey % 4 = 1) AS BIGINT) AS borderline,
       CAST(count(*) FILTER (l_partkey % 4 = 3) AS BIGINT) AS unjudged FROM lineitem GROUP BY ALL""")  # fmt: skip
def _summary_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(with_verdicts(_findings(spark, sf_dir), _verdict))


def _answers(batches):
    for batch in batches:
        found = [tolerant_json(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["o_orderkey"], pa.array([f and f.get("a") for f in found], pa.int64())], ["o_orderkey", "a"])


@_query("tolerant_json", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey ELSE -1 END AS a FROM orders")
def _tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four forms: JSON, JSON in prose, in a fence, cut short."""
    form, body = F.col("o_orderkey") % 4, F.concat(F.lit('{"a": '), "o_custkey")
    text = F.when(form == 0, F.concat(body, F.lit("}"))).when(form == 1, F.concat(F.lit("So: "), body, F.lit("}. Done."))).when(form == 2, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).otherwise(body)
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).mapInArrow(_answers, "o_orderkey long, a long").fillna(-1, ["a"])


@_query("excerpt", """
SELECT p_partkey, array_to_string(list_transform(range(greatest(p_size % 9 - 1, 1), least(p_size % 9 + p_partkey % 3 + 2, 10)), lambda i: rtrim(
    format('{} {:4d}  x{} = {}', CASE WHEN i BETWEEN p_size % 9 AND p_size % 9 + p_partkey % 3 THEN '>>' ELSE '  ' END, i, i, p_partkey))), chr(10)) AS shown FROM part WHERE p_size % 9 > 0""")  # fmt: skip
def _excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one to three lines in files of nine."""
    part = _table(spark, sf_dir, "part").where("p_size % 9 > 0")
    rows = part.selectExpr("p_partkey", "transform(sequence(1, 9), i -> concat('x', i, ' = ', p_partkey)) AS lines", "int(p_size % 9) AS line", "int(p_size % 9 + p_partkey % 3) AS end_line")
    return rows.select("p_partkey", excerpt("lines", "line", "end_line", 1).alias("shown"))


@_query("return_types", """
SELECT 'f' || l_partkey % 50 || '_' || l_linenumber AS name, min('C' || l_suppkey % (1 + l_partkey % 50 % 3)) AS type FROM lineitem WHERE l_orderkey % 5 > 0
GROUP BY 1 HAVING count(DISTINCT 'C' || l_suppkey % (1 + l_partkey % 50 % 3)) = 1""")  # fmt: skip
def _return_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey") % 50
    returns = F.when(F.col("l_orderkey") % 5 > 0, F.concat(F.lit("C"), F.col("l_suppkey") % (1 + key % 3)))
    functions = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), key, F.lit("_"), "l_linenumber").alias("name"), returns.alias("returns"))
    return Facts(functions=functions).return_types


@_query("module_of", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a.b' || p_size WHEN 1 THEN 'a.b' || p_size ELSE 'b' || p_size END AS module FROM part")
def _module(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('a/b', p_size, '.py') WHEN 1 THEN concat('a/b', p_size, '/__init__.py') ELSE concat('src/b', p_size, '.py') END")
    return _table(spark, sf_dir, "part").select("p_partkey", module_of(path).alias("module"))


#: One code base made of all parts: a file for each with a class that reads like a step of a pipeline in every other
#: one, and, for odd ones, many public names; p_size % 13 files that use it, the first of which it imports in turn in
#: every third; and functions of every shape of call that can have effects.
_PROJECT = f"""
SELECT concat('src/d', p_size, '/c', p_partkey, '.py') AS path, concat(
    IF(p_partkey % 3 = 0 AND p_size % 13 > 0, concat('import d', p_size, '.u', p_partkey, '_1\\n'), ''),
    'class C', p_partkey, IF(p_partkey % 2 = 0, 'Reader', ''), IF(p_partkey % 5 = 0, '(Protocol[T])', '(Base)'), ':\\n    def go(self):\\n        return 1\\n',
    IF(p_partkey % 2 = 1, {_lines("12", "concat('def f', i, '(a):\\n    return a')")}, ''), '\\n') AS source FROM part
UNION ALL SELECT concat('src/d', p_size, '/u', p_partkey, '_', j, '.py'), concat(
    'from d', p_size, '.c', p_partkey, ' import C', p_partkey, IF(p_partkey % 2 = 0, 'Reader', ''), '\\n',
    'def use(v: C', p_partkey, IF(p_partkey % 2 = 0, 'Reader', ''), '):\\n    return v.a', j % 4, ' + v._b\\n')
FROM (SELECT *, explode(sequence(1, int(p_size % 13))) AS j FROM part WHERE p_size % 13 > 0)
UNION ALL SELECT concat('effects/e', p_partkey, '.py'), element_at(array(
    'def compute_a(p):\\n    return open(p)\\n',
    'import subprocess as s\\ndef compute_a(p):\\n    return s.run(p)\\n',
    'from os import remove as gone\\ndef compute_a(p):\\n    return low(p)\\ndef low(p):\\n    gone(p)\\n',
    'class K:\\n    def compute_a(self, p):\\n        return self.api.messages.create(p)\\n',
    'def open(p):\\n    return p\\ndef compute_a(p):\\n    return open(p)\\n',
    'from pathlib import Path\\ndef compute_a(p):\\n    return Path.unlink(p)\\n',
    'import os.path\\nimport time\\ndef compute_a(p):\\n    time.sleep(1)\\n    print(len(p))\\n    return os.path.exists(p)\\n',
    'from effects.e1 import missing\\ndef compute_a(p):\\n    return missing(p)\\n',
    'import effects.e1 as m\\ndef compute_a(p):\\n    return m.run(p)\\n'), int(p_partkey % 9 + 1)) FROM part"""


def _project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 3)
    return spark.sql(_PROJECT.replace("FROM part", "FROM {part}"), part=part)


def _project(spark: SparkSession, sf_dir: str, names: list[str]) -> Facts:
    return facts_for(_project_files(spark, sf_dir), names, keep=True)


def _of_project(name: str, sql: str, number: str = r"/c(\d+)", measure: bool = True, **params) -> None:
    """A query that runs a detector on the code base; its result has the parts' keys, lines and measures."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = DETECTORS[name](_project(spark, sf_dir, [name]), **{k: v(spark) if callable(v) else v for k, v in params.items()})
        key = F.regexp_extract("file", number, 1).cast("long").alias("p_partkey")
        return found.select(key, "line", *([F.round("measure", 6).alias("measure")] if measure else []))

    QUERIES[f"{name}_of_source"], SQL[f"{name}_of_source"] = run, sql


_LINE = "CAST(IF(p_partkey % 3 = 0 AND p_size % 13 > 0, 2, 1) AS INTEGER) AS line"
_of_project("overexposure", "SELECT p_partkey, CAST(1 AS INTEGER) AS line, CAST(1 AS DOUBLE) AS measure FROM part WHERE p_partkey % 2 = 1 AND p_size % 13 >= 3")
_of_project("info_leakage", f"SELECT p_partkey, {_LINE}, CAST(4 AS DOUBLE) AS measure FROM part WHERE p_size % 13 >= 4")
_of_project("unstable_interface", f"SELECT p_partkey, {_LINE}, CAST(p_size % 13 AS DOUBLE) AS measure FROM part WHERE p_size % 13 >= 10")
_of_project("import_cycle", "SELECT p_partkey, CAST(1 AS INTEGER) AS line, CAST(2 AS DOUBLE) AS measure FROM part WHERE p_partkey % 3 = 0 AND p_size % 13 > 0")
_of_project("temporal_decomposition", """
SELECT CAST(p_size AS BIGINT) AS p_partkey, arg_min(CASE WHEN p_partkey % 3 = 0 AND p_size % 13 > 0 THEN 2 ELSE 1 END, 'c' || p_partkey || '.py') AS line, CAST(count(*) AS DOUBLE) AS measure
FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size HAVING count(*) >= 3""", number=r"/d(\d+)")  # fmt: skip
_of_project("boundary_violation", "SELECT p_partkey, CAST(1 AS INTEGER) AS line FROM part, range(1, 13) AS r(j) WHERE j <= p_size % 13", number=r"/u(\d+)_", measure=False, layers={"base": ["src/d*/c*.py"], "use": ["src/d*/u*.py"]}, allowed={"base": ["use"]})
_of_project("unstable_interface", """
SELECT p_partkey, CAST(IF(p_partkey % 3 = 0, 2, 1) AS INTEGER) AS line, CAST(p_size % 13 AS DOUBLE) AS measure FROM part WHERE p_size % 13 >= 10 AND p_partkey % 5 <> 0""")
_of_project("pure_function_violation", """
SELECT p_partkey, CAST([1, 2, 2, 2, NULL, 2, 3, NULL, NULL][p_partkey % 9 + 1] AS INTEGER) AS line, CAST(IF(p_partkey % 9 = 6, 3, 1) AS DOUBLE) AS measure
FROM part WHERE p_partkey % 9 NOT IN (4, 7, 8)""", number=r"/e(\d+)", effects=own_effects)  # fmt: skip


@_query("class_attributes_of_source", """
SELECT 'd' || p_size || '.c' || p_partkey || '.C' || p_partkey || IF(p_partkey % 2 = 0, 'Reader', '') AS qualname, CAST(IF(p_partkey % 3 = 0 AND p_size % 13 > 0, 2, 1) AS INTEGER) AS line FROM part
UNION ALL SELECT 'effects.e' || p_partkey || '.K', 1 FROM part WHERE p_partkey % 9 = 3""")  # fmt: skip
def _class_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_for(_project_files(spark, sf_dir), [], more="classes(name,line,attributes)").class_attributes.where(F.size("attributes") == 0).select("qualname", "line")


@_query("effect_sets_of_source", """
WITH k AS (SELECT p_partkey, p_partkey % 9 AS k FROM part)
SELECT 'effects.e' || p_partkey || IF(k = 3, '.K', '') || '.compute_a' AS qualname,
       ['filesystem', 'subprocess', 'filesystem', 'network', '', 'filesystem', 'filesystem,stdout,time', '', ''][k + 1] AS effects FROM k
UNION ALL SELECT 'effects.e' || p_partkey || IF(k = 2, '.low', '.open'), IF(k = 2, 'filesystem', '') FROM k WHERE k IN (2, 4)
UNION ALL SELECT 'd' || p_size || '.c' || p_partkey || '.C' || p_partkey || IF(p_partkey % 2 = 0, 'Reader', '') || '.go', '' FROM part
UNION ALL SELECT 'd' || p_size || '.c' || p_partkey || '.f' || j, '' FROM part, range(1, 13) AS r(j) WHERE p_partkey % 2 = 1
UNION ALL SELECT 'd' || p_size || '.u' || p_partkey || '_' || j || '.use', '' FROM part, range(1, 13) AS r(j) WHERE j <= p_size % 13""")  # fmt: skip
def _effect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effect_sets(_project(spark, sf_dir, ["pure_function_violation"]), own_effects(spark))
    return found.select("qualname", F.array_join("effects", ",").alias("effects"))


@_query("import_cycle_ring", "SELECT min(o_orderkey) AS component, CAST(count(*) AS DOUBLE) AS measure FROM orders")
def _import_cycle_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one ring, in the order of their keys, with a long chain that leads into it."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.agg(F.max("o_orderkey")).first()[0] or 0
    path = lambda c: F.format_string("%012d", c)
    ring = orders.select(path("o_orderkey").alias("path"), path((F.col("o_orderkey") + 1) % (n + 1)).alias("target"))
    chain = orders.where("o_orderkey % 100 = 0").select(path(F.col("o_orderkey") + 2 * n).alias("path"), path(F.when(F.col("o_orderkey") == 0, 0).otherwise(F.col("o_orderkey") + 2 * n - 100)).alias("target"))
    return DETECTORS["import_cycle"](Facts(import_targets=ring.union(chain))).select(F.col("file").cast("long").alias("component"), "measure")
