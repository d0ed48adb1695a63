"""The detectors: each a function from facts to findings.

A finding has file, line, end_line, detector, title, evidence, rubric_ref, rubric_title, severity, and measure, the
number that its rule compares (null if there is none).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.facts import Facts, extracted, merged, qualified
from ..scratch import written
from . import graph

FINDINGS = "file string, line int, end_line int, detector string, title string, evidence string, rubric_ref string, rubric_title string, severity string, measure double"
COLUMNS = [c.split()[0] for c in FINDINGS.split(", ")]

# The rubric's sections, and the words, suffixes, pairs and limits that the rules are made of.
RUBRIC = {"5": "Deep vs. shallow modules", "6": "Information hiding and leakage", "8": "Pull complexity downwards", "9": "Configuration parameters", "10": "Better together or better apart", "12": "Comments", "13": "Choosing names", "17": "Consistency and obviousness"}
GENERIC_NAMES = ("data", "info", "result", "manager", "handler", "util", "utils", "obj", "object", "item", "thing", "stuff", "tmp", "temp", "helper", "foo", "bar", "baz", "qux", "value_obj", "the_data", "my_data")
VERSION_SUFFIX, VERSION_PREFIX, HELPER_SUFFIX, CAMEL_SUFFIX = r"(?i)_(v\d+|new|old|actual|actually|final|real|fixed|tmp)$", r"(?i)^(real|final|actual|new|old|tmp|fixed)_", r"(?i)_(helper|utility|utilities|helpers)$", r"(V\d+|\d+)$"
SHORT_NAMES = ("i", "j", "k", "x", "y", "z", "_")
DATA_DECORATORS, SHALLOW_BASES = ("dataclass", "dataclasses.dataclass", "frozen_dataclass", "attrs", "attr.s", "define"), ("Exception", "BaseException", "Enum", "IntEnum", "StrEnum", "TypedDict", "NamedTuple", "Protocol")
ORDER_DECORATORS, ORDER_BASES = ("dataclass", "frozen_dataclass", "attrs", "define"), ("Enum", "IntEnum", "StrEnum", "TypedDict", "NamedTuple", "Protocol")
WIDE_BASES = ("TestCase", "BaseTestCase", "TeamsActivityHandler", "ActivityHandler")
STOPWORDS = ("the", "a", "an", "is", "are", "this", "that", "of", "for", "to", "in", "and", "or", "not", "if", "else", "with", "from", "as", "by", "on", "self", "cls", "true", "false", "none")
DISPATCH_PREFIXES = ("dispatch", "handle", "route", "parse", "serialize", "deserialize", "render", "visit", "format", "encode", "decode", "to_", "from_", "convert", "transform_", "as_", "_dispatch", "_handle")
LEAK_PHRASES = r"(?i)\binternally\b|\bwe use\b|\bthis implementation\b|\bis implemented as\b|\bis backed by\b|\bunder the hood\b|\bcurrently\b|\bworkaround\b|\btemporarily\b|\bTODO\b|\bHACK\b|\bFIXME\b|\bXXX\b"
PRIVATE_ATTRIBUTE = r"\bself\._[a-zA-Z][a-zA-Z0-9_]*\b"
ORDER_PAIRS = (("start", "stop"), ("start", "close"), ("open", "close"), ("begin", "end"), ("begin", "finish"), ("connect", "disconnect"), ("acquire", "release"), ("init", "shutdown"), ("setup", "teardown"), ("login", "logout"))
STAGE_SUFFIXES = ("Reader", "Writer", "Parser", "Loader", "Processor", "Transformer", "Validator", "Formatter", "Encoder", "Decoder", "Importer", "Exporter", "Builder", "Compiler", "Renderer", "Serializer", "Deserializer")
PURE_PREFIXES = ("calculate_", "compute_", "parse_", "format_", "to_", "as_", "validate_", "derive_", "transform_", "convert_", "normalize_", "serialize_", "deserialize_", "summarize_")

DETECTORS: dict[str, Callable[..., DataFrame]] = {}
PROJECT: set[str] = set()
#: Detectors of single files that make several relations of the facts, each of which parses anew unless facts are kept.
SEVERAL = {"vague_name", "hard_to_describe", "shallow_class", "conjoined_methods", "impl_leaks_into_interface"}
#: The facts that each detector reads.
NEEDS: dict[str, str] = {}
#: What the call graph and the types of variables are made of.
CALLS = "functions(name,line,owner,returns) classes(name,top,methods) vars imports top_defs calls"


def facts_for(files: DataFrame, names: list[str], root: str = "", more: str = "", keep: bool = False) -> Facts:
    """The facts of files (path, source) that these detectors read, and more. keep: they are written as a table, so that
    files are parsed once however many relations are made of them, each of which reads its own columns."""
    found = extracted(files, " ".join([*(NEEDS[n] for n in names), more]))
    return Facts(written(found, "facts") if keep else found, root)


def detector(rubric: str, severity: str, needs: str, project: bool = False):
    """Registers a rule and the facts it needs. It returns file, line and evidence; end_line, title, measure and severity
    if it has them."""

    def register(rule):
        name = rule.__name__

        def run(facts: Facts, **params) -> DataFrame:
            found = rule(facts, **params)
            has = set(found.columns)
            defaults = {"end_line": F.lit(None).cast("int"), "title": F.lit((rule.__doc__ or name).split("\n")[0].rstrip(".")), "measure": F.lit(None), "severity": F.lit(severity)}
            found = found.withColumns({k: v for k, v in defaults.items() if k not in has})
            found = found.withColumns({"detector": F.lit(name), "rubric_ref": F.lit(rubric), "rubric_title": F.lit(RUBRIC[rubric]), "measure": F.col("measure").cast("double"), "line": F.col("line").cast("int")})
            return found.select(COLUMNS)

        DETECTORS[name], NEEDS[name] = run, needs
        if project:
            PROJECT.add(name)
        return run

    return register


#: Rows that a task of a join should have.
TASK_ROWS = 1_000_000


def tasks_of(rows: DataFrame) -> int:
    """So many tasks as rows are dealt to, or 0 where a shuffle's own do."""
    n = -(-rows.count() // TASK_ROWS)
    return n if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows hashed by keys to n tasks, as what they are joined with has to be, so that a task's memory doesn't grow with the input."""
    return rows.repartition(n, *keys) if n else rows


def public(name: str = "name") -> Column:
    return ~F.col(name).startswith("_")


def dunder(name: str = "name") -> Column:
    return F.col(name).startswith("__") & F.col(name).endswith("__")


def _at(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("path", "file")


def _class_methods(facts: Facts) -> DataFrame:
    """Functions that stand directly in a class body."""
    return facts.functions.where("parent = 'class'")


@detector("13", "low", "functions(name,line,params) classes(name,line) targets")
def vague_name(facts: Facts, generic_names: tuple[str, ...] = GENERIC_NAMES) -> DataFrame:
    """Vague name."""
    f = facts.functions
    named = f.select("path", "line", "name", F.lit("function").alias("kind"))
    named = named.unionByName(f.select("path", F.explode("params").alias("p")).select("path", "p.line", "p.name", F.lit("parameter").alias("kind")))
    named = named.unionByName(facts.classes.select("path", "line", "name", F.lit("class").alias("kind"))).unionByName(facts.targets.select("path", "line", "name", F.lit("variable").alias("kind")))
    name, numbered = F.col("name"), "^(" + "|".join(map(re.escape, generic_names)) + ")[0-9]"
    camel = F.regexp_replace("name", CAMEL_SUFFIX, "")
    why = (
        F.when(F.lower("name").isin(*generic_names), "generic")
        .when(F.lower("name").rlike(numbered), "numbered")
        .when(name.rlike(VERSION_SUFFIX) | (name.rlike(CAMEL_SUFFIX) & camel.rlike("^[A-Z]") & camel.rlike("[a-z]")), "versioned")
        .when(name.rlike(VERSION_PREFIX), "prefixed")
        .when((F.col("kind") == "function") & name.rlike(HELPER_SUFFIX), "helper")
        .when((F.col("kind") != "parameter") & (F.length("name") == 1) & ~name.isin(*SHORT_NAMES), "short")
    )
    return _at(named.withColumn("evidence", F.concat_ws(" ", "kind", "name", F.lit("is"), why)).where(why.isNotNull()))


@detector("12", "low", "functions(name,line,end_line,parent,cls,doc,body_lines) classes(cls,name,line,end_line,doc)")
def hard_to_describe(facts: Facts) -> DataFrame:
    """Public definition without a description."""
    bare = F.length(F.trim(F.coalesce("doc", F.lit("")))) < 15
    classes = facts.classes.where(public())
    f = facts.functions.where(public() & bare & (F.col("body_lines") > 3))
    methods = f.where("parent = 'class'").join(classes.select("path", "cls"), ["path", "cls"], "left_semi")
    found = classes.where(bare).select("path", "line", "end_line", "name").unionByName(f.where("parent = 'module'").unionByName(methods.select(f.columns)).select("path", "line", "end_line", "name"))
    return _at(found.withColumn("evidence", F.concat("name", F.lit(" has no docstring of 15 characters"))))


@detector("9", "medium", "functions(name,line,end_line,parent,params,n_defaults)")
def config_explosion(facts: Facts, total_threshold: int = 7, optional_threshold: int = 5) -> DataFrame:
    """Too many parameters."""
    n = F.size("params")
    kind = F.when(F.col("name") == "__init__", "Constructor").when(F.col("parent") == "class", "Method").otherwise("Function")
    f = facts.functions.where((n >= total_threshold) | (F.col("n_defaults") >= optional_threshold))
    text = F.when(n >= total_threshold, F.format_string("%d parameters", n)).otherwise(F.format_string("%d optional parameters", "n_defaults"))
    return _at(f.select("path", "line", "end_line", F.concat_ws(" ", kind, "name", F.lit("has"), text).alias("evidence"), n.alias("measure")))


@detector("5", "medium", "functions(name,parent,cls,own_stmts) classes(cls,line,end_line,bases,decorators,empty)")
def shallow_class(facts: Facts, body_per_method: float = 4) -> DataFrame:
    """Shallow class."""
    free = F.exists("decorators", lambda d: d.isin(*DATA_DECORATORS)) | F.exists("bases", lambda b: b.isin(*SHALLOW_BASES))
    classes = facts.classes.where(~free)
    alias = (F.size("bases") == 1) & F.col("empty")
    per = _class_methods(facts).where(public()).groupBy("path", "cls").agg(F.count("*").alias("n"), F.avg("own_stmts").alias("measure")).where((F.col("n") >= 2) & (F.col("measure") < body_per_method))
    empty = classes.where(alias).select("path", "line", "end_line", F.concat(F.lit("empty body, adds nothing to "), F.col("bases")[0]).alias("evidence"), F.lit(None).cast("double").alias("measure"))
    thin = classes.where(~alias).join(per, ["path", "cls"]).select("path", "line", "end_line", F.concat(F.col("n"), F.lit(" public methods of few statements")).alias("evidence"), "measure")
    return _at(empty.unionByName(thin))


@detector("5", "medium", "classes(line,end_line,bases,methods)")
def wide_interface(facts: Facts, threshold: int = 12) -> DataFrame:
    """Wide interface."""
    methods = F.filter("methods", lambda m: ~m.startswith("_"))
    c = facts.classes.where(~F.exists("bases", lambda b: b.isin(*WIDE_BASES)) & (F.size(methods) >= threshold))
    return _at(c.select("path", "line", "end_line", F.array_join(methods, ", ").alias("evidence"), F.size(methods).alias("measure")))


def _words(text: str) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)")), lambda w: F.lower(w)))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


@detector("12", "low", "comments")
def comment_repeats_code(facts: Facts, threshold: float = 0.6) -> DataFrame:
    """Comment repeats the code."""
    c = facts.comments.where(~F.col("text").rlike(r"^[\s#=\-*_]+$") & F.col("next").isNotNull()).withColumn("a", _words("text")).withColumn("b", _words("next"))
    c = c.where((F.size("a") >= 2) & (F.size("b") > 0)).withColumn("measure", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))
    return _at(c.where(F.col("measure") >= threshold).select("path", "line", F.col("line").alias("end_line"), F.col("text").alias("evidence"), "measure"))


@detector("8", "medium", "functions(name,line,end_line,parent,params,forward)")
def pass_through_method(facts: Facts) -> DataFrame:
    """Pass-through method."""
    # packed arguments count as forwarded by their usual names, *args and **kwargs, whatever the parameters are
    names = F.transform("params", lambda p: p["name"])
    pos = F.forall(F.transform("forward.pos", lambda a, i: F.coalesce(F.get(names, i) == a, F.lit(False)) | (a == "*args")), lambda x: x)
    kw = F.forall("forward.kw", lambda a: F.array_contains(names, a) | (a == "**kwargs"))
    some = (F.size("params") > 0) | (F.size("forward.pos") > 0) | (F.size("forward.kw") > 0)
    f = _class_methods(facts).where(F.col("forward").isNotNull() & ~dunder()).where(pos & kw & some)
    return _at(f.select("path", "line", "end_line", F.concat("name", F.lit(" only forwards its parameters")).alias("evidence")))


@detector("10", "low", "functions(name,line,end_line,parent,cls,own_stmts,self_calls)")
def conjoined_methods(facts: Facts, trivial: int = 3, fanout: int = 5) -> DataFrame:
    """Conjoined methods."""
    # of definitions of one name in a class, such as a property's, the last counts
    last = _class_methods(facts).groupBy("path", "cls", "name").agg(F.max_by(F.struct("line", "end_line", "own_stmts", "self_calls"), "place").alias("m"))
    m = last.select("path", "cls", "name", "m.*")
    uses = m.select("path", "cls", F.col("name").alias("caller"), F.explode("self_calls").alias("name")).where("caller <> name").distinct()
    single = uses.groupBy("path", "cls", "name").agg(F.count("*").alias("n"), F.min("caller").alias("caller")).where("n = 1")
    private = m.where(F.col("name").startswith("_")).drop("self_calls").join(single, ["path", "cls", "name"])
    busy = private.groupBy("path", "cls", "caller").agg(F.count("*").alias("k")).where(F.col("k") >= fanout)
    found = private.where(~dunder() & (F.col("own_stmts") >= trivial)).join(busy, ["path", "cls", "caller"], "left_anti")
    return _at(found.select("path", "line", "end_line", F.concat_ws(" ", "name", F.lit("is called by"), "caller", F.lit("only")).alias("evidence"), F.col("own_stmts").alias("measure")))


@detector("10", "low", "functions(name,line,end_line,isinstance_calls,decorators)")
def special_general_mixture(facts: Facts, threshold: int = 2) -> DataFrame:
    """Special cases in a general function."""
    dispatch = reduce(lambda a, b: a | b, [F.lower("name").startswith(p) for p in DISPATCH_PREFIXES])
    single = F.exists("decorators", lambda d: d.isin("singledispatch", "singledispatchmethod"))
    f = facts.functions.where(~dispatch & ~dunder() & ~single & (F.col("isinstance_calls") >= threshold))
    return _at(f.select("path", "line", "end_line", F.format_string("%d isinstance checks in %s", "isinstance_calls", "name").alias("evidence"), F.col("isinstance_calls").alias("measure")))


@detector("13", "low", "functions(fn,kinds)")
def repurposed_variable(facts: Facts) -> DataFrame:
    """Variable holds different kinds of values."""
    k = facts.functions.select("path", "fn", F.posexplode("kinds").alias("at", "k")).select("path", "fn", "at", "k.*")
    w = Window.partitionBy("path", "fn", "name").orderBy("at")
    k = k.withColumns({"first": F.first("kind").over(w), "start": F.first("line").over(w)}).where("kind <> first").withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return _at(k.select("path", F.col("start").alias("line"), F.col("line").alias("end_line"), F.concat_ws(" ", "name", F.lit("is"), "first", F.lit("then"), "kind").alias("evidence")))


@detector("12", "low", "functions(name,line,end_line,doc) classes(name,line,end_line,doc)")
def impl_leaks_into_interface(facts: Facts) -> DataFrame:
    """Docstring tells the implementation."""
    f = facts.functions.where(public()).select("path", "line", "end_line", "doc")
    c = facts.classes.where(public()).select("path", "line", "end_line", "doc")
    phrase, private = (F.nullif(F.regexp_extract("doc", p, 0), F.lit("")) for p in (LEAK_PHRASES, PRIVATE_ATTRIBUTE))
    return _at(c.unionByName(f).withColumn("evidence", F.concat_ws("; ", phrase, private)).where("doc is not null and evidence <> ''").drop("doc"))


@detector("8", "low", "functions(fn,name,line,end_line,params,kwargs,own_stmts,reads)")
def forwarded_parameter(facts: Facts, least: int = 3, most_stmts: int = 6) -> DataFrame:
    """Parameter is only forwarded."""
    f = facts.functions.where(~dunder() & F.col("kwargs").isNull() & (F.size("params") >= least) & (F.col("own_stmts") <= most_stmts))
    reads = f.select("path", "fn", "line", "end_line", F.explode("reads").alias("r")).groupBy("path", "fn", "line", "end_line", "r.name").agg(F.count("*").alias("n"), F.bool_and("r.as_arg").alias("arg"))
    return _at(reads.where("n = 1 and arg").select("path", "line", "end_line", F.concat("name", F.lit(" is only passed on")).alias("evidence")))


@detector("6", "low", "classes(cls,line,end_line,bases,plain_decorators,methods)")
def required_call_ordering(facts: Facts) -> DataFrame:
    """Paired methods without a context manager."""
    free = F.exists("plain_decorators", lambda d: d.isin(*ORDER_DECORATORS)) | F.exists("bases", lambda b: b.isin(*ORDER_BASES))
    managed = F.array_contains("methods", "__enter__") & F.array_contains("methods", "__exit__")
    c = facts.classes.where(~free & ~managed)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ORDER_PAIRS])
    tried = c.select("path", "cls", "line", "end_line", "methods", F.explode("methods").alias("m"), pairs.alias("pairs")).select("*", F.posexplode("pairs").alias("nth", "p"))
    suffix = F.expr("substring(m, length(p.a) + 1)")
    other = F.concat("p.b", suffix)
    tried = tried.where(F.col("m").startswith(F.col("p.a")) & ((suffix == "") | suffix.startswith("_")) & (F.col("m") != "init")).withColumn("other", other).where(F.array_contains("methods", F.col("other")))
    best = tried.groupBy("path", "cls", "line", "end_line").agg(F.min(F.struct("nth", "m", "other")).alias("x"))
    return _at(best.select("path", "line", "end_line", F.concat_ws(" / ", "x.m", "x.other").alias("evidence")))


@detector("10", "medium", "functions(name,line,end_line,body_stmts,signature)")
def duplicate_code(facts: Facts, least: int = 4) -> DataFrame:
    """Functions of the same shape."""
    f = facts.functions.where(F.col("body_stmts") >= least)
    g = f.groupBy("path", F.sha2("signature", 256).alias("s")).agg(F.count("*").alias("measure"), F.min(F.struct("line", "end_line", "name")).alias("x"), F.array_sort(F.collect_list("name")).alias("names")).where("measure >= 2")
    return _at(g.select("path", "x.line", "x.end_line", F.array_join("names", ", ").alias("evidence"), "measure"))


@detector("17", "low", "functions(name,line,end_line,complexity)")
def cyclomatic_complexity(facts: Facts, threshold_low: int = 10, threshold_medium: int = 15, threshold_high: int = 20) -> DataFrame:
    """Complex function."""
    c = F.col("complexity")
    severity = F.when(c >= threshold_high, "high").when(c >= threshold_medium, "medium").otherwise("low")
    return _at(facts.functions.where(c >= threshold_low).select("path", "line", "end_line", F.concat_ws(" ", "name", F.lit("has complexity"), "complexity").alias("evidence"), c.alias("measure"), severity.alias("severity")))


@detector("5", "low", "top_names imports", project=True)
def overexposure(facts: Facts, exposed: int = 10, used: float = 2.0, importers: int = 3) -> DataFrame:
    """Module exposes more than its callers use."""
    symbols = facts.files.where("module <> ''").select("module", "path", F.explode("top_names").alias("s")).where(public("s")).groupBy("module").agg(F.max("path").alias("path"), F.count_distinct("s").alias("n")).where(F.col("n") >= exposed)
    per = facts.imports.where("is_from").groupBy("x_module", "path").agg(F.count_distinct("name").alias("k"))
    per = per.toDF("module", "importer", "k").groupBy("module").agg(F.count("*").alias("importers"), F.avg("k").alias("measure")).where((F.col("importers") >= importers) & (F.col("measure") <= used))
    return symbols.join(per, "module").select(F.col("path").alias("file"), F.lit(1).alias("line"), F.format_string("%d symbols, %d importers", "n", "importers").alias("evidence"), "measure")


@detector("6", "medium", "classes(name,line)", project=True)
def temporal_decomposition(facts: Facts, threshold: int = 3) -> DataFrame:
    """Classes follow the steps of a pipeline."""
    c = facts.classes.where(F.col("name").rlike("(" + "|".join(STAGE_SUFFIXES) + ")$"))
    g = c.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("measure"), F.min(F.struct("path", "place", "line")).alias("x"), F.array_sort(F.collect_list("name")).alias("names")).where(F.col("measure") >= threshold)
    return g.select(F.col("x.path").alias("file"), "x.line", F.array_join("names", ", ").alias("evidence"), "measure")


@detector("6", "medium", "classes(name,line) functions(name,returns) vars attrs", project=True)
def info_leakage(facts: Facts, files: int = 4, attributes: int = 3) -> DataFrame:
    """Knowledge of a class is spread over files."""
    local = facts.local_types.select("path", F.col("name").alias("receiver"), F.col("type").alias("name"))
    attrs = facts.attrs.where(public("attr")).select("path", "receiver", "attr")
    n = tasks_of(attrs)
    used = dealt(attrs, n, "path", "receiver").join(dealt(local, n, "path", "receiver"), ["path", "receiver"]).select("name", "path", "attr")
    home = dealt(facts.classes.select("name", "path", "place", "line"), n, "name").groupBy("name").agg(F.min(F.struct("path", "place", "line")).alias("home"))
    used = dealt(used, n, "name").join(home, "name").where("path <> home.path")
    # a class's rows are in one task now, so that different files and attributes are found without another shuffle
    value = F.explode(F.array(F.struct(F.lit(True).alias("is_file"), F.col("path").alias("value")), F.struct(F.lit(False).alias("is_file"), F.col("attr").alias("value"))))
    both = used.select("name", "home", value.alias("x")).select("name", "home", "x.*").distinct()
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("name", "is_file").orderBy("value")))
    first = F.sort_array(F.collect_list(F.when(F.col("is_file") & (F.col("nth") <= 5), F.col("value"))))
    g = both.groupBy("name", "home").agg(F.count_if("is_file").alias("n"), F.count_if(~F.col("is_file")).alias("measure"), first.alias("paths")).where((F.col("n") >= files) & (F.col("measure") >= attributes))
    more = F.when(F.col("n") > 5, F.format_string("(+%d more)", F.col("n") - 5))
    return g.select(F.col("home.path").alias("file"), "home.line", F.concat_ws(" ", F.array_join("paths", ", "), more).alias("evidence"), "measure")


@detector("6", "medium", "imports", project=True)
def import_cycle(facts: Facts, shown: int = 100) -> DataFrame:
    """Modules import each other in a cycle."""
    edges = facts.import_targets.select(F.col("path").alias("src"), F.col("target").alias("dst"))
    nodes = written(graph.strong_components(edges), "cycles")
    first = nodes.withColumn("nth", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("nth") <= shown)
    named = first.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), " -> ").alias("some"))
    g = nodes.groupBy("component").agg(F.count("*").alias("measure")).join(named, "component")
    more = F.when(F.col("measure") > shown, F.format_string("(+%d more)", F.col("measure") - shown))
    return g.select(F.col("component").alias("file"), F.lit(1).alias("line"), F.concat_ws(" ", "some", more).alias("evidence"), "measure")


@detector("8", "low", f"{CALLS} functions(params,reads,kwargs)", project=True)
def pass_through_variable(facts: Facts, frames: int = 3) -> DataFrame:
    """Variable is passed through functions that don't use it."""
    return pass_through_chains(facts, frames).where("measure >= 2").select(F.col("path").alias("file"), "line", F.concat_ws(" ", "param", F.lit("passes"), F.array_join("chain", " -> ")).alias("evidence"), "measure")


def pass_through_chains(facts: Facts, frames: int = 3) -> DataFrame:
    """For each parameter that is only passed on, the first chain of calls, in call order, that ends at a reader:
    path, line, fn, param, chain, measure (its frames)."""
    f = facts.functions.where("owner is not null").withColumn("qual", qualified("module", "owner"))
    first = f.groupBy("qual").agg(F.min_by(F.struct("path", "line", "name", "params", "reads", "kwargs"), F.struct("path", "place")).alias("x"))
    params = first.select("qual", "x.path", "x.line", "x.name", "x.kwargs", "x.reads", F.posexplode("x.params").alias("pos", "p")).withColumn("param", F.col("p.name"))
    args = facts.call_sites.select("caller", "callee", "place", F.posexplode("args").alias("nth", "a")).where("a.name is not null")
    target = params.select(F.col("qual").alias("callee"), F.col("param").alias("next"), "pos")
    sent = merged(args, target, "callee").where((F.col("a.pos") == F.col("pos")) | (F.col("a.kw") == F.col("next")))
    edges = sent.select(F.col("caller").alias("fn"), F.col("a.name").alias("param"), F.col("callee").alias("to"), "next", F.struct("place", "nth").alias("ord")).distinct()
    total = params.select("qual", "param", F.size(F.filter("reads", lambda r: r["name"] == F.col("param"))).alias("n_reads"))
    passed = edges.groupBy("fn", "param").agg(F.count_distinct("ord").alias("n_passed"))
    state = merged(total, passed, (F.col("qual") == F.col("fn")) & (total["param"] == passed["param"]), "left").select(F.col("qual").alias("fn"), total["param"], (F.col("n_reads") > F.coalesce("n_passed", F.lit(0))).alias("reader"))
    start = merged(params.where(~dunder() & F.col("kwargs").isNull()).select("path", "line", F.col("qual").alias("fn"), "param"), state.where("not reader"), ["fn", "param"]).drop("reader")
    ends = state.select(F.col("fn").alias("to"), F.col("param").alias("next"), F.col("reader").alias("ends"))
    edges = written(merged(edges, ends, ["to", "next"]), "passed")
    found = _first_chains(edges) if frames == 3 else _walked(start, edges, frames)
    every = merged(start, found, ["fn", "param"])
    return every.select("path", "line", "fn", "param", F.concat(F.array("fn"), F.transform("tail", lambda s: s["fn"])).alias("chain"), F.size("tail").alias("measure"))


def _state(fn: str, param: str) -> Column:
    return F.struct(F.col(fn).alias("fn"), F.col(param).alias("param"))


def _first_chains(edges: DataFrame) -> DataFrame:
    """fn, param, tail: of chains of at most three calls that end at a reader and pass no state twice, the first in call
    order, by the best ways on from each state. A way on may lead back to where the chain began; so that it needn't, each
    state has its best way and the best that goes on to another state. No step has more rows than there are edges."""
    to, here = _state("to", "next"), _state("fn", "param")
    order, none = F.struct("ord", "to", "next"), F.lit(None).cast("struct<fn:string,param:string>")
    ending = edges.where("ends").select("fn", "param", order.alias("order"), none.alias("via"), F.array(to).alias("tail"))
    passing = edges.where(~F.col("ends") & (to != here))
    best = lambda options: options.groupBy("fn", "param").agg(F.min_by(F.struct("via", "tail"), "order").alias("way"))
    onward = lambda ways, *names: ways.select(F.col("fn").alias("to"), F.col("param").alias("next"), *names)
    last = onward(best(ending), F.col("way.tail").alias("rest"))
    two = ending.unionByName(merged(passing, last, ["to", "next"]).select("fn", "param", order.alias("order"), to.alias("via"), F.concat(F.array(to), "rest").alias("tail")))
    two = written(two, "ways")
    first = best(two)
    other = merged(two, first.where("way.via is not null"), ["fn", "param"]).where("not (via <=> way.via)").drop("way")
    ways = merged(first, best(other).withColumnRenamed("way", "other"), ["fn", "param"], "left")
    step = merged(passing, onward(ways, "way", "other"), ["to", "next"])
    taken = F.when(F.col("way.via").isNull() | (F.col("way.via") != here), F.col("way")).otherwise(F.col("other"))
    three = step.withColumn("taken", taken).where("taken is not null").select("fn", "param", order.alias("order"), to.alias("via"), F.concat(F.array(to), "taken.tail").alias("tail"))
    return best(ending.unionByName(three)).select("fn", "param", "way.tail")


def _walked(start: DataFrame, edges: DataFrame, frames: int) -> DataFrame:
    """The same for any number of calls, by walking all chains."""
    live = start.select("fn", "param", F.col("fn").alias("at"), F.col("param").alias("var"), F.array(_state("fn", "param")).alias("seen"), F.array().cast("array<struct<place:int,nth:int>>").alias("ords"))
    ends = []
    for _ in range(frames):
        step = edges.select(F.col("fn").alias("at"), F.col("param").alias("var"), "to", "next", "ord", "ends")
        moved = merged(live, step, ["at", "var"]).where(~F.array_contains("seen", _state("to", "next")))
        moved = moved.select("fn", "param", F.col("to").alias("at"), F.col("next").alias("var"), F.concat("seen", F.array(_state("to", "next"))).alias("seen"), F.concat("ords", F.array("ord")).alias("ords"), "ends")
        ends.append(moved.where("ends"))
        live = moved.where("not ends").drop("ends")
    every = reduce(DataFrame.unionByName, ends).groupBy("fn", "param").agg(F.min_by("seen", "ords").alias("seen"))
    return every.select("fn", "param", F.slice("seen", 2, frames + 1).alias("tail"))


def _glob(path: str, patterns: list[str]) -> Column:
    """The number of the first pattern that a path matches, null if none does."""
    return F.coalesce(*[F.when(F.col(path).rlike(fnmatch.translate(p)), F.lit(i)) for i, p in enumerate(patterns)], F.lit(None).cast("int"))


def _none(facts: Facts) -> DataFrame:
    return facts.imports.where("false").select(F.col("path").alias("file"), "line", F.lit("").alias("evidence"))


@detector("6", "medium", "imports", project=True)
def forbidden_import(facts: Facts, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Import that a rule forbids."""
    if not rules:
        return _none(facts)
    files = facts.files.select("path", "rel_path")
    banned = [(glob, b) for glob, names in rules.items() for b in names]
    hit = F.coalesce(*[F.when(F.col("rel_path").rlike(fnmatch.translate(g)) & ((F.col("x_module") == b) | F.col("x_module").startswith(b + ".")), F.lit(b)) for g, b in banned], F.lit(None).cast("string"))
    return facts.imports.join(files, "path").withColumn("banned", hit).where("banned is not null").select(F.col("path").alias("file"), "line", F.concat_ws(" ", F.lit("imports"), "x_module", F.lit("banned as"), "banned").alias("evidence"))


@detector("6", "medium", "imports", project=True)
def boundary_violation(facts: Facts, layers: dict[str, list[str]] | None = None, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Import across layers that isn't allowed."""
    if not layers:
        return _none(facts)
    flat = [(layer, glob) for layer, globs in layers.items() for glob in globs]
    nth = _glob("rel_path", [g for _, g in flat])
    placed = facts.files.withColumn("layer", F.get(F.array(*[F.lit(x) for x, _ in flat]), nth)).where("layer is not null").select("path", "layer")
    ok = reduce(lambda a, b: a | b, [(F.col("layer") == x) & F.col("to").isin(*ys) for x, ys in (allowed or {}).items() if ys], F.lit(False))
    i = facts.import_targets.join(placed, "path").join(placed.select(F.col("path").alias("target"), F.col("layer").alias("to")), "target")
    return i.where((F.col("layer") != F.col("to")) & ~ok).select(F.col("path").alias("file"), "line", F.concat_ws(" ", "layer", F.lit("imports"), "to").alias("evidence"))


@detector("5", "low", "imports classes(name,line,end_line,generic_bases)", project=True)
def unstable_interface(facts: Facts, threshold: int = 10) -> DataFrame:
    """Concrete class that many files import."""
    users = facts.imports.groupBy("name").agg(F.count_distinct("path").alias("measure")).where(F.col("measure") >= threshold)
    c = facts.classes.where(~F.exists("generic_bases", lambda b: (b == "Protocol") | b.endswith("ABC"))).join(users, "name")
    return _at(c.select("path", "line", "end_line", F.concat_ws(" ", "name", F.lit("is imported by"), "measure", F.lit("files")).alias("evidence"), "measure"))


#: Categories of effects that one mask holds.
MASK_BITS = 62


def _effect_masks(facts: Facts, effects: DataFrame) -> tuple[DataFrame, list[str]]:
    """node, m0, m1, ...: what each function does itself or through calls, as bits of the categories, sorted."""
    calls = facts.external_calls
    exact = calls.join(effects, "symbol").select("caller", "category")
    parts = F.split("symbol", r"\.")
    rest = calls.join(effects, "symbol", "left_anti").where(F.size(parts) > 2).select("caller", F.array_join(F.slice(parts, -2, 2), ".").alias("symbol"))
    direct = exact.unionByName(rest.join(effects, "symbol").select("caller", "category"))
    categories = sorted(r.category for r in effects.select("category").distinct().collect())  # of the dictionary, not of the code
    names = [f"m{m}" for m in range(len(categories) // MASK_BITS + 1)]
    bits = [(c, *(1 << nth % MASK_BITS if nth // MASK_BITS == m else 0 for m in range(len(names)))) for nth, c in enumerate(categories)]
    numbered = facts.call_edges.sparkSession.createDataFrame(bits, f"category string, {', '.join(f'{m} long' for m in names)}")
    own = direct.distinct().join(F.broadcast(numbered), "category").select(F.col("caller").alias("node"), *names)
    return graph.propagate_masks(own, facts.call_edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))), categories


def _named(categories: list[str]) -> Column:
    """The categories of a row of masks, sorted."""
    has = [F.when(F.col(f"m{nth // MASK_BITS}").bitwiseAND(1 << nth % MASK_BITS) != 0, F.lit(c)) for nth, c in enumerate(categories)]
    return F.array_compact(F.array(*has)) if has else F.array().cast("array<string>")


def function_effects(facts: Facts, effects: DataFrame) -> DataFrame:
    """qualname, effect: what each function does itself or through calls. effects (symbol, category) is a dictionary
    of the runtime's functions, matched by a call's whole name, else by its last two parts."""
    masks, categories = _effect_masks(facts, effects)
    return masks.select(F.col("node").alias("qualname"), F.explode(_named(categories)).alias("effect"))


def effect_sets(facts: Facts, effects: DataFrame) -> DataFrame:
    """qualname, effects (sorted, none for functions without) of every function that is defined, calls or is called."""
    masks, categories = _effect_masks(facts, effects)
    per = masks.select(F.col("node").alias("qualname"), _named(categories).alias("effects"))
    names = facts.call_edges.select(F.col("caller").alias("qualname")).union(facts.call_edges.select("callee")).union(facts.qualnames).union(per.select("qualname")).distinct()
    return names.join(per, "qualname", "left").select("qualname", F.coalesce("effects", F.array().cast("array<string>")).alias("effects"))


@detector("13", "medium", f"{CALLS} functions(end_line)", project=True)
def pure_function_violation(facts: Facts, effects: DataFrame | None = None) -> DataFrame:
    """Function with a pure name has effects."""
    pure = reduce(lambda a, b: a | b, [F.col("name").startswith(p) for p in PURE_PREFIXES])
    per = effect_sets(facts, effects).where(F.size("effects") > 0).withColumnRenamed("effects", "e")
    return facts.first_lines().where(pure).join(per, "qualname").select(F.col("path").alias("file"), "line", "end_line", F.concat_ws(" ", "qualname", F.lit("has"), F.array_join("e", ", ")).alias("evidence"), F.size("e").alias("measure"))
