"""Facts as DataFrames: the extractor's nested rows, exploded into relations, and relations derived from these."""

from __future__ import annotations

import re
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.extract import ddl, extract, wanted_of


def _facts_of(batch: pa.RecordBatch, facts: dict[str, set[str]], schema: pa.Schema) -> pa.RecordBatch:
    sources = batch["source"].dictionary_encode(null_encoding="encode")
    rows = pa.RecordBatch.from_pylist([extract("", s, facts) for s in sources.dictionary.to_pylist()], schema=schema)
    return rows.take(sources.indices).set_column(0, "path", batch["path"].cast(pa.string()))


def extracted(files: DataFrame, wanted: str | None = None, broken: bool = False) -> DataFrame:
    """files (path, source) as one nested row of facts each: those that are wanted ("functions(name,line) comments"), or
    all. Files that don't parse are dropped, or, with broken, have a row that isn't ok. Of the files of a batch whose
    sources are equal one is parsed."""
    facts = wanted_of(wanted)
    schema = to_arrow_schema(StructType.fromDDL(ddl(facts)))

    def run(batches):
        for batch in batches:
            found = _facts_of(batch, facts, schema)
            yield found if broken else found.filter(found["ok"])

    return files.select("path", "source").mapInArrow(run, ddl(facts))


def read_facts(spark: SparkSession, root: str, wanted: str | None = None) -> DataFrame:
    """What extracted() gives of the code base under root, parsed in the tasks that read its files."""
    from ..sources.code import code_source

    return code_source(spark).schema(ddl(wanted_of(wanted))).load(root).where("ok")


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two relations that both grow with the code, by shuffles. Sizes that Spark chooses broadcasts by are those
    of compressed rows: what is 10 MB there can be 600 MB in the driver and in every executor."""
    return left.join(right.hint("merge"), on, how)


def qualified(*parts: str | Column) -> Column:
    """The parts that aren't empty, joined by dots."""
    return F.concat_ws(".", *[F.nullif(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def module_of(path: str | Column) -> Column:
    """The module that a path relative to the root is: without .py, /__init__ and a leading src."""
    path = F.col(path) if isinstance(path, str) else path
    path = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.replace(F.regexp_replace(path, r"^src(/|$)", ""), F.lit("/"), F.lit("."))


class Facts:
    """The relations of one code base. Each is a DataFrame; any can be given instead of derived, by keyword, which is
    how queries run on facts from elsewhere."""

    def __init__(self, nested: DataFrame | None = None, root: str = "", **given: DataFrame):
        if nested is not None:
            rel = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/" if root else "^$", "")
            nested = nested.withColumn("rel_path", rel).withColumn("module", module_of(rel))
        self.nested, self.given = nested, set(given)
        self.__dict__.update(given)

    def _part(self, name: str) -> DataFrame:
        return self.nested.select("path", "module", F.posexplode(name).alias("ord_", "x")).select("path", "module", F.col("ord_").alias("place"), "x.*")

    @cached_property
    def files(self) -> DataFrame:
        return self.nested.select("path", "rel_path", "module", *({"lines", "top_names", "top_defs"} & set(self.nested.columns)))

    functions = cached_property(lambda self: self._part("functions"))
    classes = cached_property(lambda self: self._part("classes"))
    targets = cached_property(lambda self: self._part("targets"))
    comments = cached_property(lambda self: self._part("comments"))
    @cached_property
    def imports(self) -> DataFrame:
        """path, line, x_module (the module that is imported), name, orig, is_from, top, ord."""
        return self.nested.select("path", F.explode("imports").alias("x")).select("path", "x.line", F.col("x.module").alias("x_module"), "x.name", "x.orig", "x.is_from", "x.top", "x.ord")

    attrs = cached_property(lambda self: self._part("attrs"))
    calls = cached_property(lambda self: self._part("calls"))

    @cached_property
    def modules(self) -> DataFrame:
        """module, file; of files that are one module the last by path."""
        return self.files.where("module <> ''").groupBy("module").agg(F.max("path").alias("file"))

    @cached_property
    def return_types(self) -> DataFrame:
        """Functions whose short name returns one annotated class in all of the code: name, type."""
        known = self.functions.where("returns is not null").groupBy("name").agg(F.min("returns").alias("type"), F.max("returns").alias("other"))
        return known.where("type = other").select("name", "type")

    @cached_property
    def local_types(self) -> DataFrame:
        """path, name, type: the class, of the code, of a variable, by annotation, constructor or return type; the last
        one found."""
        names = self.classes.select(F.col("name").alias("type")).distinct()
        returns = self.return_types.select(F.col("name").alias("type"), F.col("type").alias("returned"))
        returns = merged(returns, names.withColumnRenamed("type", "returned"), "returned")
        found = merged(merged(self._part("vars"), names.withColumn("is_class", F.lit(True)), "type", "left"), returns, "type", "left")
        type_ = F.when(F.col("is_class") & (F.col("kind") != "loop"), F.col("type")).when(F.col("kind") != "class", F.col("returned"))
        return found.withColumn("known", type_).where("known is not null").groupBy("path", "name").agg(F.max_by("known", "ord").alias("type"))

    @cached_property
    def import_targets(self) -> DataFrame:
        """Imports that lead to a file of the code: that of the module itself; else, of a name from a module, that of the
        submodule which the local name tells; else, of a whole module, that of a module which the local name tells."""
        modules = self.modules
        whole = modules.select(F.col("module").alias("m1"), F.col("file").alias("f1"))
        part = modules.select(F.col("module").alias("m2"), F.col("file").alias("f2"))
        longer = F.when(~F.col("is_from"), F.col("i.name")).when(F.col("i.x_module") != "", F.concat_ws(".", "i.x_module", "i.name"))
        found = merged(merged(self.imports.alias("i"), whole, F.col("i.x_module") == F.col("m1"), "left"), part, longer == F.col("m2"), "left")
        return found.select("i.*", F.coalesce("f1", "f2").alias("target")).where("target is not null")

    @cached_property
    def _placed_calls(self) -> DataFrame:
        """Calls with what their first name may mean: the class of a variable (ltype), the module that it is an alias of
        (amodule), the name that it is of a module (fmodule, forig), a function or class of the file (is_def). A file's
        row has its imports and names beside its calls, so these meet where they are."""
        local = self.local_types.select("path", F.col("name").alias("head"), F.col("type").alias("ltype"))
        if self.nested is None or {"calls", "imports", "files"} & self.given:
            return merged(self._joined_calls, local, ["path", "head"], "left")
        bound = lambda is_from: F.get(F.reverse(F.filter("imports", lambda i: i["top"] & (i["is_from"] == is_from) & (i["name"] == F.col("head")))), F.lit(0))
        c = self.nested.select("path", "module", "imports", "top_defs", F.posexplode("calls").alias("place", "x")).select("path", "module", "place", "x.*", "imports", "top_defs")
        c = c.withColumns({"head": F.get("chain", F.lit(0)), "n": F.size("chain")})
        c = c.withColumns({"a": bound(False), "f": bound(True), "is_def": F.when(F.array_contains("top_defs", F.col("head")), True)})
        c = c.withColumns({"amodule": F.col("a.module"), "fmodule": F.col("f.module"), "forig": F.col("f.orig")}).drop("a", "f", "imports", "top_defs")
        return merged(c, local, ["path", "head"], "left")

    @cached_property
    def _joined_calls(self) -> DataFrame:
        """The same without ltype, of relations that were given."""
        top = self.imports.where("top")
        alias = top.where("not is_from").groupBy("path", F.col("name").alias("head")).agg(F.max_by("x_module", "ord").alias("amodule"))
        named = top.where("is_from").groupBy("path", F.col("name").alias("head")).agg(F.max_by(F.struct("x_module", "orig"), "ord").alias("x")).select("path", "head", F.col("x.x_module").alias("fmodule"), F.col("x.orig").alias("forig"))
        defs = self.files.select("path", F.explode("top_defs").alias("head")).distinct().withColumn("is_def", F.lit(True))
        c = self.calls.withColumns({"head": F.get("chain", F.lit(0)), "n": F.size("chain")})
        for known in (alias, named, defs):
            c = merged(c, known, ["path", "head"], "left")
        return c

    @cached_property
    def call_sites(self) -> DataFrame:
        """Calls resolved within the code: caller, callee, path, place, args. The first rule that applies decides, even
        if it finds nothing: own methods, typed variables, imported modules, names from modules, names of the module."""
        methods = self.classes.select("path", "place", "module", "top", F.col("name").alias("cname"), F.explode("methods").alias("method"))
        own = methods.where("top").select("path", F.col("cname").alias("class_name"), "method", F.lit(True).alias("is_own")).distinct()
        typed = methods.groupBy(F.col("cname").alias("ltype"), "method").agg(F.min_by("module", F.struct("path", "place")).alias("cmodule"))
        defs = self.files.select("module", F.col("path").alias("file"), F.explode("top_defs").alias("to_name"))
        defs = merged(defs, self.modules, ["module", "file"])
        defs = defs.select(F.col("module").alias("to_module"), "to_name", F.lit(True).alias("is_there")).distinct()
        c = merged(merged(self._placed_calls.where("n in (1, 2)"), own, ["path", "class_name", "method"], "left"), typed, ["ltype", "method"], "left")
        to_module = F.when(F.col("n") == 1, F.col("fmodule")).when(F.col("amodule").isNotNull(), F.col("amodule")).when(F.col("forig").isNotNull(), qualified("fmodule", "forig"))
        c = merged(c.withColumns({"to_module": to_module, "to_name": F.when(F.col("n") == 1, F.col("forig")).otherwise(F.col("method"))}), defs, ["to_module", "to_name"], "left")
        there = F.when(F.col("is_there"), qualified("to_module", "to_name"))
        two = (
            F.when((F.col("head") == "self") & F.col("class_name").isNotNull(), F.when(F.col("is_own"), qualified("module", "class_name", "method")))
            .when(F.col("ltype").isNotNull(), F.when(F.col("cmodule").isNotNull(), qualified("cmodule", "ltype", "method")))
            .otherwise(there)
        )
        one = F.when(F.col("is_def"), qualified("module", "head")).otherwise(there)
        callee = F.when(F.col("n") == 2, two).otherwise(one)
        return c.select(qualified("module", "owner").alias("caller"), callee.alias("callee"), "path", "place", "args", "line").where("callee is not null")

    @cached_property
    def call_edges(self) -> DataFrame:
        return self.call_sites.select("caller", "callee").distinct()

    @cached_property
    def external_calls(self) -> DataFrame:
        """caller, symbol: dotted names that a call may mean outside of the code. What a call can mean depends on its
        first name: an import leads to the module's names, a variable of known class to the class's, self and unknown
        names to the last names of the chain; a bare name that is neither imported nor defined is a built-in."""
        n, head, method = F.col("n"), F.col("head"), F.col("method")
        means = F.when((n > 1) & F.col("amodule").isNotNull(), F.col("amodule")).when((n < 3) & F.col("forig").isNotNull(), qualified("fmodule", "forig"))
        inside = self.modules.select(F.col("module").alias("means"), F.lit(True).alias("is_inside"))
        c = merged(self._placed_calls.withColumn("means", means), inside, "means", "left")
        rest = F.array_join(F.slice("chain", 2, F.greatest(n - 1, F.lit(0))), ".")
        whole, last = F.array_join("chain", "."), F.array_join(F.slice("chain", F.greatest(n - 1, F.lit(1)), 2), ".")
        symbols = (
            F.when(n == 0, F.array(method))
            .when((n == 1) & F.col("forig").isNotNull(), F.array("means", "forig"))
            .when(n == 1, F.when(F.col("is_def").isNull(), F.array(F.concat(F.lit("builtins."), head), head)))
            .when(head == "self", F.when(n > 2, F.array(last, method)))
            .when(F.col("amodule").isNotNull(), F.concat(F.array(qualified("means", rest), whole), F.when(n > 2, F.array(last, method)).otherwise(F.array().cast("array<string>"))))
            .when((n == 2) & F.col("forig").isNotNull(), F.array(qualified("means", method), qualified("forig", method), method))
            .when((n == 2) & F.col("ltype").isNotNull(), F.array(qualified("ltype", method), method))
            .otherwise(F.array(whole, last, method))
        )
        symbols = F.array_distinct(F.array_compact(F.when(F.col("is_inside").isNull() | (n > 2), symbols)))
        return c.select(qualified("module", "owner").alias("caller"), F.explode(symbols).alias("symbol")).distinct()

    @cached_property
    def qualnames(self) -> DataFrame:
        """qualname of every function and method of the code."""
        return self.functions.where("owner is not null").select(qualified("module", "owner").alias("qualname")).distinct()

    @cached_property
    def class_attributes(self) -> DataFrame:
        """qualname, name, path, line of every class, with the public attributes that it defines."""
        return self.classes.select(qualified("module", "name").alias("qualname"), "name", "path", "line", "attributes")

    def first_lines(self) -> DataFrame:
        """qualname, path, line, name of functions; of those that share a qualname the last."""
        quals = self.functions.where("owner is not null").withColumn("qualname", qualified("module", "owner"))
        return quals.withColumn("n", F.row_number().over(Window.partitionBy("qualname").orderBy(F.desc("path"), F.desc("place")))).where("n = 1").select("qualname", "path", "line", "end_line", "name")
