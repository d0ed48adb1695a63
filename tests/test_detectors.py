"""Detectors on sources written here: each finds its positive and leaves its negative alone."""

import json
import os
import random
import subprocess
import sys
import tempfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.functions.extract import extract, wanted_of
from codeloom.operators import detectors, graph
from codeloom.operators.detectors import DETECTORS
from codeloom.operators.detectors import PROJECT as PROJECT_DETECTORS
from codeloom.operators.suppress import baseline_of, inline_ignores, unsuppressed
from codeloom.plans.facts import Facts, extracted
from codeloom.plans.report import excerpt, rubric_sections, save_json, save_markdown, tolerant_json, with_verdicts
from codeloom.sources import code

ROOT = Path(__file__).resolve().parent.parent
METHODS = "\n".join(f"    def m{i}(self):\n        return {i}" for i in range(12))
BRANCHES = "\n".join(f"    if x > {i}: y = {i}" for i in range(10))
CASES = {
    "vague_name": ("def process_v2(data): pass", "def area(width): pass"),
    "hard_to_describe": ("def build():\n a=1\n b=2\n c=3\n return a", "def build():\n 'Builds all there is.'\n b=2\n c=3\n return b"),
    "config_explosion": ("def f(a=1,b=2,c=3,d=4,e=5): pass", "def f(a,b): pass"),
    "shallow_class": ("class A(B): pass", "class A(Exception): pass"),
    "wide_interface": (f"class A:\n{METHODS}", f"class A(TestCase):\n{METHODS}"),
    "comment_repeats_code": ("# count total items\ncount = total_items = total + items", "# why: upstream is slow\nretry(3)"),
    "pass_through_method": ("class A:\n def f(self, a, *args):\n  return self.x.f(a, *args)", "class A:\n def f(self, a):\n  return self.x.f(a + 1)"),
    "conjoined_methods": ("class A:\n def f(self): return self._g()\n def _g(self):\n  a=1\n  b=2\n  return a", "class A:\n def f(self): return self._g()\n def h(self): return self._g()\n def _g(self):\n  a=1\n  b=2\n  return a"),
    "special_general_mixture": ("def apply(x): return isinstance(x, int) or isinstance(x, str)", "def parse(x): return isinstance(x, int) or isinstance(x, str)"),
    "repurposed_variable": ("def f():\n a = []\n a = {}", "def f():\n a = None\n a = {}"),
    "impl_leaks_into_interface": ("def f():\n 'Internally a loop.'", "def f():\n 'Sums values.'"),
    "forwarded_parameter": ("def f(a, b, c):\n d = b + c\n return g(a, d)", "def f(a, b, c):\n return a + b + c"),
    "required_call_ordering": ("class A:\n def open(self): pass\n def close(self): pass", "class A:\n def open(self): pass\n def close(self): pass\n def __enter__(self): pass\n def __exit__(self): pass"),
    "duplicate_code": ("def f(x):\n a=x+1\n b=a*2\n c=b\n return c\ndef g(y):\n p=y+3\n q=p*4\n r=q\n return r", "def f(x):\n a=x+1\n b=a*2\n c=b\n return c\ndef g(y):\n p=y-3\n q=p*4\n r=q\n return r"),
    "cyclomatic_complexity": (f"def f(x):\n    y = 0\n{BRANCHES}", "def f(x):\n    return x if x else 0"),
}


def facts(spark, files, root=""):
    return Facts(extracted(spark.createDataFrame(list(files.items()), "path string, source string")), root)


@pytest.mark.parametrize("name", CASES)
def test_single_files(spark, name):
    yes, no = CASES[name]
    found = DETECTORS[name](facts(spark, {"yes.py": yes, "no.py": no, "bad.py": "def (", "empty.py": ""})).collect()
    assert {r.file for r in found} == {"yes.py"} and all(r.detector == name and r.line >= 1 for r in found)


PROJECT = {
    "src/app/__init__.py": "",
    "src/app/a.py": "import app.b\nfrom app.c import C\ndef outer(x):\n    return app.b.middle(x)\nclass K:\n    def run(self, c: C):\n        return self.help() + c.go(1)\n    def help(self):\n        return 1\n",
    "src/app/b.py": "from app.c import leaf\nimport app.a\ndef middle(x):\n    return leaf(x)\n",
    "src/app/c.py": "import os\nimport app.a\ndef leaf(x):\n    return x + 1\nclass C:\n    def go(self, n):\n        return clean(n)\ndef clean(n):\n    os.remove(n)\ndef compute_total(n):\n    return clean(n)\n",
}


def test_effects_of_built_ins(spark):
    """Bare built-ins have effects, themselves and through calls; names that a module defines or imports at its top
    aren't built-ins."""
    files = {
        "a.py": "def compute_sum(p):\n    return load(p)\ndef load(p):\n    return open(p)\ndef format_row(r):\n    print(r)\ndef parse_row(r):\n    return len(r)\n",
        "b.py": "from mine import print\ndef open(p):\n    return p\ndef compute_b(p):\n    print(p)\n    return open(p)\n",
        "c.py": "def format_c(p):\n    from mine import print\n    print(p)\n",
    }
    effects = code.own_effects(spark)
    found = DETECTORS["pure_function_violation"](facts(spark, files), effects=effects).collect()
    assert {r.evidence for r in found} == {"a.compute_sum has filesystem", "a.format_row has stdout", "c.format_c has stdout"}
    kinds = [r.category for r in effects.collect()]
    assert {k: kinds.count(k) for k in kinds} == {"filesystem": 59, "network": 77, "database": 31, "global_state": 40, "subprocess": 19, "stdout": 9, "time": 10, "random": 16}


def test_external_calls(spark):
    """What each shape of call may mean."""
    source = """
import os, numpy as np, app.low
from pathlib import Path
from app import low as lower
from app.low import helper
class Own:
    limit: int = 3
    _hidden = 1
    def __init__(self):
        self.size, self.name = 1, 2
        self.name = 2
    def m(self, p, c: Own):
        self.m(p); self.a.b(p); self.client.messages.create(p); c.go(); p.x(); p.y.z()
def f(p):
    np.load(p); os.path.exists(p); Path.cwd(); app.low.run(p); lower.run(p); helper(p); local(p); g()(p); g().tail(p); "x".join(p)
    v = Own(1)
    v.other()
def local(p): pass
"""
    got = facts(spark, {"src/app/a.py": source, "src/app/low.py": "def helper(p): pass\ndef run(p): pass\n"})
    per = {}
    for r in got.external_calls.collect():
        per.setdefault(r.caller, set()).add(r.symbol)
    assert per["app.a.Own.m"] == {"a.b", "b", "messages.create", "create", "Own.go", "go", "p.x", "x", "p.y.z", "y.z", "z"}
    assert per["app.a.f"] == {
        "numpy.load", "np.load", "os.path.exists", "path.exists", "exists", "pathlib.Path.cwd", "Path.cwd", "cwd", "app.low.helper", "helper", "builtins.g", "g", "tail", "join",
        "builtins.Own", "Own", "Own.other", "other", "app.low.low.run", "app.low.run", "low.run", "run",
    } - {"builtins.Own", "Own"}
    edges = {(r.caller, r.callee) for r in got.call_edges.collect()}
    assert edges == {("app.a.Own.m", "app.a.Own.m"), ("app.a.f", "app.low.run"), ("app.a.f", "app.low.helper"), ("app.a.f", "app.a.local"), ("app.a.f", "app.a.Own")}
    assert [(r.qualname, r.attributes) for r in got.class_attributes.collect()] == [("app.a.Own", ["limit", "name"])]


def test_types_of_variables(spark):
    """By annotation, constructor and return type; not where return types disagree or the class isn't of the code."""
    source = """
from elsewhere import Far
class A: pass
def make() -> A: pass
def many() -> list[A]: pass
def odd() -> A: pass
def far() -> Far: pass
def use(v: A, u: Optional[A], t: Far, *, k: "A"):
    x = A()
    y = self.make()
    for z in many(): pass
    for n in A(): pass
    w, q, p = odd(), far(), None
    w = odd()
    q = far()
    again = A()
    again = make
"""
    got = facts(spark, {"a.py": source, "b.py": "class B: pass\ndef odd() -> B: pass\ndef over(v: A, v2: B): v = B()\n"})
    assert {(r.path, r.name, r.type) for r in got.local_types.collect()} == {("a.py", n, "A") for n in ("v", "u", "x", "y", "z", "again")} | {("b.py", "v", "B"), ("b.py", "v2", "B")}
    assert {(r.name, r.type) for r in got.return_types.collect()} == {("make", "A"), ("many", "A"), ("far", "Far")}


def test_wanted_facts():
    """Only what is wanted is made; unknown fields are refused; sources that are too deep don't parse."""
    wanted = wanted_of("functions(name,line) comments functions(complexity)")
    row = extract("a.py", "def f(x):\n    # why\n    return x if x else 0\n", wanted)
    assert row["functions"] == [{"name": "f", "line": 1, "complexity": 1}] and row["comments"][0]["text"] == "# why" and set(row) == {"path", "ok", "functions", "comments"}
    with pytest.raises(ValueError, match="nothing"):
        wanted_of("functions(nothing)")
    assert not extract("deep.py", "(" * 200_000)["ok"] and not extract("deep.py", "-" * 300_000 + "1")["ok"]


STAND_IN = """
def judge_by_line(instructions, finding):
    assert "## 13." in instructions and "JSON" in instructions
    if ">>    1  data = 1" in finding:
        return 'Well: {"verdict": "real", "reasoning": "no picture", "recommendation": "Rename."}'
    return "no idea" if ">>    2  tmp = 2" in finding else '{"verdict": "odd"}'
"""


SCHEMA = {
    "file": str, "line": int, "detector": str, "title": str, "evidence": str, "rubric_ref": str, "rubric_title": str, "severity": ("info", "low", "medium", "high"),
    "end_line": (int, type(None)), "code_excerpt": str, "judge_verdict": ("unjudged", "real", "borderline", "false_positive"), "judge_reasoning": str, "judge_recommendation": str,
}


def published(text):
    """Findings of a JSON report, each held against the published schema."""
    found = json.loads(text)
    for row in found:
        assert set(row) == set(SCHEMA) and row["line"] >= 1
        for name, kind in SCHEMA.items():
            assert row[name] in kind if isinstance(kind, tuple) and isinstance(kind[0], str) else isinstance(row[name], kind), (name, row)
    return found


def test_command_line(spark, tmp_path, tmp_path_factory, capsys, monkeypatch, caplog):
    stand_in = tmp_path_factory.mktemp("judge") / "stand_in.py"
    stand_in.write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(stand_in))
    code_ = {"a.py": "data = 1\ntmp = 2\n\n\ndef compute_sum(p):\n    return open(p)\n", "pkg/b.py": "info = 1  # codeloom: ignore\nfoo = 2\n", "build/c.py": "data = 1\n", "bad.py": "def ("}
    for name, text in code_.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    out = tmp_path / "out.json"
    run = lambda *a: cli.main([str(tmp_path), "--format", "json", "--output", str(out), *a])
    monkeypatch.setattr(cli, "DETECTORS", few := {n: DETECTORS[n] for n in ("vague_name", "shallow_class", "wide_interface", "import_cycle", "pure_function_violation")})
    assert cli.main([str(tmp_path / "nowhere")]) == 2 and cli.main([str(tmp_path), "--detectors", "nothing"]) == 2 and cli.main([str(tmp_path), "--diff", "HEAD"]) == 2
    assert run() == 0
    found = published(out.read_text())
    assert {(r["file"].removeprefix(f"{tmp_path}/"), r["line"], r["detector"]) for r in found} == {("a.py", 1, "vague_name"), ("a.py", 2, "vague_name"), ("a.py", 5, "pure_function_violation"), ("pkg/b.py", 2, "vague_name")}
    assert found[0]["code_excerpt"] == ">>    1  data = 1\n      2  tmp = 2" and found[0]["judge_verdict"] == "unjudged"
    # a model's verdicts: one real, one without JSON, one unknown
    assert run("--detectors", "vague_name", "--judge", "stand_in:judge_by_line") == 1
    verdicts = {(r["line"], r["judge_verdict"], r["judge_reasoning"]) for r in published(out.read_text()) if r["file"].endswith("a.py")}
    assert (1, "real", "no picture") in verdicts and any(n == 2 and v == "unjudged" and "no JSON" in why for n, v, why in verdicts)
    (tmp_path / "rubric.md").write_text("## 5. Depth\nx\n")
    assert run("--detectors", "vague_name", "--judge", "stand_in:judge_by_line", "--rubric", str(tmp_path / "rubric.md")) == 0
    assert all("no section 13" in r["judge_reasoning"] for r in published(out.read_text()))
    # one detector that fails as it is planned, one that fails as it runs: the others go on
    monkeypatch.setitem(few, "wide_interface", lambda facts: 1 / 0)
    monkeypatch.setitem(few, "shallow_class", lambda facts: DETECTORS["vague_name"](facts).withColumn("line", F.raise_error(F.lit("as it runs")).cast("int")))
    assert run() == 0 and len(published(out.read_text())) == 4
    assert {"wide_interface", "shallow_class"} <= {m.split()[1] for m in caplog.messages if m.startswith("detector ")}
    # settings
    (tmp_path / "codeloom.toml").write_text('[codeloom]\ndisabled = ["vague_name"]\n')
    assert run() == 0 and [r["detector"] for r in published(out.read_text())] == ["pure_function_violation"]
    # only what differs from a commit: its file is parsed for single-file detectors, all files for project detectors
    (tmp_path / "codeloom.toml").unlink()
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "pkg/b.py").write_text("bar = 2\n")
    read = []
    monkeypatch.setattr(code, "python_files", lambda root, f=code.python_files: read.append(f(root)) or read[-1])
    seen = []
    monkeypatch.setattr(cli, "facts_for", lambda files, names, *a, f=cli.facts_for, **k: seen.append((files.count(), set(names))) or f(files, names, *a, **k))
    assert run("--diff", "HEAD") == 0 and [(r["file"].split("/")[-1], r["line"]) for r in published(out.read_text())] == [("b.py", 1)]
    assert seen[0][0] == 1 and not seen[0][1] & PROJECT_DETECTORS and seen[1][0] == 3 and seen[1][1] == PROJECT_DETECTORS & set(few)
    # accepting what is there
    assert cli.main([str(tmp_path), "--baseline-update"]) == 0 and "findings accepted" in capsys.readouterr().out
    assert cli.main([str(tmp_path)]) == 0 and "_No findings._" in capsys.readouterr().out


def test_call_graph(spark):
    f = facts(spark, PROJECT)
    edges = {(r.caller, r.callee) for r in f.call_edges.collect()}
    assert edges == {("app.b.middle", "app.c.leaf"), ("app.a.K.run", "app.a.K.help"), ("app.a.K.run", "app.c.C.go"), ("app.c.C.go", "app.c.clean"), ("app.c.compute_total", "app.c.clean")}


def test_calls_meet_the_names_of_their_file_where_they_are(spark):
    """What a call's first name means takes one exchange of calls, that for the types of variables; relations that are
    given are joined and give the same."""
    own = facts(spark, PROJECT | {"z.py": "import os\nimport os.path as os\nfrom a import b\nfrom c import d as b\ndef f():\n    os.x()\n    b()\n    f()\n    g()()\n"})
    joined = Facts(own.nested, imports=own.imports, calls=own.calls)
    names = ["path", "place", "head", "n", "amodule", "fmodule", "forig", "is_def", "ltype"]
    rows = [sorted(map(str, f._placed_calls.select(names).collect())) for f in (own, joined)]
    assert rows[0] == rows[1] and any("os.path" in r for r in rows[0]) and any("fmodule='c'" in r for r in rows[0])
    before = own._placed_calls.where("ltype is null or true").drop("ltype")
    plan = own.nested.select("path", F.explode("calls"))._jdf.queryExecution().executedPlan().toString()
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(path")
    assert "Exchange" not in plan and count(before) <= count(joined._placed_calls) - 3


def test_project_detectors(spark):
    f = facts(spark, PROJECT)
    cycle = DETECTORS["import_cycle"](f).collect()
    assert [(r.file, r.measure) for r in cycle] == [("src/app/a.py", 3.0)]
    pure = DETECTORS["pure_function_violation"](f, effects=code.own_effects(spark)).collect()
    assert [(r.line, r.evidence) for r in pure] == [(10, "app.c.compute_total has filesystem")]
    assert [r.file for r in DETECTORS["forbidden_import"](f, rules={"src/app/*.py": ["os"]}).collect()] == ["src/app/c.py"]
    assert {r.file for r in DETECTORS["boundary_violation"](f, layers={"low": ["*c.py"], "high": ["*"]}, allowed={"high": ["low"]}).collect()} == {"src/app/c.py"}
    assert DETECTORS["forbidden_import"](f).count() == DETECTORS["boundary_violation"](f).count() == 0


def test_rules_of_odd_shapes(spark):
    """Calls as decorators, bases with arguments, packed arguments, definitions of one name, a leading ellipsis."""
    lines = lambda name, text: sorted(r.line for r in DETECTORS[name](facts(spark, {"m.py": text})).collect())
    pair = "class A:\n    def start(self): pass\n    def stop(self): pass\n"
    assert [lines("required_call_ordering", x + pair) for x in ("@dataclass(frozen=True)\n", "@dataclass\n", "@a.define\n", "")] == [[2], [], [], [1]]
    assert lines("pass_through_method", "class A:\n    def m(self, *a): return self.b.m(*a)\n    def o(self, *rest): return self.b.o(*args)\n    def k(self, x, **o):\n        ...\n        return self.b.k(x, **kwargs)\n") == [3, 4]
    body = "        a = 1\n        b = 2\n        c = 3\n"
    twice = f"class A:\n    def go(self): self._x\n    @property\n    def _x(self):\n{body}    @_x.setter\n    def _x(self, v):\n        ...\n{body}    def run(self): return self._x()\n"
    assert lines("conjoined_methods", twice) == [9]
    calls = "".join(f"        self._m{i}()\n" for i in range(4)) + "        self.__len__()\n"
    busy = f"class A:\n    def go(self):\n{calls}" + "".join(f"    def _m{i}(self):\n{body}" for i in range(4)) + "    def __len__(self): return 1\n"
    assert lines("conjoined_methods", busy) == [] and len(lines("conjoined_methods", busy.replace("self.__len__()", "pass"))) == 4
    short = "class B:\n" + "".join(f"    def {n}(self):\n        ...\n{body}" for n in "mn")
    assert lines("shallow_class", short) == [1] and lines("shallow_class", short.replace("c = 3", "c = 3\n        d = 4")) == []
    code_ = {f"u{i}.py": "from c import P, Q\n" for i in range(10)} | {"c.py": "class P(Protocol[T]): pass\nclass Q(Generic[T]): pass\n"}
    assert [r.line for r in DETECTORS["unstable_interface"](facts(spark, code_)).collect()] == [2]


def test_imports_resolve_by_local_names(spark):
    """A module that isn't there falls back to its bound name; a name from a module to the submodule of the local name."""
    cycle = lambda files: [r.measure for r in DETECTORS["import_cycle"](facts(spark, files)).collect()]
    assert cycle({"a/__init__.py": "import b\n", "b.py": "import a.gone\n"}) == [2.0]
    assert cycle({"a.py": "import b\n", "b.py": "import zz as a\n"}) == [2.0]
    assert cycle({"p/b.py": "import q\n", "q.py": "from p import b as q2\n"}) == [] and cycle({"p/b.py": "import q\n", "q.py": "from p import x as b\n"}) == [2.0]
    assert cycle({"a.py": "import b\n", "b.py": "from . import a\n"}) == []


def test_pass_through_variable(spark):
    chain = "def f(x):\n    return g(x)\ndef g(y):\n    return h(y)\ndef h(z):\n    return z + 1\n"
    assert [(r.line, r.measure) for r in DETECTORS["pass_through_variable"](facts(spark, {"m.py": chain})).collect()] == [(1, 2.0)]
    assert DETECTORS["pass_through_variable"](facts(spark, {"m.py": chain.replace("h(y)", "h(y) + y")})).count() == 0


def test_first_chains_against_all_walks(spark):
    """Chains through random calls with cycles, by the best ways on and by walking all; a hub of many callers and callees."""
    rng = random.Random(11)
    state = lambda i: (f"f{i // 2}", "xy"[i % 2])
    reads = {i: rng.random() < 0.15 for i in range(40)}
    edges = []
    for i in range(40):
        for place in range(rng.randrange(0, 5)):
            j = rng.randrange(40)
            edges.append((*state(j), *state(i), {"place": place, "nth": i % 2}, reads[j]))
    schema = "to string, next string, fn string, param string, ord struct<place:int,nth:int>, ends boolean"
    table = spark.createDataFrame(edges, schema)
    start = spark.createDataFrame([state(i) for i in range(40) if not reads[i]], "fn string, param string")
    walked = {(r.fn, r.param): r.tail for r in detectors._walked(start, table, 3).collect()}
    assert walked == {(r.fn, r.param): r.tail for r in detectors._first_chains(table).join(start, ["fn", "param"]).collect()} and len(walked) > 15
    hub = [("h", "x", f"a{i}", "x", {"place": 0, "nth": 0}, False) for i in range(1000)] + [(f"b{i}", "x", "h", "x", {"place": i, "nth": 0}, i > 0) for i in range(1000)]
    got = detectors._first_chains(spark.createDataFrame(hub, schema)).collect()
    assert len(got) == 1001 and all([s.fn for s in r.tail][-1] == "b1" for r in got)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.strong_components(edges).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert graph.reachable(edges).count() == 13


def test_shared_folder():
    """The setting, what setCheckpointDir was given, a folder of the session's own in local mode; else an error."""
    code = """
import sys
from pyspark.sql import SparkSession
from codeloom.scratch import shared_dir
way, at = sys.argv[1:]
builder = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = (builder.config("spark.checkpoint.dir", at) if way == "conf" else builder).getOrCreate()
if way == "set":
    spark.sparkContext.setCheckpointDir(at)
if way == "cluster":
    spark.sparkContext.master = "spark://elsewhere"
try:
    found = shared_dir(spark)
    assert (at in found) == (way in ("conf", "set")) and shared_dir(spark) == found, found
    assert spark.range(3).checkpoint().count() == 3
except RuntimeError as e:
    assert way == "cluster" and "spark.checkpoint.dir" in str(e)
else:
    assert way != "cluster"
"""
    for way in ("conf", "set", "neither", "cluster"):
        with tempfile.TemporaryDirectory() as at:
            subprocess.run([sys.executable, "-c", code, way, at], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": at}, check=True, timeout=120)


def test_suppression_and_reports(spark, tmp_path):
    source = "# codeloom: ignore-file\ndata = 1\n"
    lines = "data = 1  # codeloom: ignore[vague_name]\ninfo = 1  # codeloom: ignore[other]\ntmp = 2\nobj = 3  # codeloom: ignore\n"
    f = facts(spark, {"a.py": source, "b.py": lines})
    findings = DETECTORS["vague_name"](f)
    ignores = inline_ignores(f.comments)
    left = unsuppressed(findings, ignores)
    assert sorted((r.file, r.line) for r in left.collect()) == [("b.py", 2), ("b.py", 3)]
    baseline = baseline_of(left.where("line = 2"), F.col("file"))
    assert [r.line for r in unsuppressed(findings, ignores, baseline).collect()] == [3]
    judged = with_verdicts(left, lambda x: {"judge_verdict": "real"} if x["line"] == 2 else {"judge_verdict": "odd"})
    assert sorted((r.line, r.judge_verdict) for r in judged.collect()) == [(2, "real"), (3, "unjudged")]
    out = tmp_path / "report"
    save_json(judged, str(out), list(DETECTORS))
    rows = [{k: v for k, v in r.asDict().items() if k != "measure"} for r in judged.orderBy("line").collect()]
    found = json.loads(out.read_text())
    assert [r["line"] for r in found] == [2, 3] and out.read_text() == json.dumps(found, indent=2) and [{k: r[k] for k in x} for x, r in zip(found, rows)] == found
    save_markdown(judged, str(out))
    lines = [f"- **{r['severity']}** `b.py:{r['line']}` {r['evidence']}" for r in rows]
    assert out.read_text() == f"| detector | total | real | borderline | unjudged |\n|-|-|-|-|-|\n| vague_name | 2 | 1 | 0 | 1 |\n\n## Vague name (vague_name)\n\n{lines[0]} (real: )\n{lines[1]}\n"
    save_markdown(judged.limit(0), str(out))
    assert out.read_text() == "_No findings._\n" and tolerant_json('so: {"a": 1}.') == {"a": 1} and tolerant_json("no") is None
    shown = f.files.where("path = 'b.py'").withColumns({"line": F.lit(2), "end_line": F.lit(2)}).select(excerpt("lines", "line", "end_line", 1).alias("x")).first().x
    assert shown.split("\n")[1].startswith(">>    2  info = 1")


def test_sources(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "pkg").mkdir()
    for name, text in {"pkg/__init__.py": "data = 1\n", "pkg/a.py": "x = 1\n", ".hidden/b.py": "", "codeloom.toml": '[codeloom]\ndisabled = ["vague_name"]\n[layers]\nb = ["*"]\na = ["*"]\n'}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "pkg/bad.py").write_bytes(b"\xff\xfe")
    rows = {r.path.rsplit("/", 1)[1]: r.source for r in code.read_code(spark, tmp_path).collect()}
    assert rows == {"__init__.py": "data = 1\n", "a.py": "x = 1\n", "bad.py": None} and not extract("bad.py", None)["ok"]
    config = code.load_config(tmp_path / "pkg")
    assert config.disabled == ["vague_name"] and list(config.layers) == ["b", "a"]
    (tmp_path / "base.tsv").write_text("# head\n\nd\tp.py\t3\tabc\nd\tp.py\tx\tabc\nshort\trow\n")
    assert [tuple(r) for r in code.load_baseline(spark, str(tmp_path / "base.tsv")).collect()] == [("d", "p.py", 3, "abc")]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "pkg/a.py").write_text("x = 2\n")
    assert code.changed_files(tmp_path, "HEAD") == {str(tmp_path / "pkg/a.py")}
    assert rubric_sections("# T\n## 1. One\na\n## Part\nb\n## 2. Two\nc") == {"1": "## 1. One\na\n## Part\nb", "2": "## 2. Two\nc"}


def test_stream(spark, tmp_path):
    from codeloom.streaming.arrivals import watch

    spark.createDataFrame([("a.py", "data = 1")], "path string, source string").write.parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), ["vague_name", "import_cycle"]).awaitTermination()
    spark.createDataFrame([("b.py", "info = 1")], "path string, source string").write.mode("append").parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), ["vague_name", "import_cycle"]).awaitTermination()
    assert {(r.file, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.py", 0), ("b.py", 1)}
    # the last batch once more, as after a failure between its writing and its commit
    for left in ("1", ".1.crc"):
        (tmp_path / "check/commits" / left).unlink()
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), ["vague_name", "import_cycle"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_equal_sources_of_a_batch_are_parsed_once(monkeypatch):
    from codeloom.plans import facts

    parsed, wanted = [], wanted_of("functions(name)")
    monkeypatch.setattr(facts, "extract", lambda path, source, w: parsed.append(source) or extract(path, source, w))
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b", "c", "d", "e"], "source": ["def f(): pass", "def g(): pass", "def f(): pass", None, "def ("]})
    schema = pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("functions", pa.list_(pa.struct([("name", pa.string())])))])
    found = facts._facts_of(batch, wanted, schema).to_pylist()
    assert len(parsed) == 4 and [(r["path"], r["ok"], [f["name"] for f in r["functions"] or ()]) for r in found] == [("a", True, ["f"]), ("b", True, ["g"]), ("c", True, ["f"]), ("d", False, []), ("e", False, [])]


def test_statements_and_calls_inside_are_counted_without_contexts():
    source = "class A:\n    def m(self, x):\n        try:\n            x = [self._a(y) for y in x]\n        except E:\n            pass\n        match x:\n            case 1 if self._b():\n                pass\n        return x\n"
    found = extract("a.py", source, wanted_of("functions(own_stmts,self_calls,complexity)"))["functions"]
    assert [(f["own_stmts"], f["self_calls"], f["complexity"]) for f in found] == [(6, ["_a", "_b"], 3)]


def test_info_leakage_in_tasks_of_few_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones, of both joins; files and attributes are counted as by plain sets."""
    monkeypatch.setattr(detectors, "TASK_ROWS", 100)
    n = 100 * (int(spark.conf.get("spark.sql.shuffle.partitions")) + 9)
    rows = [(f"f{i * i % 31}", f"v{i % 60}", f"C{i % 60}", ("_" if i % 11 == 0 else "") + f"a{i // 60 % (1 + i % 7)}") for i in range(n)]
    attrs = spark.createDataFrame([(p, v, a, 1) for p, v, _, a in rows], "path string, receiver string, attr string, line int")
    types = spark.createDataFrame(sorted({(p, v, c) for p, v, c, _ in rows}), "path string, name string, type string")
    classes = spark.createDataFrame([(f"f{c % 31}", 0, f"C{c}", c) for c in range(60)], "path string, place int, name string, line int")
    found = detectors.DETECTORS["info_leakage"](Facts(classes=classes, local_types=types, attrs=attrs))
    tasks = -(-sum(not a.startswith("_") for *_, a in rows) // 100)
    shuffles = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 4 and all(f", {tasks})" in x or f", {tasks}," in x for x in shuffles), shuffles
    want = {}
    for p, _, c, a in rows:
        if not a.startswith("_") and p != f"f{int(c[1:]) % 31}":
            paths, names = want.setdefault(c, (set(), set()))
            paths.add(p), names.add(a)
    want = {(int(c[1:]), len(a), " ".join([", ".join(sorted(p)[:5]), *([f"(+{len(p) - 5} more)"] if len(p) > 5 else [])])) for c, (p, a) in want.items() if len(p) >= 4 and len(a) >= 3}
    assert want and {(r.line, r.measure, r.evidence) for r in found.collect()} == want


def test_relations_of_the_code_are_not_broadcast(spark):
    """Joins of what grows with the code are shuffled, however small Spark believes a side to be."""
    files = spark.createDataFrame([("a.py", "def f(a):\n    return g(a)\ndef g(a):\n    return h(a)\ndef h(a):\n    return a + 1\n")], "path string, source string")
    found = DETECTORS["pass_through_variable"](detectors.facts_for(files, ["pass_through_variable"], keep=True))
    assert [(r.line, r.measure) for r in found.collect()] == [(1, 2.0)]
    facts = detectors.facts_for(files, ["pass_through_variable", "import_cycle"])
    for made in (found, facts.call_sites, facts.external_calls, facts.import_targets):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
