"""The data source of code bases: pruning, pushed filters, partitions; facts kept by content; texts written by pieces."""

from pathlib import Path

import pytest

from codeloom.operators.suppress import unsuppressed
from codeloom.plans.facts import extracted, read_facts
from codeloom.plans.kept import kept_facts
from codeloom.plans.report import verdicts_kept
from codeloom.scratch import own_path, release, written
from codeloom.sources import code, format
from codeloom.sources.text import save_text


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "pkg").mkdir()
    for i in range(20):
        (tmp_path / f"pkg/m{i:02}.py").write_text(f"# of {i}\ndef f{i}(a):\n    return g(a)\n")
    (tmp_path / "pkg/bad.py").write_text("def (")
    (tmp_path / "pkg/raw.py").write_bytes(b"\xff")
    return tmp_path


def test_schema_prunes(spark, tree):
    """Only the wanted facts are made; the same rows as by the extractor on a table of sources."""
    reader = format.CodeReader({"path": str(tree)}, spark.createDataFrame([], "path string, functions array<struct<name:string>>, top_defs array<string>").schema)
    assert reader.wanted == {"functions": {"name"}, "top_defs": set()}
    assert set(reader._row(str(tree / "pkg/m03.py"), True)["functions"][0]) == {"name"}
    files = code.read_code(spark, tree)
    assert files.count() == 22 and files.where("source is null").count() == 1
    wanted = "functions(name,line) comments imports"
    rows = lambda df: sorted(map(str, df.select("path", "functions", "comments", "imports").collect()))
    assert rows(read_facts(spark, str(tree), wanted)) == rows(extracted(files, wanted)) and read_facts(spark, str(tree)).count() == 20
    assert code.code_source(spark).schema("path string").load(str(tree)).count() == 22
    for schema in ("path string, nothing int", "path string, functions array<struct<colour:string>>"):
        with pytest.raises(ValueError):
            format.CodeReader({"path": str(tree)}, spark.createDataFrame([], schema).schema)


def test_filters_are_pushed(spark, tree):
    """Files that a filter on path leaves out are not opened: one that goes after planning isn't missed."""
    some = {str(tree / "pkg/m01.py"), str(tree / "pkg/m02.py"), "/elsewhere.py"}
    assert sorted(r.path[-6:] for r in code.read_code(spark, tree, some).collect()) == ["m01.py", "m02.py"] and code.read_code(spark, tree, set()).count() == 0
    reader = format.CodeReader({"path": str(tree)}, spark.createDataFrame([], "path string").schema)
    left = list(reader.pushFilters([format.In(("path",), tuple(some)), format.EqualTo(("ok",), True)]))
    assert left == [format.EqualTo(("ok",), True)] and [len(p.paths) for p in reader.partitions()] == [2]
    found = read_facts(spark, str(tree), "comments").where("path like '%m07.py'")
    assert found.count() == 1
    plan = code.read_code(spark, tree, some)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan codeloom" in plan


def test_partitions_by_bytes(spark, tree):
    size = (tree / "pkg/m01.py").stat().st_size
    found = code.code_source(spark).option("partitionBytes", 5 * size).load(str(tree))
    assert found.rdd.getNumPartitions() >= 4 and found.count() == 22
    assert code.code_source(spark).load(str(tree / "pkg/m01.py")).count() == 1 and code.code_source(spark).load(str(tree / "none")).count() == 0


def test_facts_are_kept_by_content(spark, tree, tmp_path_factory):
    """A second run parses what is new and nothing else, wherever it lies; other facts or another extractor are others."""
    store = str(tmp_path_factory.mktemp("kept") / "facts")
    wanted = "functions(name,line) imports"
    parsed = lambda: sum(1 for p in Path(store).rglob("*.parquet") for _ in range(spark.read.parquet(str(p)).count()))
    rows = lambda df: sorted(map(str, df.select("path", "functions", "imports").collect()))
    first = kept_facts(code.read_code(spark, tree), store, wanted)
    assert rows(first) == rows(extracted(code.read_code(spark, tree), wanted)) and parsed() == 21
    (tree / "pkg/m03.py").write_text("def other(): pass\n")
    (tree / "pkg/copy.py").write_text((tree / "pkg/m04.py").read_text())
    again = kept_facts(code.read_code(spark, tree), store, wanted)
    assert rows(again) == rows(extracted(code.read_code(spark, tree), wanted)) and parsed() == 22
    kept_facts(code.read_code(spark, tree), store, wanted)
    assert parsed() == 22
    kept_facts(code.read_code(spark, tree), store, "comments")
    assert parsed() == 43


def test_text_is_written_by_pieces(spark, tmp_path):
    """Rows in their order, from many partitions, with what stands around them; no rows; a failure leaves no pieces."""
    out = tmp_path / "out.txt"
    rows = spark.range(1000).selectExpr("id", "concat('row ', id) AS text").repartition(7)
    save_text(rows.orderBy("id"), str(out), head="[", separator=",\n", tail="]", empty="none")
    assert out.read_text() == "[" + ",\n".join(f"row {i}" for i in range(1000)) + "]"
    save_text(rows.where("id < 0"), str(out), head="[", empty="none")
    assert out.read_text() == "none"
    with pytest.raises(Exception, match="halt"):
        save_text(rows.selectExpr("IF(id = 500, raise_error('halt'), text) AS text"), str(out))
    assert [p.name for p in tmp_path.iterdir()] == ["out.txt"]


def test_ignores_of_one_file(spark):
    """10^5 ignores and 10^5 findings of one file, short and long, against a search in a sorted list."""
    import bisect
    import random

    rng, n = random.Random(2), 100_000
    lines = {name: sorted(rng.sample(range(1, 4_000_000), n // 4)) for name in ("a", "b", "c", None)}
    ignores = spark.createDataFrame([("f.py", x, name) for name, xs in lines.items() for x in xs], "path string, line int, name string")
    spans = [(i, rng.randrange(1, 4_000_000), rng.choice((None, 0, 3, 40, 70, 5000))) for i in range(n)]
    findings = spark.createDataFrame([("f.py", x, None if more is None else x + more, "abc"[i % 3]) for i, x, more in spans], "file string, line int, end_line int, detector string")
    covered = lambda xs, a, b: bisect.bisect_right(xs, b) > bisect.bisect_left(xs, a)
    want = sum(not any(covered(lines[d], x, x + (more or 0)) for d in ("abc"[i % 3], None)) for i, x, more in spans)
    assert unsuppressed(findings, ignores).count() == want


def test_verdicts_survive_failures(spark, tmp_path):
    """What was asked before a failure isn't asked again; answers that failed are."""
    asked = tmp_path / "asked"
    asked.mkdir()
    findings = spark.createDataFrame([("f.py", i, "d", f"e{i}", "") for i in range(40)] + [("f.py", 3, "d", "e3", "")], "file string, line int, detector string, evidence string, code_excerpt string")

    def judge(row, fails=True):
        import os
        import uuid

        (asked / f"{row['line']}-{uuid.uuid4().hex}").touch()
        if row["line"] == 7 and fails:
            os._exit(1)  # the worker is lost
        if row["line"] == 9 and fails:
            raise ValueError("no answer")
        return {"judge_verdict": "real", "judge_reasoning": f"of {row['line']}"}

    store = str(tmp_path / "verdicts")
    with pytest.raises(Exception):
        verdicts_kept(findings, judge, store, at_once=4)
    before = len(list(asked.iterdir()))
    got = verdicts_kept(findings, lambda row: judge(row, False), store, at_once=4).collect()
    assert len(got) == 41 and {r.judge_verdict for r in got} == {"real"} and all(r.judge_reasoning == f"of {r.line}" for r in got)
    assert before < 40 and len(list(asked.iterdir())) <= 40 + 12
    n = len(list(asked.iterdir()))
    assert verdicts_kept(findings, judge, store).where("judge_verdict = 'real'").count() == 41 and len(list(asked.iterdir())) == n


def test_release(spark):
    table = written(spark.range(3), "some")
    path = table.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert Path(path).exists()
    release(spark)
    assert not Path(path).exists() and own_path(spark, "x")


def test_task_after_an_abort_leaves_no_pieces(tmp_path, monkeypatch):
    from codeloom.sources import text

    monkeypatch.setattr(text, "TaskContext", type("", (), {"get": staticmethod(lambda: type("", (), {"partitionId": lambda self: 0})())}))
    writer = text.TextWriter({"path": str(tmp_path / "out.txt"), "run": "r", "head": "|", "separator": "|", "tail": "|", "empty": "|"})
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([]))
    assert not list(tmp_path.iterdir())
