"""python -m codeloom.cli PATH: scan a code base. Exit status: 0, 1 if a verdict is real, 2 for a bad path, ref or detector."""

from __future__ import annotations

import argparse
import importlib
import logging
import shutil
import subprocess
import sys
import tempfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.detectors import DETECTORS, FINDINGS, NEEDS, PROJECT, facts_for
from .operators.suppress import baseline_of, inline_ignores, unsuppressed
from .plans.facts import Facts
from .plans.kept import kept_facts
from .plans.report import asking, save_json, save_markdown, verdicts_kept, with_excerpts, with_verdicts
from .scratch import written
from .sources import code
from .sources.text import save_text

log = logging.getLogger("codeloom")


def chosen(names: list[str] | None, config: code.Config, effects: DataFrame) -> dict[str, dict]:
    """The detectors to run, with their parameters. Named ones run with defaults, whatever the settings say."""
    if names is not None:
        if unknown := set(names) - DETECTORS.keys():
            raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}")
        params = {n: {} for n in DETECTORS if n in names}
    else:
        params = {n: dict(config.detectors.get(n, {})) for n in DETECTORS if n not in config.disabled}
        for name, more in (("forbidden_import", {"rules": config.forbidden_imports}), ("boundary_violation", {"layers": config.layers, "allowed": config.allowed_imports})):
            if name in params:
                params[name] |= more
    if "pure_function_violation" in params:
        params["pure_function_violation"].setdefault("effects", effects)
    return params


def scan(facts: dict[str, Facts], params: dict[str, dict]) -> DataFrame:
    """All findings, as a written table. facts: those that each detector gets. A detector that fails, as it is planned or
    as it runs, is warned of and left out; the others are then run one by one."""
    planned = {}
    none = SparkSession.active().createDataFrame([], FINDINGS)
    for name, p in params.items():
        try:
            planned[name] = DETECTORS[name](facts[name], **p)
        except Exception as e:
            log.warning("detector %s failed: %s", name, e)
    try:
        return written(reduce(DataFrame.unionByName, planned.values(), none), "findings")
    except Exception:
        found = []
        for name, findings in planned.items():
            try:
                found.append(written(findings, "findings"))
            except Exception as e:
                log.warning("detector %s failed: %s", name, str(e).split("\n")[0])
        return reduce(DataFrame.unionByName, found, none)


def _facts(store: str | None, root: str):
    """Facts of files for detectors, and more: parsed here, or through a table of those kept by content."""

    def of(files: DataFrame, names: list[str], more: str = "") -> Facts:
        if store is None:
            return facts_for(files, names, root, more, keep=True)
        return Facts(written(kept_facts(files, store, " ".join([*(NEEDS[n] for n in names), more])), "facts"), root)

    return of


def loaded(name: str):
    """What "module:function" names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("path")
    p.add_argument("--output")
    p.add_argument("--format", choices=("md", "json"), default="md")
    p.add_argument("--detectors", help="names, with commas between them; all that the settings don't disable")
    p.add_argument("--diff", metavar="REF", help="only findings in files that differ from a git ref")
    p.add_argument("--effects", help="a dictionary of effects (TOML) in place of the built-in one")
    p.add_argument("--judge", "--ai-judge", default="none", metavar="MODULE:FUNCTION", help="asks a model: a function of (instructions, finding) that returns its text")
    p.add_argument("--rubric", help="a rubric (Markdown, ## N. Title) for the judge")
    p.add_argument("--facts", metavar="DIR", help="a table of facts by content: files that are in it aren't parsed again")
    p.add_argument("--verdicts", metavar="DIR", help="a table of the judge's verdicts: findings that are in it aren't asked about again")
    p.add_argument("--baseline-update", action="store_true")
    p.add_argument("--show-false-positives", action="store_true")
    p.add_argument("-v", "--verbose", action="count", default=0)
    args = p.parse_args(argv)
    logging.basicConfig(level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(args.verbose, 2)], format="%(levelname)s %(name)s: %(message)s")
    target = Path(args.path).resolve()
    if not target.exists():
        print(f"error: no such path: {target}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    only = None
    if args.diff:
        try:
            only = code.changed_files(target, args.diff)
        except (subprocess.CalledProcessError, OSError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
    config = code.load_config(target)
    effects = code.load_effects(spark, args.effects) if args.effects else code.own_effects(spark)
    try:
        params = chosen([n.strip() for n in args.detectors.split(",") if n.strip()] if args.detectors else None, config, effects)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    rubric = args.rubric or config.rubric
    rubric = Path(rubric).read_text(encoding="utf-8") if rubric else (Path(__file__).parent / "plans" / "rubric.md").read_text(encoding="utf-8")
    judge = None if args.judge == "none" else asking(loaded(args.judge), rubric)
    root = target if target.is_dir() else target.parent
    # Detectors of single files need only the files that changed; those of projects need all.
    project = [n for n in params if n in PROJECT]
    single = [n for n in params if n not in PROJECT]
    facts = _facts(args.facts, str(root))
    files = facts(code.read_code(spark, target, only), list(params) if only is None else single, "lines comments")
    whole = files if only is None or not project else facts(code.read_code(spark, target), project)
    findings = scan({n: whole if n in PROJECT else files for n in params}, params)
    if only is not None:
        changed = spark.createDataFrame([(f,) for f in sorted(only)], "file string")
        findings = findings.join(changed, "file", "left_semi").select(findings.columns)
    rel = F.expr(f"substring(file, {len(str(root)) + 2})")
    if args.baseline_update:
        accepted = written(baseline_of(findings, rel), "baseline")
        rows = accepted.orderBy(*accepted.columns).select(F.concat_ws("\t", *accepted.columns).alias("text"))
        head = "# accepted findings\n# detector, path, line, hash of detector and evidence\n# written by codeloom --baseline-update\n"
        save_text(rows, str(root / code.BASELINE_NAME), head=head, tail="\n", empty=head)
        print(f"{accepted.count()} findings accepted")
        return 0
    baseline = code.beside(target, code.BASELINE_NAME)
    left = unsuppressed(findings, inline_ignores(files.comments), code.load_baseline(spark, str(baseline)) if baseline else None, rel)
    left = with_excerpts(left, files.files)
    judged = written(with_verdicts(left, judge) if judge is None or not args.verdicts else verdicts_kept(left, judge, args.verdicts), "judged")
    with tempfile.TemporaryDirectory() as folder:
        out = args.output or f"{folder}/report"
        if args.format == "json":
            save_json(judged, out, list(DETECTORS))
        else:
            save_markdown(judged, out, args.show_false_positives)
        if not args.output:
            with open(out, encoding="utf-8") as text:
                shutil.copyfileobj(text, sys.stdout)
            print()
    return int(not judged.where("judge_verdict = 'real'").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
