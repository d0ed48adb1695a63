"""Reports: Markdown, JSON, a summary; verdicts. Reports are rows of text, in order, for sources/text.py to write."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import exists, written
from ..sources.text import save_text

VERDICTS = ("real", "borderline", "false_positive", "unjudged")
RANK = "array_position(array('high', 'medium', 'low', 'info'), severity)"


def with_verdicts(findings: DataFrame, judge: Callable[[dict], dict] | None = None) -> DataFrame:
    """findings with judge_verdict, judge_reasoning and judge_recommendation. judge gets one finding and returns these
    three; what it can't judge, or answers with another verdict, stays unjudged with the reason. None: all unjudged."""
    plain = findings.withColumns({"judge_verdict": F.lit("unjudged"), "judge_reasoning": F.lit(""), "judge_recommendation": F.lit("")})
    if judge is None:
        return plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                try:
                    answer = judge(dict(row))
                    if answer.get("judge_verdict") not in VERDICTS:
                        raise ValueError(f"unknown verdict {answer.get('judge_verdict')!r}")
                    row |= {k: answer.get(k) or "" for k in ("judge_verdict", "judge_reasoning", "judge_recommendation")}
                except Exception as e:  # a judge is someone else's code: one failure is one unjudged finding
                    row["judge_reasoning"] = f"not judged: {e}"
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return plain.mapInArrow(run, plain.schema)


VERDICT = "key string, judge_verdict string, judge_reasoning string, judge_recommendation string"


def verdicts_kept(findings: DataFrame, judge: Callable[[dict], dict], store: str, at_once: int = 500) -> DataFrame:
    """with_verdicts() through a table at `store`: verdicts by hash of what the judge sees. Only findings without one are
    asked about, equal ones once, about at_once at a time; each time's answers are added to the table, so what a lost
    task, a later failure or another run asks again is less than that. Failed answers are kept with their reason and
    asked again next time."""
    spark = findings.sparkSession
    seen = [c for c in findings.columns if c != "measure"]
    key = F.sha2(F.to_json(F.struct(*seen), {"ignoreNullFields": "false"}), 256)
    keyed = written(findings.withColumn("key", key), "findings")
    todo = keyed.dropDuplicates(["key"])
    if exists(spark, store):
        todo = todo.join(spark.read.schema(VERDICT).parquet(store).where("judge_verdict <> 'unjudged'"), "key", "left_anti")
    todo = written(todo, "unasked")
    times = -(-todo.count() // at_once)
    for nth in range(times):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(times)) == nth)
        with_verdicts(part, judge).select(*[c.split()[0] for c in VERDICT.split(", ")]).write.mode("append").parquet(store)
    known = spark.createDataFrame([], VERDICT) if not exists(spark, store) else spark.read.schema(VERDICT).parquet(store)
    answer = F.struct(*[F.col(c.split()[0]) for c in VERDICT.split(", ")[1:]])
    best = known.groupBy("key").agg(F.max_by(answer, F.col("judge_verdict") != "unjudged").alias("answer")).select("key", "answer.*")
    return keyed.join(best, "key", "left").drop("key").withColumns({"judge_verdict": F.coalesce("judge_verdict", F.lit("unjudged"))})


def asking(ask: Callable[[str, str], str], rubric: str) -> Callable[[dict], dict]:
    """A judge for with_verdicts() that asks a model: ask gets what stays the same (the task and the whole rubric, which
    can be cached) and what is of one finding, and returns text with a JSON object in it."""
    sections = rubric_sections(rubric)
    same = f"{TASK}\n\n{rubric}\n\n{ANSWER}"

    def judge(finding: dict) -> dict:
        if finding["rubric_ref"] not in sections:
            raise ValueError(f"the rubric has no section {finding['rubric_ref']}")
        text = ask(same, prompt(finding))
        answer = tolerant_json(text)
        if answer is None:
            raise ValueError(f"no JSON in the answer: {text[:200]}")
        return {f"judge_{k}": answer.get(k) for k in ("verdict", "reasoning", "recommendation")}

    return judge


def tolerant_json(text: str) -> dict | None:
    """A JSON object, or the part of a text from its first { to its last }."""
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


#: What a judge is told for all findings, before and after the rubric.
TASK = """You review findings of a static checker of software design. Say whether a finding is a problem ("real"), open to
argument ("borderline") or noise of the checker's rule ("false_positive"), judged by the section of the rubric that the
finding names and by nothing else, and what to do about it. The rubric:"""
ANSWER = """Answer with one JSON object only: "verdict" (real, borderline or false_positive), "reasoning" (one sentence that
refers to the rubric), "recommendation" (two to four sentences that name what to change; empty for a false_positive)."""


def prompt(finding: dict) -> str:
    """What a judge is asked about one finding."""
    excerpt = finding.get("code_excerpt") or "(no excerpt)"
    return f"Section {finding['rubric_ref']} applies.\n\n{finding['file']}:{finding['line']}\n\n{excerpt}\n\n{finding['detector']}: {finding['title']}\n{finding['evidence']}\n"


def rubric_sections(text: str) -> dict[str, str]:
    """A rubric's sections by number: each runs from its `## N. Title` to the next such header."""
    parts = re.split(r"(?m)^##\s+(\d+)\.\s", text)
    return {n: f"## {n}. {body}".rstrip() for n, body in zip(parts[1::2], parts[2::2])}


def summary(findings: DataFrame) -> DataFrame:
    """By detector: total, and how many are real, borderline and unjudged."""
    count = lambda v: F.count_if(F.col("judge_verdict") == v).alias(v)
    return findings.groupBy("detector").agg(F.count("*").alias("total"), *map(count, ("real", "borderline", "unjudged"))).orderBy("detector")


def excerpt(lines: str, line: str, end_line: str, context: int = 5):
    """The lines around a finding, numbered, those of the finding marked >>."""
    end = F.coalesce(end_line, line)
    first = F.greatest(F.col(line) - context, F.lit(1))
    marked = F.transform(F.slice(lines, first, end + context - first + 1), lambda x, i: F.rtrim(F.format_string("%s %4d  %s", F.when((first + i).between(F.col(line), end), ">>").otherwise("  "), first + i, x)))
    return F.array_join(marked, "\n")


def with_excerpts(findings: DataFrame, files: DataFrame, most: int = 30, context: int = 1) -> DataFrame:
    """findings with code_excerpt: their lines, `most` at most, with some around them; '' where the file isn't there.
    files: path, lines. Lines meet only the findings that are left, so this comes last."""
    lines = files.select(F.col("path").alias("file"), "lines")
    end = F.least(F.coalesce("end_line", "line"), F.col("line") + most)
    shown = findings.join(lines, "file", "left").withColumn("__end", end)
    return shown.withColumn("code_excerpt", F.coalesce(excerpt("lines", "line", "__end", context), F.lit(""))).drop("lines", "__end")


#: The published fields of a finding, in their order.
PUBLISHED = ("file", "line", "detector", "title", "evidence", "rubric_ref", "rubric_title", "severity", "end_line", "code_excerpt", "judge_verdict", "judge_reasoning", "judge_recommendation")


def json_rows(findings: DataFrame, order: list[str]) -> DataFrame:
    """text of each finding, in the order of detectors, then file and line."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("detector"))
    rows = findings.orderBy(place, "file", "line", "evidence").select(*[c for c in PUBLISHED if c in findings.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(row, indent=2).replace("\n", "\n  ") for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"  {t}" for t in texts], pa.string())], ["text"])

    return rows.mapInArrow(run, "text string")


def markdown_rows(findings: DataFrame) -> DataFrame:
    """Lines of the summary, then a section for each detector, as text in order."""
    column = lambda *c: F.concat_ws(" | ", *c)
    text = F.concat(F.lit("| "), column("detector", "total", "real", "borderline", "unjudged"), F.lit(" |"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    key = lambda part, kind, rank=zero, file=none, line=zero, evidence=none: [F.lit(part).alias("part"), "detector", F.lit(kind).alias("kind"), rank.alias("rank"), file.alias("file"), line.alias("at"), evidence.alias("evidence")]
    lines = summary(findings).select(*key(0, 0), text.alias("text"))
    rank, shown = F.expr(RANK).cast("int"), findings.where("shown")
    first = shown.groupBy("detector").agg(F.min_by("title", F.struct(rank, "file", "line", "evidence")).alias("title"))
    title = F.concat(F.lit("\n## "), F.substring_index("title", ":", 1), F.lit(" ("), "detector", F.lit(")\n"))
    heads = first.select(*key(1, 0), title.alias("text"))
    end = F.when((F.col("end_line") != 0) & (F.col("end_line") != F.col("line")), F.concat(F.lit("-"), "end_line"))
    said = F.when(F.col("judge_verdict") != "unjudged", F.concat(F.lit(" ("), "judge_verdict", F.lit(": "), "judge_reasoning", F.lit(")")))
    item = F.concat(F.lit("- **"), "severity", F.lit("** `"), "file", F.lit(":"), "line", F.coalesce(end, F.lit("")), F.lit("` "), "evidence", F.coalesce(said, F.lit("")))
    items = shown.select(*key(1, 1, rank, F.col("file"), F.col("line"), F.col("evidence")), item.alias("text"))
    return lines.unionByName(heads).unionByName(items).orderBy("part", "detector", "kind", "rank", "file", "at", "evidence").select("text")


def save_json(findings: DataFrame, path: str, order: list[str]) -> None:
    save_text(json_rows(findings, order), path, head="[\n", separator=",\n", tail="\n]", empty="[]")


def save_markdown(findings: DataFrame, path: str, show_false: bool = False) -> None:
    """Findings by detector under a summary of all; false positives are left out unless they are asked for."""
    marked = findings.withColumn("shown", F.lit(True) if show_false else F.col("judge_verdict") != "false_positive")
    marked = marked if not marked.where("shown").isEmpty() else marked.where("false")
    head = "| detector | total | real | borderline | unjudged |\n|-|-|-|-|-|\n"
    save_text(markdown_rows(marked), path, head=head, tail="\n", empty="_No findings._\n")
