"""Context for rewriting a section, guards on what comes back, and the report of a run."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from importlib.resources import files as resources

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions.text import lines_of, strip

#: What stands for the diff of a file without one.
NO_DIFF = "[No diff - files may be new or untracked]"


def prompts(name: str) -> dict[str, str]:
    import yaml

    return yaml.safe_load(resources("weftmark").joinpath("prompts", f"{name}.yaml").read_text(encoding="utf-8"))


def _filled(template: str, **columns: Column) -> Column:
    """A template with `{name}` replaced by columns, as one expression."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in columns if "{" + k + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        if at[0]:
            parts.append(F.lit(rest[: at[0]]))
        parts.append(columns[at[1]])
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def instruction(change_type: Column, path: Column, old_path: Column) -> Column:
    """What must be done about a deleted or renamed file; null for other changes."""
    text = prompts("batch")
    return F.when(change_type == "deleted", _filled(text["deleted"], path=path)).when(
        (change_type == "renamed") & old_path.isNotNull(), _filled(text["renamed"], old_path=old_path, new_path=path)
    )


def instructions(changes: Column) -> Column:
    """The instructions of an array of changes, parted by blank lines; null if there are none."""
    each = F.filter(F.transform(changes, lambda c: instruction(c["change_type"], c["path"], c["old_path"])), lambda x: x.isNotNull())
    return F.when(F.size(each) > 0, F.array_join(each, "\n\n"))


def unified_diffs(changes: DataFrame, base: DataFrame, head: DataFrame, context: int = 3) -> DataFrame:
    """(path, diff) of the distinct changed files; a renamed file is compared with what it was under its old name.

    A file without a difference gets a placeholder.
    """
    wanted = changes.select("path", F.coalesce("old_path", "path").alias("_old")).distinct()
    old = base.select(F.col("file_path").alias("_old"), F.col("content").alias("_before"))
    new = head.select(F.col("file_path").alias("path"), F.col("content").alias("_after"))
    pairs = wanted.join(old, "_old", "left").join(new, "path", "left").select("path", "_old", "_before", "_after")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, name, a, b in pdf.itertuples(index=False, name=None):
                lines = difflib.unified_diff(
                    lines_of(a or ""), lines_of(b or ""),
                    f"a/{name}" if a is not None else "/dev/null", f"b/{path}" if b is not None else "/dev/null", lineterm="", n=context,
                )
                out.append((path, "\n".join(lines) or NO_DIFF))
            yield pd.DataFrame(out, columns=["path", "diff"])

    return pairs.mapInPandas(run, "path string, diff string")


def diff_context(hits: DataFrame, diffs: DataFrame) -> DataFrame:
    """(doc_file, heading, diff_context): the diffs of a section's changes under their file names."""
    rows = hits.join(diffs.where(F.coalesce("diff", F.lit("")) != ""), "path")
    one = F.struct("path", F.concat(F.lit("[File: "), F.col("path"), F.lit("]\n"), F.col("diff")).alias("t"))
    return rows.groupBy("doc_file", "heading").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), "\n\n").alias("diff_context")
    )


def code_context(hits: DataFrame, signatures: DataFrame, most: int = 30) -> DataFrame:
    """(doc_file, heading, code_context): up to `most` signatures of each changed file that still has some.

    `signatures(file_path, signatures)` is a list per file.
    """
    listed = F.array_join(F.transform(F.slice("signatures", 1, most), lambda s: F.concat(F.lit("\n- "), s)), "")
    per = signatures.where(F.size("signatures") > 0).select(F.col("file_path").alias("path"), F.concat(F.lit("[File: "), F.col("file_path"), F.lit("]"), listed).alias("_t"))
    rows = hits.join(per, "path")
    return rows.groupBy("doc_file", "heading").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "_t"))), lambda s: s["_t"]), "\n\n").alias("code_context")
    )


def rewrite_prompt(heading: Column, text: Column, diff: Column, code: Column, explicit: Column) -> Column:
    """The request to a rewriting model; blank contexts leave no header."""

    def part(title: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f"\n\n### {title}\n"), c))

    return _filled(
        prompts("rewriter")["user"], heading=heading, current_text=text,
        context_section=F.concat(part("Code Changes (Git Diff)", diff), part("Current Code", code)),
        explicit_section=part("Required Changes", explicit),
    )


def accepted(heading: Column, original: Column, new: Column, growth: float = 1.5) -> Column:
    """The text to keep of what a rewriter returned.

    Null, empty and blank answers, answers that differ only in white space at line ends and blank lines, and
    answers longer than `growth` times the original keep the original; a repeated heading line is dropped.
    """
    text = strip(F.coalesce(new, F.lit("")))
    lines = F.split(text, r"\r\n|\r|\n")
    first = strip(F.regexp_replace(strip(lines[0]), r"^#+", ""))
    rest = F.regexp_replace(text, r"^[^\n]*\n?", "")
    body = F.when(first == heading, strip(rest)).otherwise(text)

    def plain(c: Column) -> Column:
        some = F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
        return F.array_join(some, "\n")

    too_long = F.length(body) > F.length(original) * F.lit(growth)
    return F.when((text == "") | (plain(body) == plain(original)) | too_long, original).otherwise(body)


def changed(old: Column, new: Column) -> Column:
    return strip(new) != strip(old)


def reason(action: Column, change_type: Column) -> Column:
    # The reasons that reports of a run give.
    return (
        F.when(action != "rewrite", "No changes needed")
        .when(change_type == "deleted", "File deleted — removed references from section")
        .when(change_type == "renamed", "File renamed — section reviewed/rewritten")
        .otherwise("Code changes — section rewritten")
    )


def sync_results(hits: DataFrame, outcome: DataFrame) -> DataFrame:
    """(doc_file, heading, file_path, action, reason, error): a row per change of a section.

    `outcome(doc_file, heading, action, error)` has what became of each section; an error's reason is its text.
    """
    rows = hits.join(outcome, ["doc_file", "heading"])
    why = F.when(F.col("action") == "error", F.coalesce("error", F.lit("unknown error"))).otherwise(reason(F.col("action"), F.col("change_type")))
    return rows.select("doc_file", "heading", F.col("path").alias("file_path"), "action", why.alias("reason"), "error")


def sync_report(results: DataFrame) -> DataFrame:
    """One row: results, rewrites and errors counted."""
    return results.agg(
        F.count("*").alias("results"), F.count_if(F.col("action") == "rewrite").alias("rewrites"), F.count_if(F.col("action") == "error").alias("errors")
    )
