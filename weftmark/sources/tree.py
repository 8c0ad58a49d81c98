"""File trees as a Spark data source, and the snapshots of a git repository."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftmark.sources.files import IgnoreTree

# Language of each extension.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}


class Folder(InputPartition):
    """One task: a folder, with all below it or only its own files."""

    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.root = Path(options["path"])
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)
        self.fold = options.get("ignorecase", "false") == "true"
        self.nested = options.get("nested", "true") == "true"
        self.content = options.get("content", "true") == "true"

    def partitions(self) -> list[Folder]:
        tree = IgnoreTree(self.root, self.nested)
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not tree.ignores(e.name, True))
        return [Folder("", False), *(Folder(t, True) for t in tops)]

    def read(self, part: Folder) -> Iterator[tuple]:
        tree = IgnoreTree(self.root, self.nested)
        for folder, dirs, names in os.walk(self.root / part.path):
            at = os.path.relpath(folder, self.root).replace(os.sep, "/")
            at = "" if at == "." else at
            dirs[:] = sorted(d for d in dirs if part.deep and not tree.ignores(f"{at}/{d}".lstrip("/"), True))
            for name in sorted(names):
                path = f"{at}/{name}".lstrip("/")
                shown = name.lower() if self.fold else name
                if (self.suffixes and not shown.endswith(self.suffixes)) or tree.ignores(path):
                    continue
                data = error = None
                if self.content:
                    try:
                        data = (self.root / path).read_bytes()
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
                yield path, data, error


class TreeSource(DataSource):
    """`filetree`: (file_path, content, error) of the files below `path` that no ignore file excludes.

    Options: `suffixes` (comma-separated), `ignoreCase` of them, `nested` ignore files, `content` false for
    names only. Hidden files and names that begin with an underscore are read like others. The folders below
    the root are the partitions. An unreadable file has an error instead of content.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "file_path string, content binary, error string"

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), **options: object) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("filetree").option("path", root).option("suffixes", ",".join(suffixes))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower())
    return reader.load()


def decoded(content: str = "content", errors: str = "ignore"):
    """UTF-8 text of a binary column; bad bytes are dropped, or replaced by U+FFFD with errors='replace'."""
    text = F.make_valid_utf8(F.col(content).cast("string"))
    if errors == "replace":
        return text
    return F.when(F.is_valid_utf8(F.col(content).cast("string")), text).otherwise(F.regexp_replace(text, "�", ""))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_file, text) of all Markdown files, in order; only the root's ignore file counts."""
    rows = read_tree(spark, root, (".md",), nested=False)
    return rows.where("error IS NULL").select(F.col("file_path").alias("doc_file"), decoded().alias("text")).orderBy("doc_file")


def code_files(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, signature, code, file_path) of whole code files; extensions are case-sensitive, root ignore file only."""
    rows = read_tree(spark, root, tuple(LANGUAGES), nested=False).where("error IS NULL")
    return rows.select(
        F.concat(F.lit("file:"), F.col("file_path")).alias("id"), F.element_at(F.split("file_path", "/"), -1).alias("name"),
        F.lit("").alias("signature"), decoded().alias("code"), "file_path",
    )


def symbol_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content, error) of the files to be searched for symbols: any case, nested ignore files too."""
    return read_tree(spark, root, tuple(LANGUAGES), ignoreCase=True)


def by_folder(files: DataFrame, path: str = "doc_file") -> DataFrame:
    """(folder, files) by top folder, files in order; those at the root are under `(root)`."""
    parts = F.split(path, "/")
    top = F.when(F.size(parts) > 1, parts[0]).otherwise("(root)")
    return files.groupBy(top.alias("folder")).agg(F.array_sort(F.collect_list(path)).alias("files"))


def existing(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """The scoped documents that are there."""
    return docs.join(listing.select("doc_file"), "doc_file", "left_semi")


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, check=True, timeout=600)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace")


def head_sha(root: str) -> str:
    """The commit that is checked out, or `unknown`."""
    return (_git(root, "rev-parse", "HEAD") or "unknown").strip()


def name_status(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """Lines (value) of the changes since `base`: up to the working tree for HEAD, else up to `head`."""
    spec = base if head == "HEAD" else f"{base}..{head}"
    out = _git(root, "-c", "core.quotePath=false", "diff", "--find-renames", "--name-status", "--relative", spec) or ""
    return spark.createDataFrame([(x,) for x in out.splitlines()], "value string")


def snapshot(spark: SparkSession, root: str, rev: str, paths: list[str]) -> DataFrame:
    """(file_path, content) of the given files at a revision; files that are not there are left out."""
    rows = [(p, text) for p in paths if (text := _git(root, "show", f"{rev}:./{p}")) is not None]
    return spark.createDataFrame(rows, "file_path string, content string")
