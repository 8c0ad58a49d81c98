"""Symbols of code files as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.functions.symbols import extract
from weftmark.sources.tree import LANGUAGES

SYMBOLS = "file_path string, pos int, kind string, id string, qualified_id string, name string, signature string, code string"


def language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    return LANGUAGES.get("." + name.rsplit(".", 1)[-1]) if "." in name else None


def extracted(files: DataFrame, content: str = "content") -> DataFrame:
    """(file_path, pos, kind, id, qualified_id, name, signature, code) of `files(file_path, content)`.

    `kind` is symbol, variable (its text in `code`) or error (the reason in `code`). `id` is file and name, and
    repeats for methods of one name; `qualified_id` holds the class too. Files in other languages and null
    contents give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in pdf.itertuples(index=False, name=None):
                kind = language(path)
                if kind is None or data is None:
                    continue
                found = extract(data, kind)
                for n, s in enumerate(found.symbols):
                    out.append((path, n, "symbol", f"{path}::{s.name}", f"{path}::{s.label}", s.name, s.signature, s.code))
                for n, v in enumerate(found.variables):
                    out.append((path, n, "variable", None, None, None, None, v))
                if found.error:
                    out.append((path, 0, "error", None, None, None, None, found.error))
            yield pd.DataFrame(out, columns=["file_path", "pos", "kind", "id", "qualified_id", "name", "signature", "code"])

    return files.select("file_path", content).mapInPandas(run, SYMBOLS)


def symbols_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'symbol'").drop("kind")


def variables_of(rows: DataFrame) -> DataFrame:
    """(file_path, variables): the declarations of each file, in order."""
    lists = rows.where("kind = 'variable'").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_v"))
    return lists.select("file_path", F.transform("_v", lambda v: v["code"]).alias("variables"))
