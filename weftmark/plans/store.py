"""Where results are kept: the map as one JSON file for people and tools, evaluations as JSON tables."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.config import FOLDER
from weftmark.operators import docmap
from weftmark.sources.files import atomic_write


def map_path(root: str | Path) -> Path:
    return Path(root) / FOLDER / "docmap.json"


def persist_json(rows: DataFrame, path: str | Path, codebase_sha: str = "") -> None:
    """The map as JSON in a stable order: documents, then sections by heading and chunk, then files.

    Default values (chunk 0, no hash, no commit) are left out. The file is for one repository and is written
    by the driver, a document at a time; for more than that keep `rows` as a table.
    """
    docs = []
    for r in docmap.build(rows).orderBy("doc_file").toLocalIterator():
        sections = []
        for s in r["sections"]:
            one = {"heading": s["heading"]}
            if s["chunk_index"]:
                one["chunk_index"] = s["chunk_index"]
            if s["hash"] is not None:
                one["hash"] = s["hash"]
            sections.append(one | {"files": list(s["files"])})
        docs.append({"doc_file": r["doc_file"], "sections": sections})
    head = {"codebase_sha": codebase_sha} if codebase_sha else {}
    atomic_write(Path(path), json.dumps(head | {"mappings": docs}, indent=2, ensure_ascii=False))


def load_json(spark: SparkSession, path: str | Path, strict: bool = True) -> tuple[DataFrame, str] | None:
    """The stored map, or None if there is none; broken JSON raises, or with `strict` off counts as none."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(data, dict) or not isinstance(data.get("mappings"), list):
            raise ValueError(f"{path} holds no map")
    except FileNotFoundError:
        return None
    except ValueError:
        if strict:
            raise
        return None
    return docmap.read_json(spark, str(path))


def save_eval(entries: DataFrame, root: str, kind: str, model: str, tokens: dict[str, int], enabled: bool = True) -> str | None:
    """Evaluation rows as JSON lines under runs/<kind>/<time>, with model and token counts beside each; or nothing."""
    if not enabled:
        return None
    at = f"{root.rstrip('/')}/runs/{kind}/{int(time.time())}"
    rows = entries.withColumn("model", F.lit(model))
    for name, n in tokens.items():
        rows = rows.withColumn(name, F.lit(int(n)))
    rows.write.mode("overwrite").json(at)
    return at
