"""Parameters of the pipelines."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Defaults of all operators. Built from keyword arguments, environment, or a YAML mapping, in this order."""

    llm_url: str = ""
    llm_model: str = ""
    llm_api_key: str = ""
    rerank_url: str = ""
    rerank_model: str = ""
    rerank_api_key: str = ""
    temperature: float = 0.0
    drop_params: bool = True
    max_retries: int = 3
    timeout: int = 60
    max_concurrent: int = 50
    max_context_items: int = 30
    max_signatures: int = 100
    max_variables: int = 30
    rerank_floor: float = 0.5
    rerank_gap: float = 0.15
    rerank_batch_size: int = 1000
    max_paragraph_length: int = 2000
    max_paragraph_tokens: int = 8000
    invalidate_on_code: bool = False
    least_score: float = 0.0  #: of a pair that is a link, where no model judges

    @classmethod
    def load(cls, root: str | Path = ".", **given: object) -> Config:
        """Settings of `root`: its YAML file, then environment variables, then `given`; unknown keys are ignored."""
        known = {f.name: type(f.default) for f in fields(cls)}
        values: dict[str, object] = {k: v for k, v in read_settings(root).items() if k in known}
        for name in known:
            if (v := os.environ.get(name.upper())) is not None:
                values[name] = v
        values |= {k: v for k, v in given.items() if k in known}

        def cast(kind: type, v: object) -> object:
            if kind is bool and isinstance(v, str):
                return v.strip().lower() in ("1", "true", "yes", "on")
            return kind(v)  # type: ignore[call-arg]

        return replace(cls(), **{k: cast(known[k], v) for k, v in values.items()})


#: Folder with settings and results inside a repository.
FOLDER = ".weftmark"


def settings_path(root: str | Path) -> Path | None:
    for p in (Path(root) / FOLDER / "config.yaml", Path(root) / "config.yaml"):
        if p.is_file() and isinstance(_yaml(p), dict):
            return p
    return None


def _yaml(path: Path) -> object:
    import yaml

    try:
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError):
        return None


def read_settings(root: str | Path) -> dict[str, object]:
    at = settings_path(root)
    return dict(_yaml(at) or {}) if at else {}  # type: ignore[call-overload]


def load_docs(path: str | Path) -> list[str]:
    """The scoped documents: a YAML list, or the `docs` of a mapping; otherwise none."""
    data = _yaml(Path(path)) if Path(path).is_file() else None
    docs = data.get("docs") if isinstance(data, dict) else data
    return [str(x) for x in docs] if isinstance(docs, list) else []


def save_docs(path: str | Path, docs: list[str]) -> None:
    """Writes the scoped documents, keeping the other settings of a mapping that is there."""
    import yaml

    from weftmark.sources.files import atomic_write

    old = _yaml(Path(path)) if Path(path).is_file() else None
    data = dict(old) if isinstance(old, dict) else {}
    data["docs"] = list(docs)
    atomic_write(Path(path), yaml.safe_dump(data, sort_keys=False, allow_unicode=True))
