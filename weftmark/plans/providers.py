"""Models behind the pipelines: scorers, judges and rewriters, each with a deterministic default."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.config import Config
from weftmark.functions.text import basename
from weftmark.operators.incremental import KEY
from weftmark.operators.retrieval import lexical_scores, rerank_document, rerank_query
from weftmark.operators.rewriting import _filled, prompts, rewrite_prompt


class Scorer(Protocol):
    """Scores `sections(KEY, content)` against `files(file_path, text, signatures, variables)`."""

    def scores(self, sections: DataFrame, files: DataFrame, cfg: Config) -> DataFrame:
        """(KEY, file_path, score); pairs without a row score 0. A remote scorer adds `tokens` and `error`: a request
        that failed is a row with an error and without a file."""
        ...

    def failed(self, sections: DataFrame, scores: DataFrame) -> DataFrame | None:
        """(KEY) of the sections that could not be scored at all, or None if that can't happen."""
        ...


class Judge(Protocol):
    """Decides on candidate pairs (KEY, content, file_path, score, signatures, variables)."""

    def judge(self, pairs: DataFrame, cfg: Config) -> DataFrame:
        """(KEY, target_id, is_match, status): status is ok or error; an error is no match. A remote judge adds
        `reasoning`, `input_tokens` and `output_tokens`."""
        ...


class Rewriter(Protocol):
    """Rewrites sections (doc_file, heading, content, diff_context, code_context, explicit)."""

    def rewrite(self, sections: DataFrame, cfg: Config) -> DataFrame:
        """(doc_file, heading, content, new_text, error)."""
        ...


@dataclass(frozen=True)
class LexicalScorer:
    """The share of a section's words (letters, digits and underscores) that a file holds, by an equi-join on words."""

    words: int = 1

    def scores(self, sections: DataFrame, files: DataFrame, cfg: Config) -> DataFrame:
        def words(c):
            return F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ").alias("text")

        q = sections.select(F.struct(*KEY).alias("_key"), words(F.concat_ws(" ", "heading", "content")))
        got = lexical_scores(q, files.select("file_path", words(F.col("text"))), "_key", "file_path", n=self.words)
        return got.select("_key.*", "file_path", "score")

    def failed(self, sections: DataFrame, scores: DataFrame) -> None:
        return None


@dataclass(frozen=True)
class ThresholdJudge:
    """TRUE for pairs of at least this score; without a score, FALSE."""

    least: float = 0.0

    def judge(self, pairs: DataFrame, cfg: Config) -> DataFrame:
        match = F.coalesce(F.col("score") >= F.lit(float(self.least)), F.lit(False))
        return pairs.select(*KEY, F.concat(F.lit("file:"), F.col("file_path")).alias("target_id"), match.alias("is_match"), F.lit("ok").alias("status"))


@dataclass(frozen=True)
class RenamingRewriter:
    """Puts the new names of renamed files into a section, and takes out the lines that name deleted ones."""

    def rewrite(self, sections: DataFrame, cfg: Config) -> DataFrame:
        text = F.aggregate(
            "changes", F.coalesce("content", F.lit("")),
            lambda t, c: F.when(c["change_type"] == "renamed", F.replace(t, c["old_path"], c["path"]))
            .when(
                c["change_type"] == "deleted",
                F.array_join(F.filter(F.split(t, "\n"), lambda line: ~F.contains(line, c["path"])), "\n"),
            )
            .otherwise(t),
        )
        return sections.select("doc_file", "heading", "content", text.alias("new_text"), F.lit(None).cast("string").alias("error"))


def with_retries(call: Callable[[], dict], attempts: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Repeats a call after connection errors, timeouts, rate limits and server errors: waits 2, 4, 8, then 10 s."""
    for n in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if n + 1 == attempts or (e.code not in (408, 409, 425, 429) and e.code < 500):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if n + 1 == attempts:
                raise
        sleep(min(2.0 * 2**n, 10.0))
    raise ValueError("no attempt was allowed")


def post(url: str, key: str, body: dict, timeout: float) -> dict:
    data = json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def chat(
    url: str, cfg: Config, system: str, user: str, timeout: float | None = None, schema: dict | None = None, sleep: Callable[[float], None] = time.sleep
) -> tuple[str, int, int]:
    """(answer, input tokens, output tokens) of a chat completion; with `schema`, the answer is asked for as such JSON.

    A server that rejects temperature or schema is asked again without them if `cfg.drop_params` is set.
    """
    body = {"model": cfg.llm_model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
    more: dict = {"temperature": cfg.temperature}
    if schema:
        more["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}

    def ask(body: dict) -> dict:
        return with_retries(lambda: post(url, cfg.llm_api_key, body, timeout or cfg.timeout), cfg.max_retries, sleep)

    try:
        got = ask(body | more)
    except urllib.error.HTTPError as e:
        if e.code not in (400, 422) or not cfg.drop_params:
            raise
        got = ask(body)
    usage = got.get("usage") or {}
    return got["choices"][0]["message"]["content"], int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0)


def side_by_side(df: DataFrame, cfg: Config) -> tuple[DataFrame, int]:
    """`df` spread over tasks, and the requests each task may have open, so that all have `cfg.max_concurrent` at most."""
    tasks = max(1, min(cfg.max_concurrent, df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(tasks), max(1, cfg.max_concurrent // tasks)


def asked(width: int, ask: Callable[[dict], list[tuple]], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that asks for each row, `width` at a time, and returns the answers' rows in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(width) as pool:
            for pdf in parts:
                rows = [r for some in pool.map(ask, pdf.to_dict("records")) for r in some]
                yield pd.DataFrame(rows, columns=columns)

    return run


#: Characters of files' texts that are sent to every task; more are joined by batch.
SENT = 32_000_000


@dataclass(frozen=True)
class RemoteScorer:
    """A re-ranking service. All changed sections meet all files, `cfg.rerank_batch_size` files a request."""

    url: str
    paid = True

    def scores(self, sections: DataFrame, files: DataFrame, cfg: Config) -> DataFrame:
        doc = rerank_document(F.col("file_path"), F.col("signatures"), F.col("variables"), cfg.max_signatures, cfg.max_variables)
        docs = files.select("file_path", doc.alias("doc"))
        size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("doc")), F.lit(0)).alias("chars")).first()
        n = max(1, -(-size["n"] // cfg.rerank_batch_size))
        numbered = docs.withColumn("_b", F.pmod(F.xxhash64("file_path"), F.lit(n)))
        batches = numbered.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("file_path", "doc"))).alias("docs"))
        if size["chars"] <= SENT:
            batches = F.broadcast(batches)
        # one row per section and batch, which the files of the batch are joined to by its number
        wanted = sections.select(*KEY, rerank_query(F.col("heading"), F.col("doc_file"), F.col("content")).alias("query"))
        wanted, width = side_by_side(wanted.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))), cfg)
        rows, url = wanted.join(batches, "_b").select(*KEY, "query", "docs"), self.url

        def ask(r: dict) -> list[tuple]:
            docs, key, out = list(r["docs"]), [r[k] for k in KEY], []
            for at in range(0, len(docs), cfg.rerank_batch_size):
                some = docs[at : at + cfg.rerank_batch_size]
                body = {"model": cfg.rerank_model, "query": r["query"], "documents": [d["doc"] for d in some], "top_n": len(some)}
                try:
                    got = with_retries(lambda b=body: post(url, cfg.rerank_api_key, b, cfg.timeout), cfg.max_retries)
                    found = [(*key, some[x["index"]]["file_path"], float(x["relevance_score"]), 0, None) for x in got["results"]]
                    usage = got.get("usage") or (got.get("meta") or {}).get("tokens") or {}
                    tokens = int(usage.get("total_tokens") or sum(int(v or 0) for k, v in usage.items() if k in ("input_tokens", "output_tokens", "prompt_tokens", "completion_tokens")))
                    out += found + [(*key, None, None, tokens, None)] if tokens else found
                except (OSError, KeyError, IndexError, TypeError, ValueError) as e:
                    out.append((*key, None, None, 0, f"{type(e).__name__}: {e}"))
            return out

        schema = "doc_file string, heading string, chunk_index int, file_path string, score double, tokens bigint, error string"
        columns = [*KEY, "file_path", "score", "tokens", "error"]
        return rows.mapInPandas(asked(width, ask, columns), schema)

    def failed(self, sections: DataFrame, scores: DataFrame) -> DataFrame:
        """Sections without any score, and those of which a request failed: what it would have found isn't known."""
        good = scores.where("file_path IS NOT NULL").select(*KEY).distinct()
        lost = scores.where("error IS NOT NULL").select(*KEY).distinct()
        keys = sections.select(*KEY).distinct()
        return keys.join(good.join(lost, list(KEY), "left_anti"), list(KEY), "left_anti")


#: What a judging model is asked to answer.
VERDICT = {
    "type": "object",
    "properties": {"is_match": {"type": "boolean"}, "reasoning": {"type": "string"}},
    "required": ["is_match", "reasoning"],
}


def verdict(answer: str) -> tuple[bool, str]:
    """(is match, reasoning) of an answer in JSON, or one that begins with TRUE or FALSE; of any other, ValueError."""
    try:
        got = json.loads(answer)
        if isinstance(got, dict) and isinstance(got.get("is_match"), bool):
            return got["is_match"], str(got.get("reasoning") or "")
    except ValueError:
        pass
    m = re.match(r"\W*(true|false)\b\W*", answer, re.I)
    if not m:
        raise ValueError("neither TRUE nor FALSE")
    return m[1].lower() == "true", answer[m.end() :].strip()


@dataclass(frozen=True)
class RemoteJudge:
    """A chat model that answers TRUE or FALSE for each pair, with its reasoning."""

    url: str
    paid = True

    def judge(self, pairs: DataFrame, cfg: Config) -> DataFrame:
        text = prompts("classification")
        none = F.array().cast("array<string>")

        def block(title: str, items, n: int):
            some = F.slice(F.coalesce(items, none), 1, n)
            return F.when(F.size(some) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(some, lambda s: F.concat(F.lit("  "), s)), "\n")))

        target = F.concat_ws("\n", F.concat(F.lit("File: "), F.col("file_path")), block("Signatures", F.col("signatures"), cfg.max_signatures), block("Variables", F.col("variables"), cfg.max_variables))
        user = _filled(
            text["user"], source_type=F.concat(F.lit("Documentation from "), basename(F.col("doc_file"))),
            source_content=F.concat("heading", F.lit("\n\n"), F.coalesce("content", F.lit(""))), target_type=F.lit("Code"), target_content=target,
        )
        url, system = self.url, text["system"]

        def ask(r: dict) -> list[tuple]:
            used = (0, 0)
            try:
                answer, *used = chat(url, cfg, system, r["user"], schema=VERDICT)
                match, why, status = *verdict(answer), "ok"
            except (OSError, KeyError, IndexError, TypeError, ValueError) as e:
                match, why, status = False, f"{type(e).__name__}: {e}", "error"
            return [(*(r[k] for k in KEY), "file:" + r["file_path"], match, status, why, *used)]

        rows, width = side_by_side(pairs.select(*KEY, "file_path", user.alias("user")), cfg)
        columns = [*KEY, "target_id", "is_match", "status", "reasoning", "input_tokens", "output_tokens"]
        schema = "doc_file string, heading string, chunk_index int, target_id string, is_match boolean, status string, reasoning string, input_tokens bigint, output_tokens bigint"
        return rows.mapInPandas(asked(width, ask, columns), schema)


@dataclass(frozen=True)
class RemoteRewriter:
    """A chat model that returns the new text of a section."""

    url: str
    paid = True

    def rewrite(self, sections: DataFrame, cfg: Config) -> DataFrame:
        user = rewrite_prompt(F.col("heading"), F.col("content"), F.col("diff_context"), F.col("code_context"), F.col("explicit"))
        url, system = self.url, prompts("rewriter")["system"]

        def ask(r: dict) -> list[tuple]:
            new, error, used = None, None, (0, 0)
            try:
                new, *used = chat(url, cfg, system, r["user"])
            except (OSError, KeyError, IndexError, TypeError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
            return [(r["doc_file"], r["heading"], r["content"], new, error, *used)]

        rows, width = side_by_side(sections.select("doc_file", "heading", "content", user.alias("user")), cfg)
        columns = ["doc_file", "heading", "content", "new_text", "error", "input_tokens", "output_tokens"]
        schema = "doc_file string, heading string, content string, new_text string, error string, input_tokens bigint, output_tokens bigint"
        return rows.mapInPandas(asked(width, ask, columns), schema)


def chosen_models(cfg: Config) -> tuple[Scorer, Judge, Rewriter]:
    """The remote models that the settings name by URL, and the deterministic ones in place of those they don't."""
    return (
        RemoteScorer(cfg.rerank_url) if cfg.rerank_url else LexicalScorer(),
        RemoteJudge(cfg.llm_url) if cfg.llm_url else ThresholdJudge(cfg.least_score),
        RemoteRewriter(cfg.llm_url) if cfg.llm_url else RenamingRewriter(),
    )


def token_sums(answers: DataFrame, *columns: str) -> dict[str, int]:
    """The sums of the token columns that the answers have; 0 for one they lack, as deterministic models use none."""
    have = [c for c in columns if c in answers.columns]
    sums = answers.agg(*[F.sum(c).alias(c) for c in have]).first().asDict() if have else {}
    return {c: int(sums.get(c) or 0) for c in columns}
