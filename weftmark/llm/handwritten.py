"""Generated, minified, third-party and data files among source code: linear support-vector classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.session import stored

RAW, SHAPE, PATH, COPIES, HEADER = 2048, 2048, 1024, 4, 4096
#: Sizes of a path component and of the number of copies, beside n-gram views of length 1 and 1.5.
PATH_SCALE, COPIES_SCALE = 2.0, 3.0

#: Repositories are split into so many folds, by hash; regularisation is chosen among these.
FOLDS, REGULARISATION = 5, (1e-1, 3e-2, 1e-2)

# What tools and licences commonly write into a file's header, words that take such a remark back, and
# folders and endings that commonly hold other people's or tools' files. They label the training sample, each for a
# classifier that doesn't see it.
BANNER = re.compile(
    r"@generated\b|auto(matically)?[- ]?generated|machine[- ](written|generated|made)|generated (by|from|with|file|code)|"
    r"do(n't| not) (edit|modify|change)|(regenerate|produced|emitted|written|built) (with|by|from)\b|"
    r"generad[oa] por|no (editar|modificar)|(erzeugt|generiert) (von|aus|durch)|nicht (bearbeiten|ändern)|généré (par|depuis)|ne pas modifier",
    re.I,
)
NOTICE = re.compile(
    r"copyright|\(c\) ?\d{4}|©|licen[cs]ed? under|SPDX-License-Identifier|all rights reserved|\bupstream\b|third[- ]party|"
    r"(vendored|copied|imported|taken) .{0,20}from\b",
    re.I,
)
REMARK = re.compile(r"\b(not generated|no longer|never|once|was|were|used to|by hand|internal|instead|replaces|our own)\b", re.I)
FOREIGN = re.compile(r"(^|/)(node_modules|site-packages|_?vendor|third_?party|3rdparty|external|deps|bower_components|\.venv)/", re.I)
MADE = re.compile(r"(^|/)(__generated__|autogen|generated)/|\.min\.[jt]sx?$|\.(gen|generated|pb)\.\w+$|_pb2\.py$", re.I)

_LEGAL = re.compile(r"licen[cs]e|copyright|\(c\)|generated|@\w|upstream (release|archive)|unchanged|imported from|do not", re.I)
_COMMENT = re.compile(r"\s*(#|//|/\*|\*|<!--|--\s)")
_LITERAL = re.compile(r"`[^`]*`|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b(?:0x[0-9a-f]+|\d[\d.e+-]*)\b", re.I)
_WORDS = re.compile(r"\b(?:def|class|return|import|function|if|for|while|const|let|await|try|self|this)\b")

#: Kinds of bytes for the shape view: runs of letters, digits and so on look alike whatever they say.
_KIND = np.full(256, 15, np.uint32)
for _i, _group in enumerate(("\n", " \t", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "_", "\"'`", "([{", ")]}", ",;", ".:", "=<>", "+-*/%&|^!~?", "#@$\\")):
    _KIND[[ord(_c) for _c in _group]] = _i


def _lines(code: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", code)


def parts(code: str) -> tuple[str, str]:
    """(header, masked code) of a file.

    The header is the comment lines at its top and in its last three lines; the masked code is the rest.
    """
    lines = _lines(code)
    top = 0
    while top < len(lines) and (not lines[top].strip() or _COMMENT.match(lines[top])):
        top += 1
    for quotes in ('"""', "'''"):  # a banner may stand in a documentation string
        if top < len(lines) and lines[top].lstrip().startswith(quotes):
            end = top
            while end < len(lines) and lines[top : end + 1] and "".join(lines[top : end + 1]).count(quotes) < 2:
                end += 1
            if BANNER.search("\n".join(lines[top : end + 1])) or NOTICE.search("\n".join(lines[top : end + 1])):
                top = end + 1
    low = max(top, len(lines) - 3)
    first = lines[:top]
    if "/**" in "".join(first) and not _LEGAL.search("\n".join(first)):
        first = []  # a documentation comment describes the code, whoever wrote it
    header = first + [x for x in lines[low:] if _COMMENT.match(x)]
    masked = lines[top:low] + [x for x in lines[low:] if not _COMMENT.match(x)]
    return "\n".join(x.strip() for x in header if x.strip()), "\n".join(masked)


def body_of(code: Column, path: Column) -> Column:
    """A digest of all that is neither comment nor white space, whose equality makes files copies of one another."""
    plain = F.regexp_replace(code, r"(?m)^[^\S\r\n]*(?:#|//|/\*|\*|<!--|--\s|\"{3}|'{3})[^\r\n]*", "")
    bare = F.regexp_replace(plain, r"\s+", "")
    return F.sha2(F.when(bare != "", bare).otherwise(F.concat(F.lit("path:"), path)), 256)


@dataclass(frozen=True)
class Evidence:
    """What speaks for a file's label: header lines, its place, its layout; and whether it reads like code."""

    said: bool
    placed: bool
    laid: bool
    written: bool


def evidence(path: str, header: str, masked: str) -> Evidence:
    said = any((BANNER.search(x) or NOTICE.search(x)) and not REMARK.search(x) for x in header.split("\n"))
    placed = bool(FOREIGN.search(path) or MADE.search(path))
    n = max(1, len(masked))
    words = len(_WORDS.findall(masked)) * 100 / n
    dense = max(1, len(re.sub(r"[\s,;]+", "", masked)))
    long = sum(len(x) for x in masked.split("\n") if len(x) > 300) > 0.8 * n
    data = n > 400 and words < 0.2 and sum(len(re.sub(r"[\s,;]+", "", x)) for x in _LITERAL.findall(masked)) > 0.75 * dense
    return Evidence(said, placed, long or data, words > 0.4)


def _grams(b: np.ndarray, n: int, bits: int, size: int) -> np.ndarray:
    """Hashed counts of n-grams, square roots scaled to length 1."""
    if len(b) < n:
        return np.zeros(size, np.float32)
    h = b[: len(b) - n + 1].astype(np.uint32)
    for i in range(1, n):
        h = (h << np.uint32(bits)) ^ b[i : len(b) - n + 1 + i]
    h = (h * np.uint32(2654435761)) >> np.uint32(32 - size.bit_length() + 1)
    v = np.sqrt(np.bincount(h, minlength=size).astype(np.float32))
    return v / np.linalg.norm(v)


def content_features(path: str, masked: str) -> np.ndarray:
    """Character 4-grams, 6-grams of character kinds, and path components without the repository."""
    b = np.frombuffer(masked.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(RAW + SHAPE + PATH, np.float32)
    out[:RAW] = _grams(b.astype(np.uint32), 4, 8, RAW)
    out[RAW : RAW + SHAPE] = 1.5 * _grams(_KIND[b], 6, 4, SHAPE)
    folders = path.lower().split("/")[1:]
    for name in [*folders[:-1], *["." + x for x in folders[-1].split(".")[1:]]] if folders else []:
        out[RAW + SHAPE + zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATH] = PATH_SCALE
    return out


def header_features(header: str) -> np.ndarray:
    """Word pairs and character 5-grams of the header's lines, without digits and quoted names."""
    out = np.zeros(HEADER, np.float32)
    text = re.sub(r"`[^`]*`", "`", re.sub(r"\d+", "0", header.lower()))
    for line in text.split("\n"):
        words = re.findall(r"[^\W\d_]+|@\w+|[<(!/*#]+", line)
        for g in [*words, *zip(words, words[1:]), *(line[i : i + 5] for i in range(len(line) - 4))]:
            out[zlib.crc32(repr(g).encode("utf-8", "surrogatepass")) % HEADER] = 1
    n = np.linalg.norm(out)
    return out / n if n else out


def fit_svm(gram: np.ndarray, y: np.ndarray, reg: float, rounds: int = 30) -> np.ndarray:
    """Coefficients of the rows in a linear support-vector machine (squared hinge loss, classes weighted alike).

    Newton's method on the products of rows: with the rows inside the margin known, the rest is a linear system;
    it is solved anew until those rows stay the same. The weights are the rows added up by their coefficients.
    """
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    inside, beta = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(rounds):
        at = np.flatnonzero(inside)
        beta = np.zeros(len(y))
        beta[at] = np.linalg.solve(gram[np.ix_(at, at)] + np.diag(reg / (2 * cost[at])), y[at])
        now = y * (gram @ beta) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return beta


@dataclass
class Model:
    """Weights of both classifiers; the accuracy of each on repositories that neither it nor the choice of its
    regularisation had seen, over five folds."""

    content: np.ndarray
    content_bias: float
    copies: np.ndarray
    header: np.ndarray
    header_bias: float
    accuracy: dict[str, float]


def _fitted(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, bias, accuracy) of rows with labels.

    Each fold of repositories is judged by a machine fitted on the others, with the regularisation that was best on
    another fold, which its own rows had no part in. The last machine takes the one chosen most often.
    """
    if (y > 0).sum() == 0 or (y < 0).sum() == 0:
        return np.zeros(x.shape[1], np.float32), float(np.sign(y.sum()) or -1), float("nan")
    rows = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)  # the last weight is the bias
    gram = (rows @ rows.T).astype(np.float64)

    def right(train: np.ndarray, test: np.ndarray, reg: float) -> int:
        beta = fit_svm(gram[np.ix_(train, train)], y[train], reg)
        return int((np.sign(gram[np.ix_(test, train)] @ beta) == y[test]).sum())

    chosen, hits, total = [], 0, 0
    for held in range(FOLDS):
        test, inner = np.flatnonzero(fold == held), np.flatnonzero(fold == (held + 1) % FOLDS)
        rest = np.flatnonzero((fold != held) & (fold != (held + 1) % FOLDS))
        most = np.flatnonzero(fold != held)
        if not len(test) or not len(inner) or len({*y[rest].tolist()}) < 2:
            continue
        reg = max(REGULARISATION, key=lambda r: right(rest, inner, r))
        chosen.append(reg)
        hits, total = hits + right(most, test, reg), total + len(test)
    reg = max(REGULARISATION, key=chosen.count) if chosen else REGULARISATION[0]
    w = (fit_svm(gram, y, reg) @ rows).astype(np.float32)
    return w[:-1], float(w[-1]), hits / total if total else float("nan")


def copy_bucket(n: int) -> int:
    return min(COPIES - 1, max(0, int(n).bit_length() - 1)) if n > 1 else 0


def train(sample: pd.DataFrame, margin: float = 0.5) -> Model:
    """Fits both classifiers on rows (file_path, code, n_repos); neither sees what labelled its rows.

    The first sees code without header, path and number of repositories with the same body. Its labels are what
    headers say, where files stand and how they are laid out, and on the other side files that read like code; of a
    file labelled by its place alone it doesn't see the path. How often a body occurs labels nothing. The second sees
    headers only, and its labels are what the first makes of the same files, where its margin is wide.
    """
    rows = [(p, *parts(c), n) for p, c, n in sample[["file_path", "code", "n_repos"]].itertuples(index=False)]
    facts = [evidence(p, h, m) for p, h, m, _ in rows]
    y = np.array([1.0 if e.said or e.placed or e.laid else -1.0 if e.written else 0.0 for e in facts])
    fold = np.array([zlib.crc32(r[0].split("/")[0].encode("utf-8", "surrogatepass")) % FOLDS for r in rows], np.int64)
    x = np.zeros((len(rows), RAW + SHAPE + PATH + COPIES), np.float32)
    h = np.zeros((len(rows), HEADER), np.float32)
    for i, ((path, header, masked, n), e) in enumerate(zip(rows, facts)):
        x[i, :-COPIES] = content_features(path, masked)
        x[i, x.shape[1] - COPIES + copy_bucket(n)] = COPIES_SCALE
        h[i] = header_features(header)
    seen = x.copy()
    for i, e in enumerate(facts):
        if e.placed and not (e.said or e.laid):
            seen[i, RAW + SHAPE : RAW + SHAPE + PATH] = 0
    use = y != 0
    w, b, a = _fitted(seen[use], y[use], fold[use])
    taught = x @ w + b
    use = (np.abs(taught) >= margin) & np.array([bool(r[1]) for r in rows], bool)
    hw, hb, ha = _fitted(h[use], np.sign(taught[use]), fold[use]) if len(rows) else (np.zeros(HEADER, np.float32), -1.0, float("nan"))
    if not use.any():
        hb = -1.0
    return Model(w[:-COPIES], b, w[-COPIES:] * COPIES_SCALE, hw, hb, {"content": a, "header": ha})


def _last(files: DataFrame, *columns: str) -> DataFrame:
    """One row per path: the last scan, of scans at one time that with the greatest hash of its code."""
    w = Window.partitionBy("file_path").orderBy(F.col("scanned_at").desc_nulls_last(), F.col("_hash").desc())
    return files.select("file_path", "scanned_at", "_hash", *columns).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).select("file_path", "_hash", *columns)


def with_copies(facts: DataFrame) -> DataFrame:
    """`facts` with `n_repos`, the repositories that hold a file with the same body.

    Counts are reduced per (body, repository) first, so a body with a third of all files is no hot group; only
    bodies of several repositories are joined.
    """
    repo = F.split("file_path", "/")[0]
    shared = (
        facts.select("body", repo.alias("_repo")).distinct().groupBy("body").agg(F.count("*").alias("n_repos")).where(F.col("n_repos") > 1)
    )
    return facts.join(shared, "body", "left").withColumn("n_repos", F.coalesce("n_repos", F.lit(1)))


def score_files(code_elements: DataFrame, sample: int = 2500, part: int = 12_000) -> tuple[DataFrame, Model]:
    """(file_path, body, n_repos, content, header, score) of every whole file with code, and the model.

    The classifiers are fitted on `sample` files at most, those with the least hash of their path, of which they see
    the first and last characters, `part` in all; all files are judged, and whole. A file's score is the greater
    margin of the two classifiers, and that of its copies if theirs is greater. Files with null, empty or blank code
    are not judged; repeated rows count once, and of a file scanned twice the last scan counts. Without labelled
    files of both sorts the sort there is decides; an empty table gives an empty result.

    Which scan is the last is found on hashes. Bodies are compared in the JVM; Python reads each file's last code
    once. Facts of files, without their code, are checkpointed, as the sample and the result both need them.
    """
    whole = F.col("id") == F.concat(F.lit("file:"), F.col("file_path"))
    files = code_elements.where(whole & F.col("code").rlike(r"\S")).select("file_path", "scanned_at", "code", F.xxhash64("code").alias("_hash"))
    facts = stored(with_copies(_last(files.withColumn("body", body_of(F.col("code"), F.col("file_path"))), "body")))
    some = facts.select("file_path", "_hash", "n_repos").orderBy(F.xxhash64("file_path"), "file_path").limit(sample)
    tail = part // 6
    seen = F.when(F.length("code") <= part, F.col("code")).otherwise(F.concat(F.substring("code", 1, part - tail), F.lit("\n"), F.right("code", F.lit(tail))))
    rows = files.select("file_path", "_hash", seen.alias("code")).join(F.broadcast(some), ["file_path", "_hash"]).dropDuplicates(["file_path"])
    model = train(rows.select("file_path", "code", "n_repos").orderBy("file_path").toPandas())

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, code in pdf.itertuples(index=False, name=None):
                header, masked = parts(code)
                content = float(content_features(path, masked) @ model.content + model.content_bias)
                out.append((path, content, float(header_features(header) @ model.header + model.header_bias) if header else -1.0))
            yield pd.DataFrame(out, columns=["file_path", "content", "header"])

    judged = _last(files, "code").select("file_path", "code").mapInPandas(judge, "file_path string, content double, header double")
    bonus: Column = F.lit(float(model.copies[0]))
    for k in range(1, COPIES):
        bonus = F.when(F.col("n_repos") >= (1 << k), float(model.copies[k])).otherwise(bonus)
    scored = (
        judged.join(facts.select("file_path", "body", "n_repos"), "file_path")
        .withColumn("content", F.col("content") + bonus)
        .withColumn("own", F.greatest("content", "header"))
    )
    # also within a repository: a copy without notice is told by one with it
    best = scored.groupBy("body").agg(F.max("own").alias("_best"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    out = scored.join(best, "body", "left").withColumn("score", F.greatest("own", F.coalesce("_best", F.col("own"))))
    return out.select("file_path", "body", "n_repos", "content", "header", "score"), model
