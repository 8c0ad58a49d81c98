"""Abusive, hateful and sexual language: a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm import lexicon

_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*+]+$")
_SPELLED = re.compile(r"^\w(?:[._\-~|+,/ ]+\w){2,}$")
_MASKED = re.compile(r"^[^\W\d_]+[*#%&•×x.…_\-]{2,}[^\W\d_]*$|^[^\W\d_]+\*+[^\W\d_]*$")
_INNER = re.compile(r"(?<=\w)[*~|​]+(?=\w)")
_REPEAT = re.compile(r"(.)\1+")
_VOWELS = re.compile(r"[aeiouyäöüáéíóú0@*3146]+")
_LINK = re.compile(r"https?://[^\s\"'<>]+[\"'>]*|</[aA]>")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: Longer runs without white space are looked up by their parts.
LONGEST = 80
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_COLON = re.compile(r"[:：][\"'“”‘’«»„「『(]*$")
_OPEN = re.compile(r"^[\"“„«「『]")
_CLOSE = re.compile(r"[\"”“»」』][.,;!?]*$")
_END = re.compile(r"[.;:。\]]+[\"'”’)]*$|[!?]+[\"'”’)]*$")

#: Documents of this score or more contain abusive, hateful or sexual language.
THRESHOLD = 0.5


def squeeze(word: str) -> str:
    """Runs of one letter count once, in words and lexicon alike, so stretched spellings match."""
    return _REPEAT.sub(r"\1", word)


def plain(word: str) -> str:
    """A word with Latin letters for those that look like them, lower case, without marks and format characters."""
    word = unicodedata.normalize("NFKC", word)
    if not word.isascii():
        latin = sum("a" <= c.lower() <= "z" for c in word)
        if latin or all(c in lexicon.CONFUSABLE or not c.isalpha() for c in word):
            word = "".join(lexicon.CONFUSABLE.get(c, c) for c in word)
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c) not in ("Cf", "Mn"))
    return word.lower()


@dataclass(frozen=True)
class Arc:
    """One step of a pattern: up to `gap` other words, then a word of one of the classes in `mask`."""

    gap: int
    mask: int


class Grammar:
    """Lexicon and patterns, compiled; one instance serves a worker process.

    Each pattern is a chain of arcs, the composition of transducers for target, insult, threat and so on; a
    clause's score is the weight of its best path: the pattern's weight, times the least weight of the words
    met, less 2 % for each word skipped. Transducers of their own scale the weight down: a negation right before a
    match, a thing as its object, a report before it in the clause, or in the clause that a colon ends before it, or
    right after it behind a comma or quote. Scripts without spaces go through the same machine, letter by letter.
    """

    def __init__(self) -> None:
        self.bit: dict[str, int] = {}
        self.words: dict[str, dict[int, float]] = {}
        self.stems: dict[str, dict[int, float]] = {}
        self.phrases: dict[str, list[tuple[list[str], int, float]]] = {}
        for line in lexicon.CLASSES.strip().splitlines():
            head, _, words = line.partition(": ")
            name, weight = head.split()
            b = self.bit.setdefault(name, 1 << len(self.bit))
            for w in map(plain, words.split()):
                parts = w.split("_")
                if len(parts) > 1:
                    parts = [squeeze(x) for x in parts if x]
                    self.phrases.setdefault(parts[0].rstrip("*"), []).append((parts, b, float(weight)))
                elif w.endswith("*"):
                    self.stems.setdefault(squeeze(w[:-1]), {})[b] = float(weight)
                else:
                    self.words.setdefault(squeeze(w), {})[b] = float(weight)
        for by in self.phrases.values():
            by.sort(key=lambda x: -len(x[0]))
        self.longest_stem = max(map(len, self.stems))
        self.shortest_stem = min(map(len, self.stems))
        # words of scripts without spaces: one automaton, which takes the longest at each place
        self.signs: dict[str, dict[int, float]] = {}
        for line in lexicon.CJK_CLASSES.strip().splitlines():
            head, _, words = line.partition(": ")
            name, weight = head.split()
            b = self.bit.setdefault(name, 1 << len(self.bit))
            for w in words.split():
                self.signs.setdefault(w, {})[b] = float(weight)
        self.sign = re.compile("|".join(map(re.escape, sorted(self.signs, key=len, reverse=True))))
        self.patterns = self._compiled(lexicon.PATTERNS)
        self.cjk_patterns = [(arcs, w) for _, arcs, w in self._compiled(lexicon.CJK_PATTERNS)]
        strong = ("insult", "beastly", "slur", "curse", "gone", "demean", "harm", "weapon", "sexual", "lewd", "expel", "wish", "follow", "explicit", "abuse", "away", "violence", "obscene")
        self.strong = sum(self.bit[c] for c in strong)
        # spellings with vowels replaced or letters starred out are matched only to the words that can offend
        offensive = ("insult", "beastly", "slur", "mean", "curse", "sexual", "lewd", "harm", "weapon", "body", "group")
        masks = sum(self.bit[c] for c in offensive)
        self.skeletons: dict[str, dict[int, float]] = {}
        self.shapes: dict[tuple[str, str], list[tuple[int, dict[int, float]]]] = {}
        for source, stem in ((self.words, False), (self.stems, True)):
            for w, classes in source.items():
                if any(b & masks for b in classes) and len(w) > 3 and w.isalpha():
                    self.skeletons.setdefault(_VOWELS.sub("0", w), classes)
                    self.shapes.setdefault((w[0], "" if stem else w[-1]), []).append((len(w), classes))
                    if stem:
                        self.shapes.setdefault((w[0], w[-1]), []).append((len(w), classes))
        self.cache: dict[str, tuple[str, dict[int, float], int, bool]] = {}
        self.fitting: dict[int, list[tuple[list[Arc], float]]] = {}

    def _compiled(self, text: str) -> list[tuple[str, list[Arc], float]]:
        out = []
        for line in text.strip().splitlines():
            name, _, rest = line.partition(": ")
            body, _, weight = rest.partition(" = ")
            arcs, gap = [], 0
            for part in body.split():
                if part.startswith(".."):
                    gap = int(part[2:])
                else:
                    arcs.append(Arc(gap, sum(self.bit[c] for c in part.split("|"))))
                    gap = 0
            out.append((name, arcs, float(weight)))
        return out

    def _known(self, w: str) -> dict[int, float]:
        """Classes of a squeezed word, by itself and by its stems."""
        out = dict(self.words.get(w, ()))
        for n in range(self.shortest_stem, min(len(w), self.longest_stem) + 1):
            for b, weight in self.stems.get(w[:n], {}).items():
                out[b] = max(weight, out.get(b, 0))
        return out

    def look(self, chunk: str) -> tuple[str, dict[int, float], int, bool]:
        """(word, its classes, their bits, whether it ends a clause) of a run without white space."""
        got = self.cache.get(chunk)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            got = self.cache[chunk] = self._look(chunk)
        return got

    def _look(self, chunk: str) -> tuple[str, dict[int, float], int, bool]:
        end = bool(_END.search(chunk))
        word = _EDGE.sub("", plain(chunk)).replace("’", "'")
        if not word or len(squeeze(word)) > LONGEST:
            return "", {}, 0, end
        if _SPELLED.match(word):
            word = re.sub(r"[\W_]+", "", word)
        bare = squeeze(word)
        classes = self._known(bare)
        if not classes:
            if word.isalpha():
                pass
            elif any(c.isalpha() for c in word):
                leet = squeeze("".join(lexicon.LEET.get(c, c) for c in word))
                inner = _INNER.sub("", leet)
                classes = self._known(leet) or self._known(inner)
                if not classes and len(word) < 24 and not any(c in word for c in "/._(\\="):
                    classes = self.skeletons.get(_VOWELS.sub("0", bare), {}) or self.skeletons.get(_VOWELS.sub("0", leet), {})
                if not classes and _MASKED.match(word) and "*" in word:
                    letters = [c for c in word if c.isalpha()]
                    head, tail = word[0], word[-1] if word[-1].isalpha() else ""
                    for n, found in self.shapes.get((head, tail), []):
                        if abs(n - len(word)) <= 1 and letters:
                            classes = found
                            break
                if classes:
                    bare = inner
        bits = 0
        for b in classes:
            bits |= b
        return bare, classes, bits, end

    def _parts(self, chunk: str) -> list[str]:
        """A run without white space, or if it is too long for a word the words in it; its end keeps its mark."""
        if len(chunk) <= LONGEST or len(squeeze(plain(chunk))) <= LONGEST:
            return [chunk]
        at = [m.span() for m in _LETTERS.finditer(chunk)]
        return [chunk[i:j].rstrip("._-~") for (i, _), (j, _) in zip(at, at[1:])] + [chunk[i:] for i, _ in at[-1:]] or [chunk]

    def _clauses(self, text: str) -> Iterator[tuple[list[tuple[str, dict[int, float], int]], bool, int | None]]:
        """(words, whether a report introduces them, where after a comma or quote a report may follow them)."""
        look = self.look
        for line in text.splitlines():
            chunks = [c for x in line.split() for c in self._parts(x)] if len(line) > LONGEST else line.split()
            clause: list[tuple[str, dict[int, float], int]] = []
            told, quoted, cut = False, False, None
            k, n, begin = 0, len(chunks), 0
            while k < n:
                chunk = chunks[k]
                if len(chunk) == 1 and chunk.isalpha():  # letters with spaces between them
                    j = k
                    while j < n and len(chunks[j].rstrip(".,!?;")) == 1 and chunks[j][0].isalpha():
                        j += 1
                    if j - k >= 3:
                        chunk, k = "".join(chunks[k:j]), j - 1
                        if chunk[0] in "aAiI" and not look(chunk)[2] and look(chunk[1:])[2]:  # the first is a word
                            clause.append(look(chunk[0])[:3])
                            chunk = chunk[1:]
                word, classes, bits, end = look(chunk)
                clause.append((word, classes, bits))
                k += 1
                if chunk[-1] in ",\"”»“’'":
                    cut = len(clause)
                if end:
                    # a mark inside a sentence, as in "every WORD!!! thing", doesn't end a clause
                    nxt = chunks[k] if k < n else ""
                    if not (chunk.endswith(("!", "?")) and (nxt[:1].islower() or len(clause) < 3)):
                        yield clause, told, cut
                        # what a report, or a verb of saying with a quote, puts before a colon is told: the quote, or one clause
                        quoted = told and quoted and not _CLOSE.search(chunk)
                        told = quoted
                        if _COLON.search(chunk) and k < n:
                            opens = bool(_OPEN.match(chunks[k]))
                            if self._tells(clause, chunks[begin:k], opens):
                                told, quoted = True, opens
                        clause, cut, begin = [], None, k
            if clause:
                yield clause, told, cut

    def _tells(self, clause: list[tuple[str, dict[int, float], int]], chunks: list[str], opens: bool) -> bool:
        """Whether a clause before a colon introduces reported speech; the name of a speaker in a chat doesn't."""
        every = 0
        for _, _, bits in clause:
            every |= bits
        said = every & self.bit["report"] or (every & self.bit["speech"] and opens)
        return bool(said) and not every & self.bit["i"] and not any(c[0] in "@>[<" or "-" in c for c in chunks)

    def _phrased(self, clause: list[tuple[str, dict[int, float], int]]) -> list[tuple[dict[int, float], int]]:
        """Adds the classes of phrases to their first words."""
        out = []
        for k, (word, classes, bits) in enumerate(clause):
            for parts, b, weight in self.phrases.get(word, ()):
                if len(parts) <= len(clause) - k and all(
                    (w := clause[k + i][0]) == p or (p.endswith("*") and w.startswith(p[:-1])) for i, p in enumerate(parts)
                ):
                    classes = classes | {b: weight}
                    bits |= b
            out.append((classes, bits))
        return out

    def _fitting(self, every: int) -> list[tuple[list[Arc], float]]:
        """The patterns that a clause with these classes can match: those of which it has a class for every arc."""
        got = self.fitting.get(every)
        if got is None:
            if len(self.fitting) > 100_000:
                self.fitting.clear()
            got = self.fitting[every] = [(arcs, w) for _, arcs, w in self.patterns if all(every & a.mask for a in arcs)]
        return got

    def clause_score(self, words: list[tuple[dict[int, float], int]], told: bool = False, cut: int | None = None) -> float:
        best = 0.0
        bits = [b for _, b in words]
        every = 0
        for b in bits:
            every |= b
        for arcs, weight in self._fitting(every):
            if weight <= best:
                continue
            for first, b in enumerate(bits):
                if b & arcs[0].mask:
                    s = weight * self._path(words, bits, arcs, first)
                    if s > best:
                        best = s
        if best:
            first = next((i for i, b in enumerate(bits) if b & self.strong), len(bits))
            after = bits[cut:] if cut and cut > first else []
            told = told or any(b & self.bit["report"] for b in bits[: first + 1])
            # "..., says the report": a verb of saying right after the comma or quote
            told = told or bool(len(after) <= 6 and after and any(b & self.bit["speech"] for b in after[:2]) and not any(b & self.bit["i"] for b in after))
            if told:
                best *= 0.4
            persons = ("insult", "you", "people", "group", "folk", "role", "i", "party", "bid")
            if every & self.bit["thing"] and not every & sum(self.bit[c] for c in persons):
                best *= 0.5
        return best

    def _negated(self, bits: list[int], after: int, at: int) -> bool:
        """Whether one of the three words before `at`, none before `after`, is a negation."""
        return any(b & self.bit["not"] for b in bits[max(after + 1, at - 3) : at])

    def _viewed(self, bits: list[int], after: int, at: int) -> bool:
        """Whether a slur is what others are said to have called or treated people as, and not to be treated as."""
        if not bits[at] & self.bit["slur"] or not any(b & self.bit["viewed"] for b in bits[max(after, at - 4) : at]):
            return False
        return not any(b & self.bit["should"] for b in bits[max(0, at - 8) : at])

    def _path(self, words: list, bits: list[int], arcs: list[Arc], first: int, skip: float = 0.02) -> float:
        def most(at: int, mask: int) -> float:
            return max(v for b, v in words[at][0].items() if b & mask)

        states = {first: most(first, arcs[0].mask) * (0.3 if arcs[0].mask & self.bit["insult"] and self._negated(bits, -1, first) else 1)}
        for arc in arcs[1:]:
            step: dict[int, float] = {}
            for at, score in states.items():
                for nxt in range(at + 1, min(len(bits), at + arc.gap + 2)):
                    if bits[nxt] & arc.mask:
                        s = min(score, most(nxt, arc.mask)) - skip * (nxt - at - 1)
                        if self._negated(bits, at, nxt) or self._viewed(bits, at, nxt):
                            s *= 0.3
                        if s > step.get(nxt, 0.0):
                            step[nxt] = s
            states = step
            if not states:
                return 0.0
        return max(states.values())

    def _unspaced(self, text: str) -> float:
        """The greatest score of a clause of a script without spaces, by the same machine over letters and words."""
        best = 0.0
        for clause in re.split(r"[。！？!?\n]", text):
            words, at = [], 0
            for m in self.sign.finditer(clause):
                words += [({}, 0)] * (m.start() - at)
                classes = self.signs[m.group()]
                if self.bit["not"] in classes and words and words[-1][1] and m.start() == at:  # "is not", behind what it negates
                    words[-1] = ({b: 0.3 * v for b, v in words[-1][0].items()}, words[-1][1])
                words.append((classes, sum(classes)))
                at = m.end()
            if not words:
                continue
            bits, every = [b for _, b in words], 0
            for b in bits:
                every |= b
            for arcs, weight in self.cjk_patterns:
                if weight > best and all(every & a.mask for a in arcs):
                    for first, b in enumerate(bits):
                        if b & arcs[0].mask:
                            s = weight * self._path(words, bits, arcs, first, 0.005)
                            if every & self.bit["report"]:
                                s *= 0.4
                            if every & self.bit["thing"] and not every & (self.bit["who"] | self.bit["violence"]):
                                s *= 0.4
                            best = max(best, s)
        return best

    def score(self, text: str | None) -> float:
        """The greatest clause score of a text, between 0 and 1; 0 for null, empty and blank texts."""
        if not text:
            return 0.0
        best = 0.0
        if "`" in text:
            text = text.replace("`", "")
        if "://" in text:
            text = _LINK.sub(" ", text)
        for clause, told, cut in self._clauses(text):
            best = max(best, self.clause_score(self._phrased(clause), told, cut))
            if best >= 1:
                return best
        if not text.isascii() and _CJK.search(text):
            best = max(best, self._unspaced(text))
        return round(max(0.0, min(1.0, best)), 4)


_grammar: Grammar | None = None


def grammar() -> Grammar:
    global _grammar
    if _grammar is None:
        _grammar = Grammar()
    return _grammar


def score_abuse(documents: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """(id, *keep, score): for every document the score of its most abusive clause, 0 to 1.

    Null, empty and blank texts score 0. Every row gives one row, whatever its other columns hold; repeated
    ids and texts are scored each. An empty table gives an empty result. Whole texts are read, clause by
    clause, in one pass without a shuffle; a worker remembers the classes of words it met, up to a bound that
    changes no result.
    """
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    columns = list(dict.fromkeys([id, *keep]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = grammar().score
        for pdf in batches:
            out = pdf[columns].copy()
            out["score"] = [score(t) for t in pdf["_text"]]
            yield out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double"
    return documents.select(*columns, F.col(text).alias("_text")).mapInPandas(run, schema)


def abuse_rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Per source the documents, those that contain abuse, and their rate. A null source is one of the sources."""
    hit = F.sum((F.col("score") >= threshold).cast("bigint"))
    return scored.groupBy(source).agg(F.count("*").alias("documents"), hit.alias("abusive"), (hit / F.count("*")).alias("rate"))
