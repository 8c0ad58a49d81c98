"""Ranges that spans are sought in: none is lost, and little is aligned."""

import random

import numpy as np
import pytest

import weftmark.llm.leakage as m
from weftmark.llm.leakage import Index, Meeting, Range


def cases(seed, words, foreign):
    """Items, and texts of altered pieces of them among their own words and foreign ones."""
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(words)]
    items = [(k, " ".join(rng.choice(known) for _ in range(rng.choice((24, 40, 90))))) for k in range(4)]
    texts = []
    for _ in range(10):
        text = []
        for _ in range(rng.randrange(1, 7)):
            ws, edits = rng.choice(items)[1].split(), rng.choice((0, 0.1, 0.3))
            at = rng.randrange(len(ws))
            for w in ws[at : at + rng.randrange(3, 40)]:
                text += [w] if rng.random() > edits else rng.choice(([], ["other"], [w, "extra"], [rng.choice(known)]))
            text += [rng.choice(known + ["foreign"] * foreign) for _ in range(rng.choice((0, 2, 20)))]
        texts.append(text)
    return items, texts


@pytest.mark.parametrize("words, foreign", [(4, 0), (8, 8), (20, 60), (80, 80)])
def test_ranges_lose_no_span(words, foreign):
    accepted = 0
    for seed in range(12):
        items, texts = cases(seed, words, foreign)
        ix = Index(items, stock=frozenset({tuple(items[0][1].split()[5:9])}))
        one = np.zeros(1, np.int64)
        met = [ix.meetings(t, one, one, one + len(t), one + k, sift=False)[0] for t in map(ix.encode, texts) for k in range(4)]
        # no range has less than all of the item and the text
        whole = [Meeting(x.item, x.text, x.words, [Range(0, len(ix.tokens[x.item]), 0, len(x.text), None)]) for x in met]
        got = ix.aligned(met)
        assert got == ix.aligned(whole)
        accepted += sum(s > 0 for s in got)
    assert accepted > 50


def test_only_ranges_around_shared_runs_are_aligned(monkeypatch):
    """Texts that share scattered runs with every item, as similar texts about other things do."""
    rng, cells = random.Random(3), 0
    common = [[f"c{i}{j}" for j in range(3 + i % 3)] for i in range(20)]
    items = [(k, " ".join(" ".join([*rng.choice(common), *(f"i{k}x{rng.randrange(500)}" for _ in range(4))]) for _ in range(12))) for k in range(30)]
    texts = [" ".join(" ".join([*rng.choice(common), *(f"t{rng.randrange(500)}" for _ in range(25))]) for _ in range(30)) for _ in range(20)]
    texts += [t + " " + " ".join(w for i, w in enumerate(items[n][1].split()) if i % 9) for n, t in enumerate(texts)]
    ix, spans = Index(items), m._spans

    def counted(a, b, *rest):
        nonlocal cells
        cells += sum(len(x) * len(y) for x, y in zip(a, b))
        return spans(a, b, *rest)

    monkeypatch.setattr(m, "_spans", counted)
    pairs = [(ix.encode(m.fold(t)), k) for t in texts for k in range(len(items))]
    ix.shares(pairs)
    whole = sum(len(ix.near(t, k)) * len(ix.tokens[k]) for t, k in pairs)
    assert 0 < cells < whole / 10


def test_a_bound_on_what_meets_at_once_changes_nothing(monkeypatch):
    items, texts = cases(5, 30, 30)
    texts = [None, "", *map(" ".join, texts), " ".join(w for t in texts for w in t)]
    ix = Index(items)
    got = m.leaks(texts, ix)
    monkeypatch.setattr(m, "MET", 1)
    assert m.leaks(texts, ix) == got and got
