import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pairloom.llm import kernel


def plain_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\né\x1c", max_size=40)), max_size=8))
def test_words_are_those_of_the_expression(texts):
    bounds, hashes = kernel.words(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        own = hashes[bounds[i] : bounds[i + 1]].tolist()
        want = plain_words(t)
        assert len(own) == len(want)
        for h, w in zip(own, want, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_and_long_texts_hash_alike():
    long = " ".join(f"word{i % 5000}" for i in range(400_000))
    both = pa.array(["a b", long, None, "word1 word2"])
    _, whole = kernel.words(both.slice(1, 1))
    assert len(whole) == 400_000
    _, few = kernel.words(both.slice(3, 1))
    assert whole[1] == few[0] and whole[2] == few[1]
    assert [len(r) for _, r in kernel.runs(both)] == [1, 1, 2]


def test_shingles():
    texts = pa.array(["a b c d e", "A b c d E", "a b", "a b", "b a", "", None, "a b c d e a b c d e"])
    got = kernel.shingles(*kernel.words(texts), 4)
    assert [len(s) for s in got] == [2, 2, 1, 1, 1, 0, 0, 5]
    assert (got[0] == got[1]).all() and (got[2] == got[3]).all() and (got[2] != got[4]).all()
    assert np.isin(got[0], got[7]).all()


def test_stems_are_cut_by_code_points():
    texts = ["дурак дуракам дурно", "Straße straßen strafe", "笨蛋笨蛋笨了 笨蛋笨蛋笨呢 笨蛋笨蛋好", "short né é", "plain plainly plane", "😀😀😀😀😀a 😀😀😀😀😀b 😀😀😀😀c"]
    for text in texts:
        bounds, _, stems = kernel.words(pa.array([text]), 5)
        words = text.split()
        assert bounds.tolist() == [0, len(words)]
        low = ["".join(c.lower() if c.isascii() else c for c in w[:5]) for w in words]
        plain = kernel.words(pa.array([" ".join(low)]))[1]
        assert stems.tolist() == plain.tolist()
    several, _, stems = kernel.words(pa.array(["né", "", "éléphant éléphants", "été"]), 5)
    assert several.tolist() == [0, 1, 1, 3, 4] and stems[1] == stems[2] != stems[3]
