import random
import zlib
from collections import Counter

import numpy as np
from pairloom.llm import spelling
from pairloom.llm.common import Store


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(rng, n):
    out = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(n)}
    return sorted(out | {"a" * k for k in range(1, 9)})


def test_automata_accept_each_neighbour_once():
    rng = random.Random(3)
    words = some_words(rng, 300)
    trie = spelling.Trie.build([w.encode("latin-1") for w in words], np.arange(1, len(words) + 1))
    trie = spelling.Trie.unpacked(trie.packed())
    asked = [*words, "zz", "ab" * 5, "ÿ"]
    who, node = trie.neighbours([w.encode("latin-1") for w in asked])
    got = Counter((asked[w], trie.word(int(v))) for w, v in zip(who, node, strict=True))
    assert got == Counter((a, b) for a in asked for b in words if near(a, b))


def brute(counts):
    out = {}
    for w, n in counts.items():
        own = [x for x in counts if near(w, x)]
        top = min(own, key=lambda x: (-counts[x], x), default=None)
        form = top if top and counts[top] >= 5 * n else None
        out[w] = [form, n, len(own), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def test_variants_over_shards(spark):
    rng = random.Random(8)
    counts = {w: rng.choice([5, 5, 7, 25, 30, 130, 700]) for w in some_words(rng, 150)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, most=40).collect()} == brute(counts)


def slipped(docs):
    out = Counter()
    for i, text in docs:
        word = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                word += c.lower() if c.isascii() else c
                continue
            if word:
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                k = h % len(word)
                out[word[:k] + word[k + 1 :] if h % 199 == 0 else word] += 1
            word = ""
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def test_words_of_texts(spark):
    rng = random.Random(2)
    stems = ["Lettère", "abcdef", "ABCDEFG", "x×yzuvw", "short", "ÀÉÎõüÿ", "longest" * 3000]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice(["", "!", "1"]) for _ in range(30))) for i in range(300)]
    docs += [(None, "abcdef abcdef"), (1, None), (2, ""), (3, "nonono nonono nonono nonono")] + [(4, "repeat")] * 5
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, word string, n int")
    want = slipped(docs)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(spelling.runs(df)).collect()} == want
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spelling.vocabulary(spelling.runs(df))).collect()} == brute(want)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    out = spelling.roots(Store(spark), spark.createDataFrame(chain, "word string, form string"))
    assert {r["word"]: r["root"] for r in out.collect()} == {w: "w40" for w, _ in chain}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(spelling.runs(df))).collect() == []
