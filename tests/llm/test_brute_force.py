"""op1, op3, op5 and op7 held against plain Python on small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pairloom.llm import kernel, mixing, quality, sharding, toxicity
from pyspark.sql import functions as F

LONG = "word " * 60_000 + "vile " * 3


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ") if w]


def texts(n, seed):
    rng = random.Random(seed)
    mild, bad = ["house", "Garden", "river", "über", "été", "street", "stone"], ["vile", "vileness", "scum", "scummy", "idiot"]
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        own = [rng.choice(mild) for _ in range(rng.randrange(1, 25))] + ([rng.choice(bad) for _ in range(rng.randrange(1, 6))] if toxic else [])
        rng.shuffle(own)
        out.append((i, " ".join(own), int(toxic)))
    return out


def plain_evidence(train, asked):
    """The toxicity model by its definition, in dictionaries."""
    counts, kinds = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text, toxic in set(train):
        for w in words(text):
            counts[w[: toxicity.STEM]][toxic] += 1
            kinds[w[: toxicity.STEM]].add(w)
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    spare = [sum(min(c[k], 3) for c in counts.values()) for k in (0, 1)]
    all_kinds = sum(map(len, kinds.values()))

    def p(stem, k):
        c = counts[stem][k]
        return (c - min(c, 3) + spare[k] * len(kinds[stem]) / all_kinds) / total[k]

    over = {s: max(0.0, math.log(p(s, 1) / p(s, 0)) - toxicity.MARGIN) for s in list(counts)}
    return [sum(over.get(w[: toxicity.STEM], 0.0) for w in words(t)) / math.sqrt(max(1, len(words(t)))) for t in asked]


def test_toxicity_is_its_definition(spark):
    rows = texts(240, 1)
    asked = [*rows, (900, None, 0), (901, "", 0), (902, LONG, 0), (903, "unseen words only", 0), (903, "unseen words only", 0), (None, "vile scum", 1)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in asked], "doc_id long, text string, score string, evidence double")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    train = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5]
    want = dict(zip([(i, t) for i, t, _ in asked], plain_evidence(train, [t or "" for _, t, _ in asked]), strict=True))
    plain = docs.select("doc_id", "text")
    got = {(r["doc_id"], r["text"]): r["evidence"] for r in toxicity._evidence(plain, model.blocks, ["doc_id", "text"]).collect()}
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-5), key
    scored = toxicity.score(plain, model, ["doc_id"]).collect()
    assert len(scored) == len(asked) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)


def plain_indicators(text):
    data, out = (text or "").encode(), set()
    for n in quality.SIZES:
        for i in range(len(data) - n + 1):
            joined = 0
            for c in data[i : i + n]:
                joined = (joined * kernel._BASE + int(kernel._LETTER[c])) % (1 << 64)
            out.add((joined * (0x9E3779B97F4A7C15 + 2 * n) % (1 << 64)) >> (64 - quality.BITS))
    own = words(text)
    same = sum(a == b for a, b in zip(own, own[1:], strict=False))
    if same:
        marks = [*(same >= k for k in quality.OFTEN), *(same > s * len(own) for s in quality.SHARE)]
        out |= {quality.BUCKETS + i for i, m in enumerate(marks) if m}
    return out


def test_quality_is_its_definition(spark):
    rows = [(i, t, k) for i, t, k in texts(90, 4)]
    said = ["", None, "ab", "the the the the end", "Größe größe", rows[0][1], rows[0][1]]
    for text, got in zip(said, quality.features(pa.array(said)), strict=True):
        assert sorted(got.tolist()) == sorted(plain_indicators(text))
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in rows] + [(500 + i, t, 0.1) for i, t in enumerate(said)] + [(None, LONG, 0.2)], "doc_id long, text string, score double")
    model = quality.fit(docs, spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, quality int"))
    out = {}
    for r in quality.score(docs, model).collect():
        out.setdefault(r["doc_id"], r["score"])
    assert len(out) == len(rows) + len(said) + 1
    for i, text in enumerate(said):
        u = list(plain_indicators(text))
        margin = (model.bias + sum(float(model.weight[x]) for x in u)) / math.sqrt(quality.CONSTANT + sum(float(model.square[x]) for x in u))
        assert out[500 + i] == pytest.approx(1 / (1 + math.exp(-model.slope * margin)), rel=1e-5)


def plain_targets(sizes):
    """Shares of 150 % of all sizes by weights 3, 1, 2, ..., sources that reach twice their size taken out one after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_their_definition(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 500, rng.randrange(1, 100_000)]) for s in ["a", "b", "c", "Z", "é", "s1", "s2", None][: 3 + seed]} | {None: 40}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_takes_what_it_says(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", None])) for i in range(400)] + [(900, LONG, "long"), (901, None, "a"), (5, "again again", "b"), (5, "again again", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    want = plain_targets(dict(size))
    taken = Counter()
    for r in mixing.decide(df).collect():
        assert r["copies"] in (0, 1, 2) and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["size"] * r["copies"] * r["n"]
    for s in ("a", "b", None):
        assert abs(taken[s] - want[s]) <= 40


def test_shards_are_their_definition(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a text", "another", "", "ünï", f"own {i}", None])) for i in range(500)] + [(600, LONG), (None, "x"), (None, "x")]
    out = sharding.assign(spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, slot int, law string")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
