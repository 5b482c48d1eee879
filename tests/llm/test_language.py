import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pairloom.llm import kernel, language

DATA = "/root/testdata/sf0.01"
WORDS = {"en": "the and of this with house light", "de": "der und nicht mit haus licht schon", "nl": "het en niet met huis licht al", "fr": "le et avec maison lumière déjà", "es": "el y con casa luz también", "xx": "qaq zuz qoq zaz quq"}


def bucket(gram: bytes, n: int) -> int:
    """The hash of one n-gram, in plain integers."""
    joined = 0
    for c in gram:
        joined = (joined * kernel._BASE + int(kernel._LETTER[c])) % (1 << 64)
    return (joined * (0x9E3779B97F4A7C15 + 2 * n) % (1 << 64)) >> (64 - language.BITS)


def plain_features(text: str) -> dict[int, float]:
    data = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in text.lower().encode())
    counts = Counter(bucket(data[i : i + n], n) for n in language.SIZES for i in range(len(data) - n + 1))
    return {b: math.sqrt(c / sum(counts.values())) for b, c in counts.items()}


def texts(n, seed):
    rng = random.Random(seed)
    return [(lang := rng.choice(list(WORDS)), " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 30)))) for _ in range(n)]


def plain_predict(model, text):
    x = plain_features(text)
    margin = [sum(v * float(model.weight[b, k]) for b, v in x.items()) + model.bias[k] for k in range(model.weight.shape[1])]
    heads = len(model.langs)
    f = max(range(heads), key=lambda k: margin[k])
    wins = Counter()
    for k, (g, a, b) in enumerate(model.pairs):
        if g == f:
            wins[a if margin[heads + k] >= 0 else b] += 1
    return model.langs[f][max(range(len(model.langs[f])), key=lambda j: wins[j])]


def test_features_are_shares_of_ngrams():
    said = ["Ça va? 123 ÉTÉ.", "", "ab", "x" * 70_000 + " the end", None]
    for text, (which, value) in zip(said, language.features(pa.array(said)), strict=True):
        want = plain_features(text or "")
        assert dict(zip(which.tolist(), value.tolist(), strict=True)) == pytest.approx(want)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    sign = np.where(np.arange(60) % 2, 1.0, -1.0)
    rows = []
    for s in sign:
        v = rng.normal(size=5) + 0.4 * s
        rows.append((np.arange(5, dtype=np.int32), (v / np.linalg.norm(v)).astype(np.float32)))
    epochs, language.EPOCHS = language.EPOCHS, 3000
    try:
        w, bias = language.descend(rows, sign)
    finally:
        language.EPOCHS = epochs

    def loss(u):
        return (u @ u) / 2 + language.COST * sum(max(0.0, 1 - s * (u[:5] @ v + u[5])) for s, (_, v) in zip(sign, rows, strict=True))

    at = np.append(w[:5], bias)
    for _ in range(300):
        assert loss(at) <= loss(at + rng.normal(size=6) * rng.choice([1e-2, 0.1, 1])) + 1e-3


def test_hierarchy_on_invented_languages(spark):
    known, asked = texts(400, 1), texts(120, 2)
    model = language.Model.fit(language.features(pa.array([t for _, t in known])), [lang for lang, _ in known])
    assert model.langs == [["xx"], ["de", "en", "nl"], ["es", "fr"]] or {tuple(x) for x in model.langs} == {("xx",), ("de", "en", "nl"), ("es", "fr")}
    got, score = model.predict(language.features(pa.array([t for _, t in asked])))
    assert got == [plain_predict(model, t) for _, t in asked]
    assert np.mean([a == b for a, (b, _) in zip(got, asked, strict=True)]) > 0.97
    assert ((score >= 0) & (score <= 1)).all()


def test_odd_rows(spark):
    rows = [(i, t, lang, "x", 1.0) for i, (lang, t) in enumerate(texts(200, 5))] + [(None, "the house", None, "x", 1.0), (901, None, "en", "x", 1.0), (902, "", "en", "x", 1.0), (903, "12 !? 34", "en", "x", 1.0)]
    rows += [(904, "the and of " * 60_000, None, "x", 1.0)] + [(905, "le et avec", None, "x", 1.0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = language.identify(df, language.fit(df)).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(out) == len(rows) and by[None][0][0] == "en" and by[904][0][0] == "en" and [x[0] for x in by[905]] == ["fr"] * 3
    assert by[901] == by[902] == by[903] == [("und", 0.0)]
    none = language.identify(df, language.fit(df.withColumn("lang", df["lang"].substr(1, 0)).filter("1 = 0"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = language.identify(df, language.fit(df.filter("lang = 'de'"))).collect()
    assert {r["lang_pred"] for r in one if r["doc_id"] not in (901, 902, 903)} == {"de"}
    assert language.identify(df.limit(0), language.fit(df)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    out = language.op11_language_id(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    right = out.join(docs, "doc_id").filter("held_out").selectExpr("avg(CASE WHEN lang = lang_pred THEN 1 ELSE 0 END)").first()[0]
    assert right > 0.99
