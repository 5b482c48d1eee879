"""Language identification by hierarchical discrimination: the family first, then the languages within it.

A text is lower-cased, all but letters become spaces, and its byte n-grams (n in SIZES, hashed into BUCKETS)
are counted; a feature is the square root of its share, so every text has length one, whatever its own
length. Families are those of FAMILIES (by the part of the language's name before - or _); a language that
is not listed is a family of its own. The family is the one of largest margin among linear
hinge-loss models, one for each family against the rest. Within it, each pair of its languages has
a linear support vector machine, and the language that wins most of them is predicted (ties: by summed margins, then
by name). All models are fitted by dual coordinate descent; a fifth of the sample is kept out to turn margins into
probabilities. score: the family's probability times the least probability of the language against another of its family.

The fit uses about SAMPLE documents, the same number of each language where there are enough, chosen
by a hash of doc_id; their features are made by the tasks, so what reaches the driver is bounded (SAMPLE
rows of BUCKETS features at most). Everything else is one pass over documents without a shuffle. What
is sent to executors is a number for each model and bucket; more than MODELS models are refused.

Null texts and texts without a letter are `und` with score 0, and so is every text if nothing is learned.
With one language learned, each text with a letter is of that language. Very long texts count whole. Repeated
rows stay repeated (copies are learned from once); a null doc_id counts as empty text; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import bounded_batches, remainder, table

SIZES = (1, 2, 3)
BITS = 15
BUCKETS = 1 << BITS
SAMPLE = 1200
MODELS = 2000
COST, EPOCHS = 10.0, 12
UNKNOWN = "und"
# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "malayic": "id jv mg ms su tl",
    "bantu": "lg ln ny rn rw sn sw tn ts xh zu",
    "sinitic": "zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_SPACED = np.full(256, 32, np.uint8)
_SPACED[97:123] = np.arange(97, 123)
_SPACED[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.replace("_", "-").split("-")[0].lower(), f"={lang}")


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, square roots of their shares) of each text."""
    out = []
    for _, run in kernel.runs(pa.compute.utf8_lower(texts)):
        data, at = kernel.buffers(run)
        data = _SPACED[data]
        hashed = [((kernel.grams(data, n) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32) for n in SIZES]
        for a, z in itertools.pairwise(at.tolist()):
            own = np.concatenate([h[a : max(a, z - n + 1)] for n, h in zip(SIZES, hashed, strict=True)])
            if 8 * len(own) > BUCKETS:
                n = np.bincount(own, minlength=BUCKETS)
                which = np.flatnonzero(n)
                n = n[which]
            else:
                which, n = np.unique(own, return_counts=True)
            out.append((which.astype(np.int32), np.sqrt(n / max(1, len(own))).astype(np.float32)))
    return out


def descend(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, both classes with equal total cost, by dual coordinate descent."""
    share = (sign > 0).mean()
    cost = np.where(sign > 0, COST * 0.5 / share, COST * 0.5 / (1 - share))
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    square = [1.0 + float(v @ v) for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            u, v = rows[i]
            new = min(max(alpha[i] + (1 - sign[i] * (w[u] @ v + bias)) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[u] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def _slope(margin: np.ndarray, sign: np.ndarray) -> float:
    slopes = np.linspace(0.5, 20, 40)
    return float(slopes[np.argmin([np.logaddexp(0, -s * margin * sign).mean() for s in slopes])]) if len(margin) else 2.0


class Model:
    """families: names; langs: of each family; pairs: (family, one, two, column); weight: buckets x models."""

    def __init__(self, langs: list[list[str]], pairs: list[tuple[int, int, int]], weight: np.ndarray, bias: np.ndarray, slope: np.ndarray):
        self.langs, self.pairs, self.weight, self.bias, self.slope = langs, pairs, weight, bias, slope

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], lang: list[str]) -> Model:
        names = sorted({family(x) for x in lang})
        langs = [sorted({x for x in lang if family(x) == f}) for f in names]
        pairs = [(f, a, b) for f, own in enumerate(langs) for a, b in itertools.combinations(range(len(own)), 2)]
        if len(names) + len(pairs) > MODELS:
            raise ValueError(f"{len(names)} families and {len(pairs)} pairs of languages are more than {MODELS} models")
        which = np.array([names.index(family(x)) for x in lang], np.int64)
        inner = np.array([langs[f].index(x) for f, x in zip(which, lang, strict=True)], np.int64)
        tasks = [(np.arange(len(rows)), np.where(which == f, 1.0, -1.0)) for f in range(len(names))] if len(names) > 1 else []
        for f, a, b in pairs:
            own = np.flatnonzero((which == f) & ((inner == a) | (inner == b)))
            tasks.append((own, np.where(inner[own] == a, 1.0, -1.0)))
        weight, bias, slope = np.zeros((BUCKETS, len(tasks)), np.float32), np.zeros(len(tasks)), np.zeros(len(tasks))
        for k, (own, sign) in enumerate(tasks):
            out = np.arange(len(own)) % 5 == 4
            if not (sign[out] > 0).any() or not (sign[out] < 0).any() or not (sign[~out] > 0).any() or not (sign[~out] < 0).any():
                out[:] = False
            w, c = descend([rows[i] for i in own[~out]], sign[~out])
            weight[:, k], bias[k] = w, c
            slope[k] = _slope(np.array([w[rows[i][0]] @ rows[i][1] + c for i in own[out]]), sign[out])
        return cls(langs, pairs, weight, bias, slope)

    def predict(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[str], np.ndarray]:
        n = len(rows)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        margin = np.array([v @ self.weight[u] for u, v in rows]).reshape(n, -1) + self.bias
        sure = 1 / (1 + np.exp(-np.clip(self.slope * margin, -700, 700)))
        heads = len(self.langs) if len(self.langs) > 1 else 0
        which = margin[:, :heads].argmax(axis=1) if heads else np.zeros(n, np.int64)
        p = sure[np.arange(n), which] / sure[:, :heads].sum(axis=1) if heads else np.ones(n)
        out: list[str] = [""] * n
        for f, own in enumerate(self.langs):
            mine = np.flatnonzero(which == f)
            wins, total, least = np.zeros((len(mine), len(own))), np.zeros((len(mine), len(own))), np.ones((len(mine), len(own)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f and len(mine):
                    m, q = margin[mine, heads + k], sure[mine, heads + k]
                    wins[:, a] += m >= 0
                    wins[:, b] += m < 0
                    total[:, a] += m
                    total[:, b] -= m
                    least[:, a] = np.minimum(least[:, a], q)
                    least[:, b] = np.minimum(least[:, b], 1 - q)
            for i, j in enumerate(mine):
                best = min(range(len(own)), key=lambda x: (-wins[i, x], -total[i, x], x))  # noqa: B023
                out[j] = own[best]
                p[j] *= least[i, best]
        return out, p


def fit(docs: DataFrame, held_out_of: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Model:
    """Fit on about sample documents (doc_id, text, lang) whose remainder is not held_out."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.filter("lang IS NOT NULL AND text IS NOT NULL").filter(remainder(F.col("id"), held_out_of) != held_out)
    counts = dict(own.groupBy("lang").count().toPandas().itertuples(index=False))  # one row a language
    if not counts:
        return Model([], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    each = max(4, sample // len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1, each / n) * (1 << 32)))]), F.col("lang"))
    own = own.filter(F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 32)) < share).filter(F.col("text").rlike(r"\p{L}"))
    own = own.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "lang"])

    def made(batches):
        for b in batches:
            rows = features(b.column("text"))
            yield pa.record_batch([b.column("h"), b.column("lang"), pa.array([u for u, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["h", "lang", "which", "value"])

    got = own.select("h", "lang", "text").mapInArrow(made, "h long, lang string, which array<int>, value array<float>").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    flat = [got[c].combine_chunks() for c in ("which", "value")]
    rows = [(flat[0][i].values.to_numpy(), flat[1][i].values.to_numpy()) for i in range(got.num_rows)]
    return Model.fit(rows, got["lang"].to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for b in batches:
            lang, p = sent.value.predict(features(b.column("text")))
            told = b.column("told").to_pylist()
            lang = [x if t else UNKNOWN for x, t in zip(lang, told, strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(told, p, 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("told"))
    return rows.mapInArrow(each, "doc_id long, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op11_language_id": op11_language_id}
ORACLES: dict[str, str] = {}
