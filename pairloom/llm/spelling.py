"""Spelling variants: distance-one Levenshtein automata intersected with broadcast shards of a trie.

Words are counted by Spark (partial sums before the shuffle, so a word of any frequency is fine). The
vocabulary (length and count at least asked for) is ranged by word and packed into trie shards, each bounded
in words and letters: arrays of edges sorted by parent and letter, the children of a node side by
side. The shards are broadcast in waves of bounded size, and the vocabulary, dealt by hash, passes all of them. A task
walks its words' automata through the shard with a stack of blocks of states (word, node, place), deepest first: the states
without an edit follow the word, and each also goes on by one inserted, deleted or replaced letter; those
must then follow the word to its end at an accepting node. An inserted letter differs from the next one of the
word, and of equal letters in a row the last is deleted, so each neighbour is accepted once. What leaves a task is a word's number
of neighbours and its best one; the shards' parts are reduced by word. Chains of forms end after
about log5 of the largest count, and are followed by doubling joins.

Words hold code points up to 0xFF only, so one byte is one letter, and bytes order words by code points. Null and
empty texts have no words; a null doc_id counts as empty text within the hash; repeated rows count
repeatedly. Ties of count go to the smallest word. Very long runs are words like others (a word longer than a
shard's bound is a shard of its own). Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST, TIMES, SLIP = 6, 5, 5, 199
#: A shard's words and letters at most, and the bytes of the shards that are broadcast at once (or one shard, of 18 bytes a letter).
WORDS, LETTERS, SENT = 1 << 17, 1 << 21, 1 << 26
#: Words that one task walks, and states of one block.
TASK, BLOCK = 1 << 13, 1 << 12


def runs(docs: DataFrame) -> DataFrame:
    """word: each run of letters of SHORTEST code points or more, as read (one in SLIP loses a letter, see the contract)."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(r"[a-zÀ-ÿ]{%d,}" % SHORTEST), F.lit(0))).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= SHORTEST)


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n of the words that occur FEWEST times or more."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEWEST)


class Trie:
    """Node 0 is the root; edges from node v are first[v] to first[v + 1], by letter; ends[v] is the count of the word that ends at v, 0 if none does."""

    def __init__(self, first: np.ndarray, letter: np.ndarray, child: np.ndarray, ends: np.ndarray, up: np.ndarray):
        self.first, self.letter, self.child, self.ends, self.up = first, letter, child, ends, up
        parent = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.keys = parent * 256 + letter
        self.own = np.zeros(len(ends), np.uint8)  # the letter of the edge into each node
        self.own[child] = letter

    ARRAYS = (("first", np.int32), ("letter", np.uint8), ("child", np.int32), ("ends", np.int64), ("up", np.int32))

    @classmethod
    def build(cls, words: list[bytes], counts: np.ndarray) -> Trie:
        """From sorted words."""
        parents, letters, path, ends, before = [], [], [0], [0], b""
        for w, n in zip(words, counts.tolist(), strict=True):
            same, most = 0, min(len(w), len(before))
            while same < most and w[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for c in w[same:]:
                parents.append(path[-1])
                letters.append(c)
                path.append(len(parents))
                ends.append(0)
            ends[-1] = n
            before = w
        parent, letter = np.array(parents, np.int64), np.array(letters, np.uint8)
        order = np.argsort(parent * 256 + letter, kind="stable")
        first = np.searchsorted(parent[order], np.arange(len(ends) + 1)).astype(np.int32)
        return cls(first, letter[order], (order + 1).astype(np.int32), np.array(ends, np.int64), np.concatenate(([0], parent)).astype(np.int32))

    def packed(self) -> list[bytes]:
        return [getattr(self, name).astype(kind).tobytes() for name, kind in self.ARRAYS]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Trie:
        return cls(*[np.frombuffer(p, kind) for p, (_, kind) in zip(parts, cls.ARRAYS, strict=True)])

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which states have such an edge, where it leads)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = node.astype(np.int64) * 256 + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        has = np.flatnonzero(self.keys[at] == key)
        return has, self.child[at[has]].astype(np.int64)

    def word(self, node: int) -> str:
        out = bytearray()
        while node:
            out.append(self.own[node])
            node = int(self.up[node])
        return bytes(reversed(out)).decode("latin-1")

    def neighbours(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(which word, node of a neighbour): each pair once."""
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        flat = np.frombuffer(b"".join(w + b"\0" for w in words) + b"\0", np.uint8)  # no word holds a zero
        found = [np.zeros((2, 0), np.int64)]
        stack = [(np.arange(i, min(i + BLOCK, len(words))), np.zeros(min(BLOCK, len(words) - i), np.int64), 0) for i in range(0, len(words), BLOCK)]
        while stack:
            w, v, i = stack.pop()  # states without an edit: i letters of each word led to node v
            here = flat[start[w] + i]
            has, child = self.step(v, here)
            if len(has):
                stack.append((w[has], child, i + 1))
            n = self.first[v + 1] - self.first[v]
            who = np.repeat(np.arange(len(w)), n)
            edge = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + self.first[v][who]
            other = self.letter[edge] != here[who]
            who, to = who[other], self.child[edge[other]].astype(np.int64)
            more = here[who] != 0
            cut = np.flatnonzero(here != 0)
            cut = cut[here[cut] != flat[start[w[cut]] + i + 1]]
            states = [(w[who], to, np.full(len(who), i)), (w[who[more]], to[more], np.full(more.sum(), i + 1)), (w[cut], v[cut], np.full(len(cut), i + 1))]
            w, v, i = (np.concatenate(x) for x in zip(*states, strict=True))
            while len(w):  # with the edit behind them
                over = i == size[w]
                good = over & (self.ends[v] > 0)
                found.append(np.stack([w[good], v[good]]))
                w, v, i = w[~over], v[~over], i[~over]
                has, v = self.step(v, flat[start[w] + i])
                w, i = w[has], i[has] + 1
        who, node = np.concatenate(found, axis=1)
        return who, node


def _packer(most: int):
    """Trie shards of one partition's words, most words each at most."""

    def each(batches):
        held: list[tuple[bytes, int]] = []
        letters = 0

        def shard():
            held.sort()
            parts = Trie.build([w for w, _ in held], np.array([n for _, n in held], np.int64)).packed()
            return pa.record_batch([pa.array([p], pa.binary()) for p in parts], names=[name for name, _ in Trie.ARRAYS])

        for b in batches:
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                w = word.encode("latin-1")
                if held and (len(held) >= most or letters + len(w) > LETTERS):
                    yield shard()
                    held, letters = [], 0
                held.append((w, n))
                letters += len(w)
        if held:
            yield shard()

    return each


def best(who: np.ndarray, node: np.ndarray, trie: Trie, n: int) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
    """Of each of n words: whether it has a neighbour, how many, the most frequent one (ties: the least), and its count."""
    many = np.bincount(who, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, who, trie.ends[node])
    form: list[str | None] = [None] * n
    for k in np.flatnonzero(trie.ends[node] == most[who]).tolist():
        w, x = int(who[k]), trie.word(int(node[k]))
        if form[w] is None or x < form[w]:
            form[w] = x
    return many > 0, many, form, most


def _walker(sent):
    def each(batches):
        tries: list[Trie] = []
        for b in batches:
            tries = tries or [Trie.unpacked(parts) for parts in sent.value]
            words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            for trie in tries:
                has, many, form, most = best(*trie.neighbours(words), trie, len(words))
                out = pa.record_batch([b.column("word"), pa.array(many), pa.array(form, pa.string()), pa.array(most)], names=["word", "n_near", "near", "near_n"])
                yield out.filter(pa.array(has))

    return each


def nearest(store: Store, words: DataFrame, most: int = WORDS) -> DataFrame:
    """word, n_near, near, near_n (the neighbour of largest n, ties the least, and its n) of the words with a neighbour. words: word, n, written."""
    spark = words.sparkSession
    total = words.count()
    if not total:
        return words.select("word", F.col("n").alias("n_near"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    parts = -(-total // most)
    names = [name for name, _ in Trie.ARRAYS]
    ranged = words.repartitionByRange(parts, "word").coalesce(parts)  # a shard holds words that begin alike, so most others leave it at once
    shards = ranged.select("word", "n").mapInArrow(_packer(most), ", ".join(f"{name} binary" for name in names))
    shards = store.write(shards.withColumn("shard", F.monotonically_increasing_id()).withColumn("bytes", sum(F.length(name) for name in names)))
    dealt = store.write(words.select("word").repartition(max(1, -(-total // TASK)), "word"))
    waves: list[list[int]] = []
    room = 0
    for k, size in shards.select("shard", "bytes").sort("shard").collect():  # a row for each shard of most words
        if not waves or room + size > SENT:
            waves.append([])
            room = 0
        waves[-1].append(k)
        room += size
    found = None
    for wave in waves:
        rows = shards.filter(F.col("shard").isin(wave)).select(*names).toArrow().to_pylist()
        sent = spark.sparkContext.broadcast([[row[name] for name in names] for row in rows])
        part = store.write(dealt.mapInArrow(_walker(sent), "word string, n_near long, near string, near_n long"))
        found = part if found is None else found.unionByName(part)
        sent.destroy()
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first["near"].alias("near"), (-first["less"]).alias("near_n"))


def roots(store: Store, forms: DataFrame) -> DataFrame:
    """word, root for each row of forms (word, form): the last form reached."""
    now = store.write(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not now.filter("open").isEmpty():
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = store.write(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        store.drop(now)
        now = new
    return now.select("word", "root")


def variants(words: DataFrame, most: int = WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of vocabulary()."""
    store = Store(words.sparkSession)
    words = store.write(words)
    near = nearest(store, words, most)
    held = store.write(words.join(near, "word", "left").withColumn("form", F.when(F.col("near_n") >= TIMES * F.col("n"), F.col("near"))))
    last = roots(store, held.filter("form IS NOT NULL").select("word", "form"))
    out = held.join(last, "word", "left")
    form_n = F.when(F.col("form").isNotNull(), F.col("near_n"))
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(runs(table(spark, sf_dir, "documents").select("doc_id", "text"))))


#: CRC-32 by its table; near words meet under what is left when a letter is taken out.
SQL = r"""
WITH RECURSIVE tab AS (SELECT [list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) FOR i IN range(256)] AS tab),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
h AS (SELECT run, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT] ELSE [192::UBIGINT + (ord(c) >> 6), 128::UBIGINT + (ord(c) & 63)] END FOR c IN string_split(id || ':' || run, '')])),
  lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT)::BIGINT AS h FROM r, tab),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM s WHERE length(word) >= 6 GROUP BY 1 HAVING count(*) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON v.word = d.rest),
b AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM f UNION ALL SELECT c.word, coalesce(f.form, c.root), f.form IS NULL FROM c JOIN f ON f.word = c.root WHERE NOT c.done)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN (SELECT word, root FROM c WHERE done) USING (word)
"""
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": SQL}
