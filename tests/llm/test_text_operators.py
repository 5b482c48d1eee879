import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pairloom.llm import chat, decontam, jaccard, kernel, pii, quality, toxicity, url_rules
from pairloom.llm.common import Store
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# chat
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[OUT] ", "\\", "<", "[", "<<SYS>>", "[ROLE:", "]", " ok ", "é\n", "<\\s>", "[\\INST]", "%41"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8), st.sampled_from(["user", "assistant", "system", "", "tool] x", "%", "</s>"]))
def test_turns_round_trip(pieces, role):
    text = "".join(pieces)
    out = chat.render_turn(role, text)
    got, said, _, end = chat.parse_turn(out + chat.render_turn("user", "x"))
    assert said == text and end == len(out)
    assert (got if role in chat.HEADS else chat.unplain(got)) == role
    assert len(chat.BARE.findall(out)) == 3  # the turn's own begin, head and end


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "fine </s>"), (1, 0, "user", None), (1, 2, "assistant", "[INST]"), (2, 0, None, "x"), (None, 0, "user", "n"), (2, None, "user", "first")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, rendered int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    want = hashlib.sha256(b"user\n\nassistant\nfine </s>\nassistant\n[INST]\n").hexdigest()
    assert got[1]["turns_sha256"] == want and got[1]["n_turns"] == 3
    assert got[1]["loss_chars"] == 15 and got[1]["loss_sha256"] == hashlib.sha256(b"fine </s>[INST]").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\nfirst\n\nx\n").hexdigest() and got[2]["loss_chars"] == 0
    assert got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# urls
def test_url_rules(spark):
    urls = ["http://A.example.COM/en/7x?q", "https://com/en/", "x.example.net/de/8", "http://example.net/de/8", "http://example.net/de/9#a", None, "://", "http://badcom/en/1", "http://a.org/es/?x", "http://net", "http://example.com/en/7"]
    df = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)] + [(1, urls[1], "again")], "page_id long, url string, host string")
    got = url_rules.judge(df, url_rules.rules_table(spark), [len(r[1]) for r in url_rules.RULES]).collect()
    assert len(got) == len(urls) + 1
    said = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert said[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert said[1] == ("com", "/en/", "com/en/", "block") and said[2] == ("", "", None, "allow")
    assert said[3][2:] == ("example.net/de/8", "block") and said[4][2:] == ("net/de/", "allow")
    assert said[5] == ("", "", None, "allow") == said[6] and said[7][2:] == (None, "allow")
    assert said[8][2:] == ("org/es/", "block") and said[9] == ("net", "", None, "allow")
    assert url_rules.judge(df.limit(0), url_rules.rules_table(spark), [4]).count() == 0
    long = "http://" + "a." * 20 + "net/de/" + "x/" * 50_000
    (r,) = url_rules.judge(spark.createDataFrame([(1, long)], "page_id long, url string"), url_rules.rules_table(spark), [len(r[1]) for r in url_rules.RULES]).collect()
    assert (r["rule"], r["verdict"], len(r["path"])) == ("net/de/", "allow", 100_004)


# personal data
PARTS = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+49 (30) 1234567", "+1", " ", ",", "-", ".", "9", "a@b.c@d.e", "é"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_base_spans_are_those_of_the_expressions(parts):
    text = "".join(parts)
    got = [(pii.KINDS[k], a, z) for a, k, z, _ in pii.find(text) if k < pii.BASE]
    assert got == pii.plain_spans(text)


def test_pii_query(spark):
    text = "mail me: jo@ex.org, card 4111 1111 1111 1111. IBAN DE89 3704 0044 0532 0130 00 of my bank"
    df = docs(spark, [(1, text), (2, None), (3, ""), (1, text), (None, "9" * 50_000)])
    rows = pii.find_pii(df).collect()
    assert len(rows) == 5
    kinds = [x["kind"] for x in rows[0]["spans"]]
    assert kinds == ["email", "card", "iban"] and rows[0]["spans"][2]["score"] > 0.8
    assert not pii.ibans("DE89 3704 0044 0532 0130 01") and rows[4]["spans"] == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["0", "1", "25", "256", "4", ".", "-", " ", "+", "a@b.c", "(", "é"]), st.sampled_from([1, 2, 3, 13, 400])), max_size=8))
def test_base_spans_of_long_runs(parts):
    text = "".join(p * n for p, n in parts)
    assert [(pii.KINDS[k], a, z) for a, k, z, _ in pii.find(text) if k < pii.BASE] == pii.plain_spans(text)


def test_own_spans():
    assert [x[:3] for x in pii.find("0" * 5000 + ".1.1.1")] == [(0, 1, 5006)]
    iban = "DE89 3704 0044 0532 0130 00"
    assert pii.ibans(f"IBAN {iban} BANK and GB82 WEST 1234 5698 7654 32, DE89 3704 0044 0532 0130 0X NO9386011117947") == [(5, 32), (42, 69), (99, 114)]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"

    def kinds(text):
        return [pii.KINDS[k] for _, k, _, _ in pii.find(text)]

    assert kinds(f"serial {iban}") == [] and kinds(f"serial, bank {iban}") == ["iban"] and kinds(f"see {iban}") == ["iban"]
    assert kinds(f"see {key} there") == [] and kinds(f'token = "{key}"') == ["secret"] and kinds(f"commit token {key}") == []
    assert kinds("key entscheidungsproblematik_und_mehr") == [] and len(kinds(f"key {key} " * 3000)) == 3000


def test_pii_of_empty_and_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "card 4111111111111111", "x", 3)], "doc_id long, text string, spans string, score int")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pii.op10_pii(spark, f"{tmp_path}/a").first()["spans"] == "card:5:21" and pii.op10_pii(spark, f"{tmp_path}/b").count() == 0


# labels
def test_toxicity_learns_expressions(spark):
    rng = random.Random(3)
    vocab = [f"w{rng.randrange(10**6):06d}" for _ in range(300)]

    def text(bad):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = "vile" + rng.choice(["s", "st", "ly", ""])
        return " ".join(words)

    rows = [(i, text(i % 4 == 0)) for i in range(600)] + [(600, None), (601, ""), (602, "vilest vile of the vile"), (602, "vilest vile of the vile")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, rows)
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df.select("doc_id", "text"), model, ["doc_id"]).collect()}
    held = [i for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == (i % 4 == 0) for i in held]) > 0.95
    assert got[600] == got[601] == 0 and got[602] == 1
    kept = toxicity.keep_ordinary(df.withColumn("evidence", F.lit(1)), labels)
    assert kept.columns == [*df.columns, "evidence"] and kept.filter("doc_id IN (600, 601)").count() == 2 and kept.filter("doc_id = 602").count() == 0
    empty = toxicity.keep_ordinary(df.limit(0), labels.limit(0))
    assert empty.count() == 0
    assert toxicity.keep_ordinary(df, labels.limit(0)).count() == len(rows)


def test_quality_held_out(spark):
    rng = random.Random(5)
    good = ["the river bends toward the old mill", "a quiet morning brought the letter", "they walked along the shore"]
    rows = []
    for i in range(400):
        base = " ".join(rng.choice(good) + "." for _ in range(rng.randint(2, 9)))
        rows.append((i, base if i % 3 else base.replace(" ", "*** ")))
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)], "doc_id long, quality int")
    df = docs(spark, [*rows, (400, None), (401, "")])
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.97
    assert got[400] == got[401] and 0 <= got[400] <= 1
    one = quality.fit(df, labels.filter("quality = 1"))
    assert all(r["score"] == 1.0 for r in quality.score(df, one).collect())
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels.limit(0))).count() == 0


# near copies
def similar(a, b, percent):
    return len(a & b) * 100 >= percent * len(a | b)


def brute(texts, k, percent):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j], percent):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, k, percent):
    rng = random.Random(percent)
    texts = []
    for _ in range(12):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 15, 40, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"t{rng.randrange(400)}"
            texts.append(" ".join(w[: len(w) - rng.randint(0, len(w) // 12)]))
    texts += [None, "", "  ", "One two", "one TWO", "one", *[texts[0]] * 20]
    sizes, root = brute(texts, k, percent)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    got = {r["doc_id"]: r for r in jaccard.link(df, k, percent, Store(spark)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    kept = jaccard.keep_one(df, k, percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_jaccard_edges(spark):
    df = docs(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (5, "x y"), (5, "x y"), (None, None), (3, "a b c d e f g h i j k l"), (3, "p q r s t u v")])
    rows = jaccard.link(df, 4, 85, Store(spark)).collect()
    assert len(rows) == 7 and {r["component_id"] for r in rows if r["n_shingles"] == 3} == {7}
    assert jaccard.keep_one(df).count() == 5
    assert jaccard.link(df.limit(0), 4, 85, Store(spark)).count() == 0


def met(a, b, percent):
    """Whether two sets share as many signatures as both need, and one within the rarest of both, all being equally frequent."""
    sig, who, need = jaccard.signatures([np.sort(a), np.sort(b)], percent)
    one, two = set(sig[who == 0].tolist()), set(sig[who == 1].tolist())
    assert len(one) == (who == 0).sum() and len(two) == (who == 1).sum()
    both = one & two
    if not both:
        return False
    side = both.pop() & 1
    both = {s for s in one & two if s & 1 == side}
    enough = len(both) >= need[:, side].max()
    rarest = [set(sorted(s for s in x if s & 1 == side)[: sum(s & 1 == side for s in x) - need[i, side] + 1]) for i, x in enumerate((one, two))]
    return bool(enough and rarest[0] & rarest[1])


def test_signatures_never_miss_similar_sets():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        for size in [*range(5, 60), 100, 133, 250, 777]:
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            lost = int(rng.integers(0, size * (100 - percent) // 100 + 1))
            b = a[lost:]
            if len(b) * 100 < percent * size or not lost:
                continue
            assert met(a, b, percent), (percent, size, lost)


def test_signatures_of_all_sets_within_the_distance():
    universe = np.sort(kernel.mix(np.arange(1, 13, dtype=np.uint64)))
    for base in range(6, 12):
        a = universe[:base]
        for gone in itertools.chain.from_iterable(itertools.combinations(range(base), r) for r in range(3)):
            for new in itertools.chain.from_iterable(itertools.combinations(range(base, 12), r) for r in range(3)):
                b = np.concatenate([np.delete(a, gone), universe[list(new)]])
                same = base - len(gone)
                if (gone or new) and same * 100 >= 70 * (base + len(new)):
                    assert met(a, b, 70), (base, gone, new)


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 40, 50, 60, 300, 420, 5000)]
    sets += [np.concatenate([s[len(s) // 5 :], rng.integers(0, 1 << 63, 1 + len(s) // 9, dtype=np.uint64)]) for s in sets]
    marks = [jaccard.sketch(s) for s in sets]
    i, j = np.triu_indices(len(sets), 0)
    got = jaccard.differing(marks, i, j)
    for a, b, d in zip(i, j, got, strict=True):
        assert d <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))
        assert d % 2 == (len(sets[a]) + len(sets[b])) % 2
    assert jaccard.differing([], np.zeros(0, int), np.zeros(0, int)).size == 0


def test_forest_joins_what_the_edges_join():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m = int(rng.integers(2, 30)), int(rng.integers(0, 60))
        ends, label, cost = rng.integers(0, n, (2, m)), rng.integers(0, n, n) * 7, rng.integers(0, 9, m) / 3
        keep = jaccard.forest(ends, label, cost)

        def joined(edges, label=label):
            root = {int(x): int(x) for x in label}
            weight = 0
            for a, b, c in edges:
                x, y = root[int(label[a])], root[int(label[b])]
                if x != y:
                    weight += c
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
            return root, weight

        rows = list(zip(*ends.tolist(), cost.tolist(), strict=True))
        best = joined(sorted(rows, key=lambda r: r[2]))
        assert joined([rows[i] for i in keep])[0] == best[0]
        assert abs(sum(cost[keep]) - best[1]) < 1e-9
        assert len(keep) == len(set(label.tolist())) - len(set(best[0].values()))


@pytest.mark.parametrize("sent", [0])
def test_jaccard_groups_in_chunks(spark, monkeypatch, sent):
    """Many texts that share most signatures and are just not similar, in groups of more than one chunk; both ways to join."""
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "SENT", sent)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(2, 8)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sizes, root = brute(texts, 5, 70)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in jaccard.link(df, 5, 70, Store(spark)).collect()}
    assert 1 < len(set(root)) < 40
    assert [got[i]["component_id"] for i in range(len(texts))] == root


# benchmark
def edits(p, r):
    prev = list(range(len(r) + 1))
    prev = [0] * (len(r) + 1)
    for i, c in enumerate(p):
        cur = [prev[0] + 1]
        for j in range(1, len(r) + 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (r[j - 1] != c)))
        prev = cur
    return min(prev)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    letters = "abcdefgh "

    def word(n):
        return "".join(rng.choice(letters) for _ in range(n))

    items = [word(rng.randint(30, 120)) for _ in range(12)] + ["short", None, ""]
    texts = []
    for i in range(80):
        t = list(rng.choice(items[:12]))
        for _ in range(rng.randint(0, len(t) // 7)):
            t[rng.randrange(len(t))] = rng.choice(letters)
        texts.append(word(rng.randint(0, 150)) + "".join(t).upper() + word(rng.randint(0, 60)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, [*enumerate(texts), (80, None), (81, ""), (0, texts[0])])
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find(df, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, x in enumerate(items[:12]):
            folded, item = t.encode().translate(decontam.FOLD), x.encode().translate(decontam.FOLD)
            n = edits(item, folded)
            if n <= decontam.budget(len(item)):
                want[i, j] = n
    assert {k: r["edits"] for k, r in got.items()} == want
    for (i, j), r in got.items():
        part = texts[i][r["start"] : r["end"]].encode().translate(decontam.FOLD)
        assert edits(items[j].encode().translate(decontam.FOLD), part) == r["edits"]
    clean = decontam.clean(df.withColumn("item_id", F.lit(1)), bench)
    assert sorted({r["doc_id"] for r in clean.collect()}) == [i for i in range(82) if i not in {k[0] for k in want}]
    assert decontam.find(df, bench.limit(0)).count() == 0 and decontam.clean(df, bench.limit(0)).count() == 83


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 60)
    items = [f"the benchmark item number {i} is about thing {i * 7}" for i in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(decontam.indexes(bench)) > 2
    found = decontam.find(docs(spark, [(i, f"so {x} ends") for i, x in enumerate(items)]), bench).filter("edits = 0").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, i) for i in range(9)]


def test_threshold_of_empty_histograms():
    assert toxicity.threshold(np.zeros((2, toxicity.BINS), np.int64)) == 0.45


def test_words_of_a_long_text_are_scored_whole():
    model = toxicity.Marked(np.array([5], np.uint64), np.array([1.0]))
    got, n = model.sums(pa.array(["a " * 700_000, None]))
    assert got.tolist() == [0, 0] and n.tolist() == [700_000, 0]


def test_items_at_the_end_of_a_long_text():
    item = b"the quick brown fox jumps over the lazy dog and then some more"
    index = decontam.Index([3], [item])
    long = "x y z " * 400_000 + item.decode()
    got = index.matches(pa.array([long, "none", item.decode().upper() + "!"]))
    assert [(t, e, a) for t, _, e, a, _ in got] == [(0, 0, 2_400_000), (2, 0, 0)]


def test_pii_query_returns_scores_that_context_changes(spark, tmp_path):
    iban = "DE89 3704 0044 0532 0130 00"
    rows = [(1, f"my bank: {iban}"), (2, f"see {iban}"), (3, f"serial {iban}"), (4, "mail a@b.de or noreply"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    assert [got[k]["scores"] for k in range(1, 6)] == [[0.9], [0.7], [], [0.7], []]
    assert all(len(r["scores"]) == len([x for x in r["spans"].split(",") if x]) for r in got.values())
