import hashlib
import itertools
import random
import re
import zlib

import pytest
from pairloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def told(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        solid = x.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "none")
        seen.add((r, x))
    return out


def brute(rows):
    """Every way to edit, tried: (cost, audit, repaired) of the best."""
    fault = faults(rows)
    each = []
    for (_, _, role, text), f in zip(rows, fault, strict=True):
        own = [("D", 4, [])]
        if f not in ("blank", "duplicate"):
            more = 3 * (f == "truncated")
            own += [("K", more, [(role, text)]), *[("R", 3 + more, [(r, text)]) for r in ("user", "assistant")]]
        each.append(own)
    gap = [("I" * n, 3 * n, [(r, "") for r in rs]) for n in range(3) for rs in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(*[x for own in each for x in (gap, own)], gap):
        cost, audit, said = sum(e[1] for e in edits), "".join(e[0] for e in edits), [t for e in edits for t in e[2]]
        if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in said) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said)):
            best = (cost, audit, "\n".join(f"{r}:{x}" for r, x in said))
    return best


def want(rows, exact=True):
    out = {}
    for c in {r[0] for r in rows}:
        own = told([r for r in damage(rows) if r[0] == c])
        f, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, text = brute(own) if exact and own else (0, "", "") if exact else (None,) * 3
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest() if exact else None)
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    ids = df.select(repair._key(df["conv_id"]).alias("k"))
    return {None if r[0] == " " else int(r[0]): tuple(r[1:]) for r in repair.repair(repair.damaged(df), ids, **more).collect()}


def odd_rows(n, seed, turns=4):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "three", "", " \n", "Four? \t", None, "é."]
    return [(c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(1, turns))]


def test_edits_are_the_cheapest(spark):
    rows = odd_rows(60, 1) + [(None, 0, "user", "No id."), (None, 1, "user", "No id.")]
    assert got(spark, rows) == want(rows)


@pytest.mark.parametrize("segment", [2, 9])
def test_segments_change_nothing(spark, segment):
    rng = random.Random(5)
    rows = [(c, t if t % 5 else 5, rng.choice(["user", "assistant", "tool"]), f"Said {rng.randrange(30)}{rng.choice('.!a')}") for c in range(4) for t in range(30)]
    rows += odd_rows(20, 2)
    whole = got(spark, rows)
    assert whole == got(spark, rows, segment=segment)
    counted = want(rows, exact=False)
    assert {c: v[:5] for c, v in whole.items()} == {c: v[:5] for c, v in counted.items()}


def test_turns_are_repaired(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be."), (2, 1, "assistant", "So."), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for k, at, role, text in sorted(map(tuple, repair.repaired_turns(repair.plain(df)).collect())):
        out.setdefault(k, []).append((role, text))
        assert at == len(out[k]) - 1
    assert out == {"1": [("user", "Hi."), ("assistant", ""), ("user", "And?"), ("assistant", "Yes.")], "2": [("system", "Be."), ("user", ""), ("assistant", "So.")]}


def test_long_texts_repeats_and_extra_columns(spark):
    long = "word " * 200_000 + "end."
    rows = [(7, 0, "user", long), *[(7, 1, "assistant", "Same.")] * 500, (7, 2, "user", " " * 100_000)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", k string, audit string, m int")
    ids = df.select(repair._key(df["conv_id"]).alias("k"))
    (r,) = repair.repair(repair.plain(df), ids).collect()
    assert r["audit"] == "KK" + "D" * 500 and r["duplicate"] == 499 and r["blank"] == 1 and r["cost"] == 2000 and r["illegal"] == 499
    assert r["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:Same.".encode()).hexdigest()


def test_empty_table(spark):
    assert got(spark, []) == {}
