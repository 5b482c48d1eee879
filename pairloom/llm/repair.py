"""Conversation structure repair: cheapest edits by a recursive DuckDB query inside hash-partitioned batches.

A conversation's turns should have the role initials (s?(ua)+)?. Edits: keep (K, 0), change the role
to user or assistant (R, 3), delete (D, 4; blank and repeated turns must go), insert an empty turn
of user or assistant anywhere (I, 3); a truncated turn that stays costs 3 more. The grammar has four states, and in each of
them only one role can be inserted or changed to, so an audit (the edits' initials in order) says
everything. Of equally cheap audits the ASCII-least one is taken. Two audits of equal cost that have consumed the same
turns never begin with each other (one more insertion would cost more), so the least audit of each
state is enough to go on with.

1. Rows that agree in conversation, turn, role and text are one unit with a number of copies
   (aggregated before the shuffle); the copies follow each other, so all but the first are deleted.
2. Units are dealt by a hash of (conversation, segment). A task gives batches of whole segments to DuckDB, whose
   recursion advances one unit of all segments of the batch at a time, and keeps of each state the
   least (cost, audit).
3. A conversation of more than SEGMENT units is cut into segments by a range partitioning of its
   units. Each segment is walked from every state, and neighbours are merged pair by
   pair in joins, so no task walks a whole long conversation.
4. The repaired texts are hashed as a stream, one conversation after another, which holds one unit
   at a time besides the audit (a letter a row, which the result has to hold anyway).

damaged() is the contract's damage. Null roles and texts count as one space, as do null ids within the
hash; null turns come first. Units of one turn are ordered by role, then by the SHA-256 of the text.
An empty role has no initial and can't be kept. A null conv_id is a conversation of its own.
Conversations without rows after the damage have zeros, an empty audit and the hash of nothing.
Very long texts are hashed whole. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Store, bounded_batches, table

#: Units of a conversation that are walked in one go; longer ones are cut.
SEGMENT = 1024
#: Units that a task gives to one recursive query, and partitions by which long conversations are cut at most.
BATCH, RANGES = 1 << 14, 4096
BLANKS = " \t\n\x0b\x0c\r"
KEEP, ROLE, DELETE, INSERT, OPEN = 0, 3, 4, 3, 3
#: state -> (the role that may come next besides a first "s", the state after it); 0 begin, 1 after s, 2 after u, 3 after a.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Letters that end a conversation in a state.
ENDS = {0: "", 1: "II", 2: "I", 3: ""}


def moves() -> list[tuple[int, str, str, str, int, int]]:
    """state, the unit's initial (any: *), letters, the last of them, their cost, the next state."""
    out = []
    for state in NEXT:
        out.append((state, "*", "D", "D", 0, state))
        for inserted in (0, 1):
            at = NEXT[state][1] if inserted else state
            role, to = NEXT[at]
            kept = [(role[0], to)] + ([("s", 1)] if at == 0 else [])
            out += [(state, c, "I" * inserted + "K", "K", INSERT * inserted + KEEP, t) for c, t in kept]
            out.append((state, "*", "I" * inserted + "R", "R", INSERT * inserted + ROLE, to))
    return out


#: The copies of a unit that stays are deleted, and so are all of one that goes.
WALK = f"""
WITH RECURSIVE moves(state, initial, letters, last, cost, nxt) AS (VALUES {", ".join(map(str, moves()))}),
walk(seg, start, pos, state, best) AS (
  SELECT seg, start, 0::BIGINT, start, (0::BIGINT, '') FROM segments
  UNION ALL
  SELECT w.seg, w.start, t.pos, m.nxt, min((
    w.best[1] + m.cost + CASE m.last WHEN 'D' THEN {DELETE} * t.m ELSE {DELETE} * (t.m - 1) + {OPEN} * t.truncated END,
    w.best[2] || m.letters || repeat('D', t.m - 1)))
  FROM walk w JOIN units t ON t.seg = w.seg AND t.pos = w.pos + 1
  JOIN moves m ON m.state = w.state AND (m.last = 'D' OR t.gone = 0 AND m.initial IN ('*', t.initial))
  GROUP BY ALL)
SELECT w.seg, w.start, w.state, w.best[1] AS cost, w.best[2] AS audit FROM walk w JOIN segments s USING (seg, start) WHERE w.pos = s.n
"""


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def plain(conversations: DataFrame) -> DataFrame:
    """k (the conversation as text; a space for null), turn, role, text, m of every row as it is."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(_key(F.col("conv_id")).alias("k"), F.col("turn").cast("long").alias("turn"), *said, F.lit(1).cast("long").alias("m"))


def damaged(conversations: DataFrame) -> DataFrame:
    """plain() after the damage; m is the number of adjacent copies."""
    kind = F.crc32(F.concat("k", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = plain(conversations).withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("k", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("m"))


def units(rows: DataFrame) -> DataFrame:
    """k, turn, role, same (the text's SHA-256), text, m, fault (of the first copy: blank, duplicate, truncated or none)."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    own = rows.groupBy("k", "turn", "role", "text").agg(F.sum("m").alias("m"))
    own = own.withColumn("same", F.sha2("text", 256)).withColumn("last", last)
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    again = own.groupBy("k", "role", "same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", "role", "same", "first")
    met = own.join(again, ["k", "role", "same"], "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate")
    fault = fault.when(F.instr(F.lit(".!?"), F.col("last")) == 0, "truncated").otherwise("none")
    return met.select("k", "turn", "role", "same", "text", "m", fault.alias("fault"))


def _segments(store: Store, own: DataFrame, segment: int) -> DataFrame:
    """Units without text, and seg: 0 for a whole conversation, else 1, 2, ... in order."""
    light = own.select("k", "turn", "role", "same", "m", "fault")
    big = light.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segment)
    big = store.write(big)
    total = big.agg(F.sum("n")).first()[0]
    if not total:
        return light.withColumn("seg", F.lit(0).cast("long"))
    order = ["k", "turn", "role", "same"]
    cut = light.join(big.select("k"), "k").repartitionByRange(min(RANGES, -(-total // segment)), *order).sortWithinPartitions(*order)
    cut = store.write(cut.withColumn("piece", F.floor(F.monotonically_increasing_id() / segment)))  # written, as it depends on the partitions
    ranks = cut.select("k", "piece").distinct().withColumn("seg", F.row_number().over(W.partitionBy("k").orderBy("piece")).cast("long"))
    return light.join(big.select("k"), "k", "left_anti").withColumn("seg", F.lit(0).cast("long")).unionByName(cut.join(ranks, ["k", "piece"]).drop("piece"))


def whole_groups(batches, keys: list[str], rows: int):
    """(table, where groups begin and the last ends): about rows rows of whole groups, from batches sorted by keys."""
    held: list[pa.Table] = []
    n = 0

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for c in keys:
            col = t[c].to_numpy()
            new |= col[1:] != col[:-1]
        return np.flatnonzero(new) + 1

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n >= rows:
            t = pa.concat_tables(held)
            at = cuts(t)
            if len(at):
                last = int(at[-1])
                yield t.slice(0, last), np.concatenate(([0], at))
                t = t.slice(last)
            held, n = [t], t.num_rows
    if held and (t := pa.concat_tables(held)).num_rows:
        yield t, np.concatenate(([0], cuts(t), [t.num_rows]))


def _walker(batches):
    import duckdb

    db = duckdb.connect(config={"threads": 1})
    for t, bounds in whole_groups(batches, ["k", "seg"], BATCH):
        n = np.diff(bounds)
        group = np.repeat(np.arange(len(n)), n)
        db.register("units", t.select(["m", "initial", "gone", "truncated"]).append_column("seg", pa.array(group)).append_column("pos", pa.array(np.arange(t.num_rows) - bounds[:-1][group] + 1)))
        whole = t["seg"].to_numpy()[bounds[:-1]] == 0
        starts = [np.flatnonzero(whole)] + [np.flatnonzero(~whole)] * 4
        db.register("segments", pa.table({"seg": np.concatenate(starts), "start": np.repeat([0, 0, 1, 2, 3], [len(s) for s in starts]), "n": n[np.concatenate(starts)]}))
        got = db.sql(WALK).to_arrow_table()
        at = pa.array(bounds[:-1][got["seg"].to_numpy()])
        out = [t["k"].take(at), t["seg"].take(at), got["start"].cast(pa.int32()), got["state"].cast(pa.int32()), got["cost"].cast(pa.int64()), got["audit"].cast(pa.string())]
        yield from pa.table(out, names=["k", "seg", "start", "state", "cost", "audit"]).to_batches()


def _least() -> list[Column]:
    best = F.min(F.struct("cost", "audit"))
    return [best["cost"].alias("cost"), best["audit"].alias("audit")]


def _merged(store: Store, parts: DataFrame) -> DataFrame:
    """Walks of neighbouring segments joined on the state between them, pair by pair, until each conversation has one."""
    most = parts.agg(F.max("seg")).first()[0] or 0
    parts = parts.withColumn("seg", F.col("seg") - 1)
    while most > 1:
        pair = F.floor(F.col("seg") / 2).alias("pair")
        one = parts.filter("seg % 2 = 0").select("k", pair, "start", F.col("state").alias("between"), F.col("cost").alias("c1"), F.col("audit").alias("a1"))
        two = parts.filter("seg % 2 = 1").select("k", pair, F.col("start").alias("between"), "state", F.col("cost").alias("c2"), F.col("audit").alias("a2"))
        both = one.join(two, ["k", "pair", "between"]).select("k", F.col("pair").alias("seg"), "start", "state", (F.col("c1") + F.col("c2")).alias("cost"), F.concat("a1", "a2").alias("audit"))
        both = both.groupBy("k", "seg", "start", "state").agg(*_least())
        alone = one.join(two.select("k", "pair").distinct(), ["k", "pair"], "left_anti").select("k", F.col("pair").alias("seg"), "start", F.col("between").alias("state"), F.col("c1").alias("cost"), F.col("a1").alias("audit"))
        parts = store.write(both.unionByName(alone))
        most = -(-most // 2)
    return parts


def audits(store: Store, own: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """k, cost, audit of each conversation of units()."""
    rows = _segments(store, own, segment)
    rows = rows.select("k", "seg", "turn", "role", "same", "m", F.left("role", F.lit(1)).alias("initial"), F.col("fault").isin("blank", "duplicate").cast("int").alias("gone"), (F.col("fault") == "truncated").cast("int").alias("truncated"))
    dealt = rows.repartition("k", "seg").sortWithinPartitions("k", "seg", "turn", "role", "same")
    walks = store.write(dealt.mapInArrow(_walker, "k string, seg long, start int, state int, cost long, audit string"))
    done = walks.filter("seg = 0").unionByName(_merged(store, walks.filter("seg > 0"))).filter("start = 0")
    letters = F.element_at(F.array(*[F.lit(ENDS[s]) for s in range(4)]), F.col("state") + 1)
    done = done.select("k", (F.col("cost") + INSERT * F.length(letters)).alias("cost"), F.concat("audit", letters).alias("audit"))
    return done.groupBy("k").agg(*_least())


class _Told:
    """One conversation as its units pass by."""

    def __init__(self, k: str, cost: int, audit: str):
        self.k, self.cost, self.audit, self.at, self.state = k, cost, audit, 0, 0
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "none"), 0)
        self.illegal, self.before = 0, None
        self.low = self.high = self.turn = None
        self.turns = 0
        self.digest, self.said = hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.said else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.said = True

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = NEXT[self.state]
            self.say(role, "")
            self.at += 1

    def unit(self, turn: int | None, role: str, text: str, m: int, fault: str) -> None:
        first = role[:1]
        self.illegal += (self.before is not None and self.before + first not in ("su", "ua", "au")) + (m - 1)
        self.before = first
        self.count[fault] += m if fault in ("blank", "duplicate") else 1
        if fault in ("truncated", "none"):
            self.count["duplicate"] += m - 1
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.inserted()
        letter = self.audit[self.at]
        if letter == "R":
            role, self.state = NEXT[self.state]
        elif letter == "K":
            self.state = 1 if first == "s" else NEXT[self.state][1]
        if letter != "D":
            self.say(role, text)
        self.at += m

    def row(self) -> tuple:
        self.inserted()
        if self.at != len(self.audit):
            raise ValueError(f"the audit of conversation {self.k} does not fit its turns")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.k, gaps, self.count["blank"], self.count["duplicate"], self.count["truncated"], self.illegal, self.cost, self.audit, self.digest.hexdigest())


def _teller(batches):
    """From rows sorted by conversation, its header (kind 0, the audit as text, the cost as m) before its units."""
    now, rows = None, []

    def batch():
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        for kind, k, turn, role, text, m, fault in zip(*[b.column(c).to_pylist() for c in ("kind", "k", "turn", "role", "text", "m", "fault")], strict=True):
            if kind == 0:
                if now:
                    rows.append(now.row())
                now = _Told(k, m, text)
            else:
                now.unit(turn, role, text, m, fault)
        if len(rows) >= 1000:
            yield batch()
            rows = []
    if now:
        rows.append(now.row())
    yield batch()


def repair(rows: DataFrame, ids: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each k of ids: its faults, the cheapest edits and the hash of what they leave. rows: see plain()."""
    store = Store(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    own = store.write(units(rows))
    heads = ids.select("k").distinct().join(audits(store, own, segment), "k", "left")
    heads = heads.select("k", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("same"), F.coalesce("audit", F.lit("")).alias("text"), F.coalesce("cost", F.lit(0)).alias("m"), F.lit("").alias("fault"))
    told = heads.unionByName(own.withColumn("kind", F.lit(1))).repartition("k").sortWithinPartitions("k", "kind", "turn", "role", "same")
    return told.mapInArrow(_teller, "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """k, at (from 0), role, text: the repaired conversations themselves, turn by turn. rows: see plain()."""
    store = Store(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    own = store.write(units(rows))
    heads = audits(store, own, segment).select("k", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("same"), F.col("audit").alias("text"), F.col("cost").alias("m"), F.lit("").alias("fault"))

    def each(batches):
        now, out = None, []

        def speak(role, text):
            out.append((now.k, now.place, role, text))
            now.place += 1

        for b in batches:
            for kind, k, turn, role, text, m, fault in zip(*[b.column(c).to_pylist() for c in ("kind", "k", "turn", "role", "text", "m", "fault")], strict=True):
                if kind == 0:
                    if now:
                        now.inserted()
                    now = _Told(k, m, text)
                    now.place, now.say = 0, speak
                else:
                    now.unit(turn, role, text, m, fault)
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["k", "at", "role", "text"])
            out = []
        if now:
            now.inserted()
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["k", "at", "role", "text"])

    told = heads.unionByName(own.withColumn("kind", F.lit(1))).repartition("k").sortWithinPartitions("k", "kind", "turn", "role", "same")
    return told.mapInArrow(each, "k string, at long, role string, text string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    out = repair(damaged(rows), rows.select(_key(F.col("conv_id")).alias("k")))
    conv_id = F.when(F.col("k") != " ", F.col("k")).cast("long").alias("conv_id")
    return out.select(conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: CRC-32 by its table; the walk goes row by row, and carries the repaired text along with the audit.
SQL = r"""
WITH RECURSIVE tab AS (SELECT [list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) FOR i IN range(256)] AS tab),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
    lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) % 20 AS kind FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM d),
f AS (SELECT *, left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS after,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (after IS NOT NULL AND initial || after NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
next(state, role, nxt) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2), (0, 'system', 1)),
w(conv_id, pos, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, (0::BIGINT, '', '') FROM s
  UNION ALL
  SELECT conv_id, pos, state, min(best) FROM (
    SELECT w.conv_id, f.pos, CASE WHEN e.e = 'D' THEN w.state ELSE y.nxt END AS state,
      (w.best[1] + 3 * e.i + CASE e.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.e <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END,
       w.best[2] || repeat('I', e.i) || e.e,
       w.best[3] || CASE WHEN e.i = 1 THEN x.role || ':' || chr(10) ELSE '' END || CASE e.e WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE y.role || ':' || f.text || chr(10) END) AS best
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
    JOIN (VALUES (0, 'K'), (1, 'K'), (0, 'R'), (1, 'R'), (0, 'D')) e(i, e) ON e.e = 'D' OR f.fault NOT IN ('blank', 'duplicate')
    JOIN next x ON x.state = w.state AND x.role <> 'system'
    JOIN next y ON y.state = CASE WHEN e.i = 1 THEN x.nxt ELSE w.state END AND CASE e.e WHEN 'K' THEN left(y.role, 1) = f.initial ELSE y.role <> 'system' END)
  GROUP BY ALL),
z AS (SELECT w.conv_id, min((best[1] + 3 * length(l), best[2] || l, best[3] || CASE l WHEN 'II' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'I' THEN 'assistant:' || chr(10) ELSE '' END)) AS best
  FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = s.n JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) e(state, l) USING (state) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best[1], 0)::BIGINT AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(left(best[3], length(best[3]) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES = {"op12_conversation_repair": SQL}
