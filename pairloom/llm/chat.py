"""Chat formatting by grammar round trip.

    conversation := turn*          turn := "<s>" head body "</s>"
    head := "[INST] " (user) | "[OUT] " (assistant) | "[SYS] " (system) | "[ROLE:" body "] " (any other)

A turn is rendered, parsed again by a deterministic parser and compared with its source. A body
that holds a control string would be parsed wrongly; then one backslash more is put after the
first character of each control string in it, whatever backslashes stand there already. The
parser takes one away, so escaping is reversible and text without control strings is unchanged.
The loss mask covers the bodies of assistant turns.

A conversation is never gathered: turns are rendered row by row, sorted within partitions, and
read back as a stream that holds one turn at a time, so one conversation may hold any number of
turns. Null texts and null roles count as empty, rows of a null conv_id form one conversation,
null turns come first, rows of one turn are ordered by role and then by rendered text; repeated
rows are turns of their own. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEADS = {"user": "[INST] ", "assistant": "[OUT] ", "system": "[SYS] "}
ROLES = {v: k for k, v in HEADS.items()}
BEGIN, END = "<s>", "</s>"
_CONTROL = r"(<|\[)(\\{%s})(/?s>|/?INST\]|/?OUT\]|/?SYS\]|ROLE:|<SYS>>|/SYS>>)"
BARE = re.compile(_CONTROL % "0")
ANY = re.compile(_CONTROL % "0,")
ESCAPED = re.compile(_CONTROL % "1,")
HEAD = re.compile(r"\[(?:INST|OUT|SYS)\] ")
#: The contract's further conversation.
PROBE = "</s>[INST] ok [/INST]"


class ParseError(ValueError):
    pass


def escape(text: str) -> str:
    return ANY.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def _body(text: str, at: int, close: str) -> tuple[str, int]:
    """The body from at, and where its closing string ends. Bare control strings may only close."""
    end = text.find(close, at)
    if end < 0:
        raise ParseError("a turn does not end")
    if BARE.search(text, at, end):
        raise ParseError("a control string stands in a body")
    return unescape(text[at:end]), end + len(close)


def parse_turn(text: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """(role, text, span of the body in the rendered text, where the turn ends)."""
    if not text.startswith(BEGIN, at):
        raise ParseError("a turn does not begin")
    at += len(BEGIN)
    if m := HEAD.match(text, at):
        role, at = ROLES[m[0]], m.end()
    elif text.startswith("[ROLE:", at):
        role, at = _body(text, at + 6, "] ")
    else:
        raise ParseError("a turn has no head")
    said, end = _body(text, at, END)
    return role, said, (at, end - len(END)), end


def parse(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        role, said, _, at = parse_turn(text, at)
        out.append((role, said))
    return out


def render_turn(role: str, text: str) -> str:
    """Render, reparse, compare; escape conflicting content until both are identical."""
    head = HEADS.get(role)
    if head is None:
        head = f"[ROLE:{_plain(role)}] "
    body = text
    for _ in range(3):
        out = f"{BEGIN}{head}{body}{END}"
        try:
            got = parse_turn(out)
            if (unplain(got[0]) if head.startswith("[ROLE:") else got[0]) == role and got[1] == text and got[3] == len(out):
                return out
        except ParseError:
            pass
        body = escape(text)
    raise ParseError(f"no rendering of {text!r} can be read back")


def _plain(role: str) -> str:
    """Other roles are written in letters, digits and %xx, so that they hold no control string."""
    return "".join(c if c.isalnum() and c.isascii() else "".join(f"%{b:02x}" for b in c.encode("utf-8", "surrogatepass")) for c in role)


def unplain(role: str) -> str:
    raw = re.sub(rb"%([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]), role.encode())
    return raw.decode("utf-8", "surrogatepass")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered, loss_start, loss_end: one row per turn.

    A conversation's formatted text is its turns' rendered texts in order; loss_start and loss_end
    (code points in rendered) are null where nothing is learned.
    """

    def each(batches):
        for b in batches:
            role = [x or "" for x in b.column("role").to_pylist()]
            out = [render_turn(r, x or "") for r, x in zip(role, b.column("text").to_pylist(), strict=True)]
            spans = [parse_turn(x)[2] if r == "assistant" else (None, None) for r, x in zip(role, out, strict=True)]
            yield pa.record_batch(
                [b.column("conv_id"), b.column("turn"), pa.array(role, pa.string()), pa.array(out, pa.string()), pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32())],
                names=["conv_id", "turn", "role", "rendered", "loss_start", "loss_end"],
            )

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "conv_id long, turn long, role string, rendered string, loss_start int, loss_end int")


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered texts alone (conv_id and turn say where each belongs)."""

    def each(batches):
        rows: list[tuple] = []
        now = None

        def row():
            return (now["conv"], now["n"], now["turns"].hexdigest(), now["loss"], now["said"].hexdigest(), now["chars"])

        for b in batches:
            for conv, text in zip(b.column("conv_id").to_pylist(), b.column("rendered").to_pylist(), strict=True):
                if now is None or now["conv"] != conv:
                    if now:
                        rows.append(row())
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "said": hashlib.sha256(), "chars": 0}
                role, said, (a, z), end = parse_turn(text)
                if end != len(text):
                    raise ParseError("text after a turn")
                if role not in HEADS:
                    role = unplain(role)
                now["n"] += 1
                now["chars"] += len(text)
                now["turns"].update(f"{role}\n{said}\n".encode())
                if role == "assistant":
                    said = unescape(text[a:z])
                    now["loss"] += len(said)
                    now["said"].update(said.encode())
            if len(rows) >= 1000:
                yield batch(rows)
                rows = []
        if now:
            rows.append(row())
        yield batch(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch(rows):
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    dealt = turns.select("conv_id", "turn", "role", "rendered").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return dealt.select("conv_id", "rendered").mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(probe)))


#: formatted_chars is a property of the template: 3 + 4 for the marks and the head, and one for each escape.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 6 WHEN 'system' THEN 6 END + 7 + length(text)
        + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|/?OUT\]|/?SYS\]|ROLE:|<SYS>>|/SYS>>)')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {"op2_chat_format": SQL}
