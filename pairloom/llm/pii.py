"""Personal data: expressions propose spans, validators confirm them, words nearby adjust the score.

Kinds: email, ip, card, phone (the base kinds; their rules are fixed and spans found by them always
stay), and this operator's own: iban (the country's length, mod-97) and secret (a run of 20 or more
letters, digits, _ and - that has at least 4 digits and a letter: a key or token). Offsets are code
points, the end exclusive. Each kind is matched leftmost and without overlap; a base match that its
validator refuses is dropped, and the search goes on behind it. The patterns are written so that the
scan is linear in the text: an e-mail is sought from its @, digit runs are taken whole, and a text
without a kind's characters is not scanned for it.

score: a base per kind, raised by 0.2 if one of the kind's context words stands within WINDOW
characters, lowered by 0.3 if a word that speaks against it does. The operator's own spans stay if their
score is KEEP or more: an iban goes if only a contrary word is near, a secret stays only with a
supporting word. op10_pii returns the scores in the column scores, in the order of spans.

Null and empty texts have no spans; very long texts and runs are scanned whole. Repeated rows stay
repeated; spans of several kinds that begin together are ordered by kind; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

KINDS = ["email", "ip", "card", "phone", "iban", "secret"]
BASE = 4
WINDOW, KEEP = 40, 0.5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LONG = re.compile(r"[0-9](?:[ -]?[0-9]){11}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
# The length of an IBAN by country.
_LENGTHS = """
AD 24, AE 23, AL 28, AT 20, AZ 28, BA 20, BE 16, BG 22, BH 22, BI 27, BR 29, BY 28, CH 21, CR 22, CY 28, CZ 24, DE 22, DJ 27,
DK 18, DO 28, EE 20, EG 29, ES 24, FI 18, FK 18, FO 18, FR 27, GB 22, GE 22, GI 23, GL 18, GR 27, GT 28, HR 21, HU 28, IE 22,
IL 23, IQ 23, IS 26, IT 27, JO 30, KW 30, KZ 20, LB 28, LC 32, LI 21, LT 20, LU 20, LV 21, LY 25, MC 27, MD 24, ME 22, MK 19,
MN 20, MR 27, MT 31, MU 30, NI 28, NL 18, NO 15, OM 23, PK 24, PL 28, PS 29, PT 25, QA 29, RO 24, RS 22, RU 33, SA 24, SC 31,
SD 18, SE 24, SI 19, SK 24, SM 27, SO 23, ST 25, SV 28, TL 23, TN 24, TR 26, UA 29, VA 22, VG 24, XK 20
"""
_REST = {c: re.compile(r"(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (int(n) - 4)) for c, n in (x.split() for x in _LENGTHS.split(","))}
#: Context words that raise or lower a kind's score.
FOR = {"email": "mail contact write", "ip": "ip address server host", "card": "card visa credit payment", "phone": "call phone tel mobile fax", "iban": "iban bank account transfer", "secret": "token secret key password passwd auth credential"}
AGAINST = {"email": "example noreply", "ip": "version release", "card": "order ticket serial", "phone": "order serial version", "iban": "serial part product", "secret": "commit checksum digest revision"}
_FOR = {k: re.compile(r"\b(?:%s)" % v.replace(" ", "|"), re.I) for k, v in FOR.items()}
_AGAINST = {k: re.compile(r"\b(?:%s)" % v.replace(" ", "|"), re.I) for k, v in AGAINST.items()}
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "secret": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    if not _LONG.search(text):
        return []
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15] if "+" in text else []


def ibans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.end()
        rest = _REST.get(m[0][:2])
        if rest and (tail := rest.match(text, at)) and mod97((m[0] + tail[0]).replace(" ", "")):
            at = tail.end()
            out.append((m.start(), at))
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SECRET.finditer(text) if sum(c in "0123456789" for c in m[0]) >= 4 and any(c.isalpha() for c in m[0])]


_FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "secret": secrets}


def score(text: str, kind: str, a: int, z: int) -> float:
    near = f"{text[max(0, a - WINDOW) : a]} \n {text[z : z + WINDOW]}"
    return round(SCORE[kind] + 0.2 * bool(_FOR[kind].search(near)) - 0.3 * bool(_AGAINST[kind].search(near)), 3)


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, score), in the order of start, then of kind."""
    if not text:
        return []
    out = []
    for k, kind in enumerate(KINDS):
        for a, z in _FIND[kind](text):
            points = score(text, kind, a, z)
            if k < BASE or points >= KEEP:
                out.append((a, k, z, points))
    return sorted(out)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array<struct<kind, start, end, score>> for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def each(batches):
        for b in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": z, "score": s} for a, k, z, s in find(t.as_py())] for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:BASE]))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}


def plain_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by the contract's own expressions, for tests."""
    text = text or ""
    out = []
    for k, (kind, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and kind == "card" and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()
