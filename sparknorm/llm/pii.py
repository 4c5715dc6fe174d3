"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``://``, digits,
a plus before a digit, and cues of accounts and secrets. A parser for each kind
grows a span from its anchor by local rules and validates it. Parsers skip
anchors inside what they have read, and what they read without success ends
before the next anchor of their kind or after a bounded length, so a text is
read in linear time.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches
of the patterns below with their checks; iban, account, url and secret are added
and never take a base span away. Of two spans of one kind that could overlap the
leftmost counts.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, per_slice

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "url", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# an account cue may be part of a compound word: Kontonummer, accounts, Girokonto
_ACCOUNT = re.compile(r"[A-Za-z\u00c0-\u024f]{0,12}[\x20:#.=]{0,3}(?:(?:no|nr|num|number|numero|id)\b[\x20:#.=]{0,3})?([0-9](?:[\x20-]?[0-9]){5,19})(?![A-Za-z0-9])", re.IGNORECASE)
_SECRET = re.compile(r"[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9_+/=-]{16,})")
_SCHEMES = frozenset(("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss"))
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_AUTHORITY = re.compile(r"[^\s<>\"'`{}|\\^\[\]/?#]*")
_HOST = re.compile(r"(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\.?|localhost)(?::[0-9]+)?")
_TAIL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]*")
_TRAIL = frozenset(".,;:!?)*_~")
_CUES = ("account", "acct", "konto", "compte", "cuenta", "iban")
_KEYS = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if not i % 2 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("://", ("u", 3))
    for d in "0123456789":
        found.add_word(d, ("d", 1))
        found.add_word("+" + d, ("+", 2))
    for cue in _CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, ("c", len(cue)))
    for cue in _KEYS:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, ("k", len(cue)))
    found.make_automaton()
    return found


def find(text: str) -> list[Span]:
    """All spans, by start and then kind. No text: none."""
    out: list[Span] = []
    add = lambda kind, start, end: out.append(Span(kind, start, end))
    mail = ip = card = phone = account = url = iban = secret = 0  # where each parser may go on
    for last, (tag, width) in _anchors().iter(text):
        at = last + 1 - width
        if tag == "d":
            if at >= ip:
                if m := _IP.match(text, at):
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x[-4:] if not x[:-4].strip("0") else "999" for x in m.groups())):
                        add("ip", at, m.end())
                    ip = m.end()
                else:  # nor can a match begin later in this run of digits
                    ip = _DIGITS.match(text, at).end()
            if at >= card:
                if m := _CARD.match(text, at):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, m.end())
                    card = m.end()
                else:
                    card = at + 1
            if at >= iban and at >= 2 and text[at - 1].isupper() and (m := _IBAN.match(text, at - 2)) and not text[at - 3 : at - 2].isalnum():
                if 15 <= len(s := m[0].replace(" ", "")) <= 34 and iban_ok(s):
                    add("iban", at - 2, m.end())
                    iban = m.end()
        elif tag == "@":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
                mail = m.end()
        elif tag == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", at, m.end())
                phone = m.end()
        elif tag == "u":
            start = at
            while at - start < 6 and start and text[start - 1] in _LETTERS:
                start -= 1
            if at >= url and text[start:at].lower() in _SCHEMES and not text[start - 1 : start].isalnum():
                end = stop = _AUTHORITY.match(text, last + 1).end()  # it ends at the slash of the next scheme at the latest
                whole = text[stop : stop + 1] not in ("/", "?", "#")
                while whole and end > last + 1 and text[end - 1] in _TRAIL:
                    end -= 1
                if _HOST.fullmatch(text[last + 1 : end].rpartition("@")[2]):
                    if not whole:
                        end = _TAIL.match(text, stop).end()
                        while end > stop and text[end - 1] in _TRAIL:
                            end -= 1
                    add("url", start, end)
                    url = end
        elif tag == "k":
            if at >= secret and (m := _SECRET.match(text, last + 1)):
                if any(c.isdigit() for c in m[1]):
                    add("secret", m.start(1), m.end(1))
                secret = m.end()
        elif at >= account and not text[max(0, at - 1) : at].isdigit() and (m := _ACCOUNT.match(text, last + 1)):
            add("account", m.start(1), m.end(1))
            account = m.end()
    return sorted(set(out), key=lambda s: (s.start, _RANK[s.kind]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earliest, then the longest. A null text stays null."""
    if not text:
        return text
    out, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end, _RANK[s.kind])):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
            at = s.end
        elif s.end > at:  # what sticks out of an earlier span
            at = s.end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_spans) of every row; offsets in code points, ends exclusive.

    A null or empty text has no spans. Rows are kept as they are, repeated ones too.
    """

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found = [find(t) for t in texts]
        base = [[s for s in f if s.kind in BASE] for f in found]
        counts = {f"n_{k}": pa.array([sum(s.kind == k for s in b) for b in base], pa.int64()) for k in BASE}
        return pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | counts | {"base": pa.array([joined(b) for b in base], pa.string()), "spans": pa.array([joined(f) for f in found], pa.string()), "n_spans": pa.array([len(f) for f in found], pa.int64())})

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(per_slice(run, "t"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long")


def masked(text: Column) -> Column:
    """``mask`` as a column."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    return run(text)


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
