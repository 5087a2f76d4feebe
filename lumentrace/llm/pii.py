"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, digits, plus
signs, schemes and identifier cues.  A local parser expands each anchor to its
span's bounds and validates it; parsers never look further than their span.

Base kinds (leftmost, non-overlapping for each kind; a span that fails its
check is dropped and not tried again): email, ip (parts up to 255), card (14 to
19 digits, Luhn), phone (10 to 15 digits).  Kinds the anchors add: ``address``
(a scheme's URL that holds a user part) and ``account`` (an IBAN with the right
check digits, or the value behind a cue such as ``token =`` or ``account no.``,
in either case of letters).

Edge cases: null text counts as empty; repeated rows and null ids get a result
row each; an empty table gives an empty result; columns besides doc_id and text
are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumentrace.llm.common import table

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "jdbc:", "postgres://", "mysql://", "redis://", "mongodb://")
#: Cues with an account value behind them, in lower case.
CUES = ("iban", "token", "account", "acct", "api_key", "apikey", "passport", "ssn", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_USER = re.compile(r"[^\s/@\"'<>]+@[^\s\"'<>]+")
NO_USER = re.compile(r"[^\s/@\"'<>]*")
CUE_VALUE = re.compile(r"(?:[\x20_-]?(?:no|number|id|key)\b\.?)?[\x20]*[=:][\x20]*[\"']?([A-Za-z0-9_-]{8,64})|[\x20:]+([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", re.ASCII)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def iban_valid(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lowered(text: str) -> str:
    """``text`` in lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def _email(text: str, at: int, floor: int):
    """Bounds around the at-sign at ``at``; nothing before ``floor`` belongs to it."""
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    tail = DOMAIN.match(text, at + 1) if begin < at else None
    return (begin, tail.end()) if tail else None


def _account(text: str, at: int):
    found = CUE_VALUE.match(text, at)
    if not found:
        return None
    group = 1 if found[1] else 2
    begin, end = found.span(group)
    if group == 2:
        while end > begin and not iban_valid(text[begin:end].replace(" ", "")):
            end -= 1
            while end > begin and text[end - 1] == " ":
                end -= 1
            if end - begin < 15:
                return None
        return begin, end
    value = found[1]
    if IBAN.fullmatch(value):
        return (begin, end) if iban_valid(value) else None
    return (begin, end) if sum(c.isdigit() for c in value) >= 4 else None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind."""
    found: list[tuple[str, int, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where each kind's search goes on
    userless = 0  # up to where no scheme finds a user part
    for last, (sort, length) in anchors.iter(lowered(text)):
        if sort == "digit":
            for kind, pattern in (("ip", IP), ("card", CARD)):
                if last < past[kind]:
                    continue
                if kind == "card" or last == 0 or not ("0" <= text[last - 1] <= "9") or past[kind] == last:
                    if hit := pattern.match(text, last):
                        past[kind] = hit.end()
                        if kind == "ip":
                            parts = [p.lstrip("0") or "0" for p in hit[0].split(".")]
                            good = all(len(p) < 4 and int(p) <= 255 for p in parts)
                        else:
                            digits = hit[0].replace(" ", "").replace("-", "")
                            good = 14 <= len(digits) <= 19 and luhn(digits)
                        if good:
                            found.append((kind, last, hit.end()))
        elif sort == "at":
            if last >= past["email"] and (hit := _email(text, last, past["email"])):
                past["email"] = hit[1]
                found.append(("email", *hit))
        elif sort == "plus":
            if last >= past["phone"] and (hit := PHONE.match(text, last)):
                past["phone"] = hit.end()
                if 10 <= sum("0" <= c <= "9" for c in hit[0]) <= 15:
                    found.append(("phone", last, hit.end()))
        elif sort == "scheme":
            begin = last + 1 - length
            if begin < past["address"] or last + 1 < userless:
                continue
            if hit := URL_USER.match(text, last + 1):
                past["address"] = hit.end()
                found.append(("address", begin, hit.end()))
            else:
                userless = NO_USER.match(text, last + 1).end()
        elif last >= past["account"] and (hit := _account(text, last + 1)):
            past["account"] = hit[1]
            found.append(("account", *hit))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _find(batches):
    anchors = automaton()
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            found = spans(text or "", anchors)
            base = [s for s in found if s[0] in BASE]
            rows.append([*(sum(s[0] == k for s in found) for k in KINDS), len(found), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)])
        cols = [*zip(*rows)] or [[]] * 9
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:7]], *[pa.array(c, pa.string()) for c in cols[7:]]], ["doc_id", *[f"n_{k}" for k in KINDS], "n_spans", "base_sha256", "spans"])


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of spans by kind, base_sha256, spans (kind:start:end, comma-joined)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_spans long, base_sha256 string, spans string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
