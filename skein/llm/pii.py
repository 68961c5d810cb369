"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, address schemes and identifier cues.
From each anchor a local parser expands to the borders of an email, an IPv4 address, a card number, a telephone number, a
web address, or an account or identity number behind a cue, and checks it (labels, ranges, digit counts, check digits).
Nothing but the neighbourhood of anchors is looked at. For the first four kinds the spans are exactly the leftmost
matches of the base patterns, one after another; a match that fails its check is dropped and not tried again shorter.

Spans are in code points, end exclusive. Null text counts as empty and has none. Whole texts are searched. Repeated rows
give repeated results; other columns pass by.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_column, map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
ASCII = re.ASCII
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"://[^\s\"'<>\\^`{|}]+")
VALUE = re.compile(r"[\x20:#=.]{1,4}((?:[A-Za-z]{1,4}[\x20-]?)?[0-9][0-9A-Za-z]*(?:[\x20-][0-9A-Za-z]*[0-9][0-9A-Za-z]*)*)")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Identifier cues (lower case); a number must follow.
CUES = ("account", "acct", "passport", "ssn", "social security", "tax id", "vat id", "customer id", "iban", "konto", "kontonummer", "compte", "cuenta")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


@functools.cache
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, "d")
    a.add_word("@", "@")
    a.add_word("+", "+")
    for s in ("http://", "https://", "ftp://"):
        a.add_word(s, "u")
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(form, "c")
    a.make_automaton()
    return a


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    email_end = ip_end = run_end = plus_end = url_end = cue_end = 0
    size = len(text)
    for at, kind in anchors().iter(text):
        if kind == "d":
            if at >= run_end:  # a number with single spaces or hyphens inside: possibly a card
                m = RUN.match(text, at)
                run_end = m.end()
                digits = re.sub(r"[\x20-]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= ip_end:  # the first digit of a group that no address before has taken
                m = QUAD.match(text, at)
                if m:
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                        out["ip"].append(m.span())
                else:  # no later start in this group of digits can match either
                    ip_end = at + 1
                    while ip_end < size and text[ip_end] in DIGITS:
                        ip_end += 1
        elif kind == "@":
            begin = at
            while begin > email_end and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out["email"].append((begin, email_end))
        elif kind == "+":
            if at >= plus_end and (m := PHONE.match(text, at)):
                plus_end = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "u":
            begin = text.rfind(":", 0, at + 1)
            while begin > url_end and text[begin - 1].isascii() and text[begin - 1].isalpha():
                begin -= 1
            if at >= url_end and (m := URL.match(text, text.index("://", begin))):
                end = m.end()
                while text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end > at + 1:
                    url_end = end
                    out["url"].append((begin, end))
        else:
            if at + 1 >= cue_end:
                gap = at + 1
                while gap < size and text[gap] in " :#=.":
                    gap += 1
                if (m := IBAN.match(text, gap)) and iban(m[0]):
                    span = m.span()
                elif (m := VALUE.match(text, at + 1)) and sum(c in DIGITS for c in m[1]) >= 6:
                    span = m.span(1)
                else:
                    continue
                cue_end = span[1]
                out["account"].append(span)
    return out


def iban(value: str) -> bool:
    """The mod-97 check of international account numbers."""
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def masked(text: str | None, found: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earliest, longest one."""
    spans = sorted(((a, b, k) for k, v in found.items() for a, b in v), key=lambda s: (s[0], -s[1]))
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        elif b > at:
            pass  # its head is gone; its tail goes too
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, for every row."""

    def start():
        def each(doc_id, text):
            found = find(text)
            yield doc_id, *(len(found[k]) for k in BASE), hashlib.sha256(joined(found, BASE).encode()).hexdigest(), joined(found, KINDS)

        return each

    return map_rows(id_text(df, id_col, text_col), start, SCHEMA, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in the text column; nulls stay null."""

    return map_column(df, text_col, lambda: lambda text: masked(text, find(text)) if text is not None else None)
