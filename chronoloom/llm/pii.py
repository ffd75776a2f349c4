"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes and identifier cues, and
local parsers grow and validate the span around each anchor.

The base rules (email, ip, card, phone) are leftmost and non-overlapping for each kind. Every rule is anchored on a
run that cannot be entered in its middle, so a text is read once for each kind whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm._common import table
from chronoloom.llm.spans import Span, by_start, digest, find_spans

BASE = ("email", "ip", "card", "phone")
#: Added by the anchors: e-mail addresses and hosts inside links with a user part, and account numbers after a cue.
KINDS = (*BASE, "link", "iban", "account")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LINK = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+[A-Za-z0-9]")
_AFTER_CUE = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|#))?[\x20:=#]{1,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}|[0-9](?:[\x20-]?[0-9]){7,16})(?![A-Za-z0-9])")
_DIGITS = str.maketrans("", "", "\x20-().+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += _DOUBLED[int(c)] if i % 2 else int(c)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def make_finder() -> Callable[[str], list[Span]]:
    anchors = ahocorasick.Automaton()
    for word, kind in (("@", "at"), ("+", "plus"), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)):
        anchors.add_word(word, (kind, len(word)))
    anchors.make_automaton()

    def find(text: str) -> list[Span]:
        spans: list[Span] = []
        email_end = phone_end = 0
        low = text.lower()
        if len(low) != len(text):  # a letter that grows when lower-cased would shift what follows
            low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        for at, (kind, length) in anchors.iter(low):
            if kind == "at":
                start = at
                while start > email_end and _LOCAL.match(text[start - 1]):
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    spans.append(("email", start, m.end(), True))
                    email_end = m.end()
            elif kind == "plus":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 10 <= len(m[0].translate(_DIGITS)) <= 15:
                        spans.append(("phone", at, m.end(), True))
            elif kind == "scheme":
                if m := _LINK.match(text, at + 1):
                    spans.append(("link", at + 1 - length, m.end(), False))
            elif (m := _AFTER_CUE.match(text, at + 1)) and not text[max(0, at - length) : at + 1 - length].isalnum():
                number = m[1].replace(" ", "").replace("-", "")
                if number.isdigit():
                    spans.append(("account", *m.span(1), False))
                else:  # words in capitals may follow the number
                    start, ends = m.start(1), [m.end(1), *(m.end(1) - k for k, c in enumerate(reversed(m[1]), 1) if c == " ")]
                    if end := next((e for e in ends if e > start and mod97(text[start:e].replace(" ", ""))), 0):
                        spans.append(("iban", start, end, False))
        for m in _IP.finditer(text):
            if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span(), True))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(digits := m[0].translate(_DIGITS)) <= 19 and luhn(digits):
                spans.append(("card", *m.span(), True))
        return by_start(spans, KINDS)

    return find


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and `spans` (kind, start, end, base) of every row's whole text, by start, then kind.

    Edge cases: a null or empty text has no spans; a null key passes through; repeated rows each get their own;
    extra columns are ignored; an empty table gives an empty result.
    """
    return find_spans(docs, key, text, make_finder)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")), "doc_id", list(BASE))
