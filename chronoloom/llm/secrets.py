"""Secrets: base rules, and zstandard novelty for what no rule names.

Novelty: a candidate (a long run of key characters in a sensitive context) is compressed after its surroundings,
with an identifier dictionary as the compressor's history. What it adds to the compressed size tells whether the
history explains it: prose, identifiers and repeated material add little, random key material about its entropy.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import pairwise

import ahocorasick
import zstandard
from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm._common import table
from chronoloom.llm.spans import Span, by_start, digest, find_spans

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make a context sensitive, and how many code points before a candidate they may stand.
CONTEXT_WORDS = (*ASSIGN_WORDS, "auth", "bearer", "credential", "private", "signature", "pwd", "access", "session", "cookie")
CONTEXT_REACH = 40
#: Identifiers and words that code and configuration are made of, given to the compressor as its history.
DICTIONARY = " ".join(
    "password passwd secret token api_key apikey access_key auth bearer credential private_key signature session cookie "
    "client_id client_secret username user host port localhost database config settings environment variable default "
    "true false null none string integer boolean return function class import export public static void const value "
    "begin end certificate key value http https www com org net example json yaml xml header content type length "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ".split()
).encode()
#: A candidate is novel if it adds at least this many compressed bits for each of its characters.
NOVEL_BITS = 3.2
#: And this many if it has no digit: words that the history doesn't hold add about 5.5, random letters of both cases 9.5.
LETTER_BITS = 6.5
WINDOW = 160
#: Longer candidates are measured in pieces of so many characters.
PIECE = 4096

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_DIGIT = re.compile("[0-9]")
_EQUALS = re.compile("=+")


def make_finder() -> Callable[[str], list[Span]]:
    words = ahocorasick.Automaton()
    for w in dict.fromkeys(CONTEXT_WORDS):
        words.add_word(w, (len(w), w in ASSIGN_WORDS))
    words.make_automaton()
    history = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=history, write_content_size=False, write_dict_id=False)
    packed = lambda s: len(packer.compress(s.encode("utf-8", "surrogatepass")))

    def novel_piece(text: str, start: int, end: int) -> bool:
        around = text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]
        least = NOVEL_BITS if _DIGIT.search(text, start, end) else LETTER_BITS
        return 8 * (packed(around + text[start:end]) - packed(around)) >= least * (end - start)

    def novel(text: str, start: int, end: int) -> bool:
        """Whether any piece is; the last one is flush with the end."""
        return any(novel_piece(text, max(start, min(at, end - PIECE)), min(end, at + PIECE)) for at in range(start, end, PIECE))

    def novel_parts(text: str, start: int, end: int, sensitive: list[int]) -> list[tuple[int, int]]:
        """The run of key characters if it is novel, else its novel parts: names and values of one run are told apart
        behind context words and behind equals signs in reach of one."""

        def value(a: int, b: int) -> list[tuple[int, int]]:
            while a < b and text[a] in "=._-+/":  # an equals sign before a value isn't part of it
                a += 1
            return [(a, b)] if b - a >= 16 and novel(text, a, b) else []

        if whole := value(start, end):
            return whole
        near = sensitive[bisect_right(sensitive, start) : bisect_left(sensitive, end)]
        equals = (m.end() for m in _EQUALS.finditer(text, start, end))
        cuts = {*near, *(e for e in equals if e - sensitive[bisect_right(sensitive, e) - 1] <= CONTEXT_REACH)}
        edges = [start, *sorted(cuts), end]
        return [s for a, b in pairwise(edges) for s in value(a, b)] if cuts else []

    def find(text: str) -> list[Span]:
        spans: list[Span] = []
        low = text.lower()
        if len(low) != len(text):  # a letter that grows when lower-cased would shift what follows
            low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        assign_end, sensitive = 0, []
        for at, (length, assigns) in words.iter(low):
            start = at + 1 - length
            sensitive.append(at + 1)
            if assigns and start >= assign_end and (m := _ASSIGN.match(text, start)):
                assign_end = m.end()
                if m.end(2) - m.start(2) >= 12:
                    spans.append(("assign", *m.span(), True))
        if "AKIA" in text:
            spans += [("access", *m.span(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        spans += [("hex", *m.span(), True) for m in _HEX.finditer(text)]
        done = 0
        for near in sensitive:
            at = max(near, done)
            while at <= near + CONTEXT_REACH and (m := _CANDIDATE.search(text, at, near + CONTEXT_REACH + 16)):
                start, end = m.start(), _CANDIDATE.match(text, m.start()).end()
                at = done = end
                spans += [("novel", *part, False) for part in novel_parts(text, start, end, sensitive)]
        return by_start(spans, KINDS)

    return find


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and `spans` (kind, start, end, base) of every row's whole text, by start, then kind.

    Edge cases: a null or empty text has no spans; a null key passes through; repeated rows each get their own;
    extra columns are ignored; an empty table gives an empty result.
    """
    return find_spans(docs, key, text, make_finder)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")), "doc_id", list(BASE))
