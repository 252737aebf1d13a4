"""Secrets in texts: keyword automaton first, anchored patterns at its hits, checksums last."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from .shared import map_slices

# The three base kinds.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Token formats whose last six characters are the CRC-32 of the
#: thirty before them, written in base 62.
CHECKED = re.compile(r"(ghp|gho|ghu|ghs|ghr|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked")


def base62_crc32(payload: str) -> str:
    rest, digits = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits


@cache
def _automaton() -> ahocorasick.Automaton:
    """Keywords in lower case with (pattern, length)."""
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in CHECKED_PREFIXES:
        found.add_word(word, ("checked", len(word)))
    found.make_automaton()
    return found


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret, in code points, in order.

    The automaton reports keywords by their ends, so starts of one kind are
    sorted before the patterns are tried there. As a scan from the left would,
    a match uses up its text even if it is then dropped for its length.
    """
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {"assign": [], "access": [], "checked": []}
    for last, (kind, length) in _automaton().iter(lowered):
        hits[kind].append(last + 1 - length)
    found = []
    for kind, pattern, keep in (
        ("assign", ASSIGN, lambda m: len(m[2]) >= ASSIGN_CHARS),
        ("access", ACCESS, lambda m: len(m[0]) >= ACCESS_CHARS),
        ("checked", CHECKED, lambda m: base62_crc32(m[2]) == m[3]),
    ):
        end = 0
        for start in sorted(set(hits[kind])):
            if start >= end and (match := pattern.match(text, start)):
                end = match.end()
                if keep(match):
                    found.append((start, KINDS.index(kind), end))
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(documents: DataFrame) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base kinds are assignments to a password-like name, access keys and long
    runs of hex digits; a further kind, `checked`, are tokens whose embedded
    checksum is right. Spans are kind:start:end in code points with the end
    exclusive, ordered by start and then kind, joined by commas; base_sha256 is
    the SHA-256 of the base ones so written. Null texts count as empty and give
    zeros, an empty list and the hash of nothing. One result row per input row,
    repeated rows and null ids included; other columns are not read.
    """

    def work(columns: dict[str, list]) -> dict[str, list]:
        every = [spans_of(text) if text else [] for text in columns["text"]]
        base = [[span for span in spans if span[1] < 3] for spans in every]
        return {
            "doc_id": columns["doc_id"],
            **{
                f"n_{kind}": [sum(span[1] == number for span in spans) for spans in base]
                for number, kind in enumerate(KINDS[:3])
            },
            "base_sha256": [
                hashlib.sha256(_written(spans).encode()).hexdigest() for spans in base
            ],
            "spans": [_written(spans) for spans in every],
        }

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
    return map_slices(documents.select("doc_id", "text"), work, schema)
