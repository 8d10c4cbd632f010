"""Personal data in texts by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, scheme marks and
identifier cues. A local parser then expands each anchor to its boundaries and validates it. Parsers
never look further than the run of characters that can belong to the item, so the work is
proportional to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, small_batches, texts

#: Kinds in the order in which spans with equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "account")
BASE = KINDS[:4]
#: Words that announce an identifier.
CUES = ("account", "acct", "iban", "passport", "username", "user id", "member id", "customer id", "ssn", "token", "api key", "api_key", "apikey", "secret", "password")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]++")
AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++(?::[^\s/@]*+)?@[A-Za-z0-9.-]++(?::[0-9]++)?")
AFTER_CUE = re.compile(r"(?:[\x20_](?:no|nr|number|id|key))?\.?[\x20]{0,2}[:=#]?[\x20]{0,2}[\"']?(?P<value>[A-Za-z0-9][A-Za-z0-9_-]*+(?:\x20[A-Z0-9]{2,4}(?![A-Z0-9])){0,8}+)", re.IGNORECASE)


_LOWER = {k: k + 32 for k in range(65, 91)}


def folded(text: str) -> str:
    """A-Z in lower case, every character at its place."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _automaton(cues: tuple[str, ...] = CUES) -> ahocorasick.Automaton:
    """Anchors as they stand in a text whose A-Z are lower-cased."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("://", 3))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    for c in cues:
        a.add_word(folded(c), ("cue", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _iban(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and v.isalnum() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _account(text: str, at: int, size: int) -> tuple[int, int] | None:
    """The identifier behind a cue: 8 or more characters with 4 or more digits, or a valid IBAN."""
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    m = AFTER_CUE.match(text, at + size)
    if not m or m.start("value") == at + size:
        return None
    value, start = m["value"], m.start("value")
    groups = value.split(" ")
    if re.match(r"[A-Za-z]{2}[0-9]{2}", value):
        for k in range(min(len(groups), 9), 0, -1):
            if _iban(whole := " ".join(groups[:k])):
                return start, start + len(whole)
    value = groups[0].rstrip("_-")
    if len(value) >= 8 and sum(c.isdigit() for c in value) >= 4:
        return start, start + len(value)
    return None


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    email_end = dotted_end = grouped_end = scheme_end = 0
    for last, (what, size) in automaton.iter(folded(text)):
        at = last - size + 1
        if what == "0":
            if at >= dotted_end:
                m = DOTTED.match(text, at)
                dotted_end = m.end()
                numbers = m[0].split(".")
                start = at
                for k in range(0, len(numbers) - 3, 4):
                    four = numbers[k : k + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(map(_small, four)):
                        out.append(("ip", start, end))
                    start = end + 1
            if at >= grouped_end:
                m = GROUPED.match(text, at)
                grouped_end = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, m.end()))
        elif what == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                email_end = m.end()
        elif what == "+":
            if m := DIALLED.match(text, at):
                run = m[0].rstrip(" ().-")
                if len(run) >= 4 and 9 <= sum(c.isdigit() for c in run) <= 15:
                    out.append(("phone", at, at + len(run)))
        elif what == "://":
            start = at
            while start > scheme_end and text[start - 1] in SCHEME:
                start -= 1
            scheme_end = last + 1
            while start < at and not text[start].isalpha():  # a scheme starts with a letter
                start += 1
            if start < at and (m := AUTHORITY.match(text, last + 1)):
                out.append(("login", start, m.end()))
        elif found := _account(text, at, size):
            out.append(("account", *found))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cues: tuple[str, ...] = CUES) -> DataFrame:
    """(doc_id, spans): array of (kind, start, end) for every row, empty where nothing is found.

    email, ip, card and phone are leftmost matches, not overlapping within a kind; login is a URL
    with user information, account an identifier behind one of the cues in any case, and these two may overlap others.
    A null text counts as empty; repeated rows and ids stay; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(cues)
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, automaton)] for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
