"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and cues
such as "iban" or "token". From each anchor a small deterministic parser looks left and right for the
boundaries of an item and validates it. Kinds in their order of listing: email, ip, card, phone (the
base kinds), then url and account.

A base kind's items are leftmost and do not overlap; what fails its test is consumed and dropped. Spans
count code points, the end is exclusive. A missing or empty text has no spans. Rows are independent:
repeated rows give repeated results, an empty table an empty one; columns other than the id and the
text are not read (``find``) or passed on unchanged (``redact``).
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import over_batches, strings

# fixed values: the kinds in the order of listing, and the words that announce an account or a secret
KINDS = ("email", "ip", "card", "phone", "url", "account")
CUES = (
    "iban", "account", "acct", "customer id", "passport", "ssn", "tax id", "token", "api_key", "apikey", "api key", "secret", "password", "passwd", "access key",
)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
GAP = re.compile(r"(?:[ \t]*(?:no|nr|number)\b\.?)?[ \t]*[:=#]?[ \t]*[\"']?", re.IGNORECASE)
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+-]*[A-Za-z0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign in "@+" else "0", 1))
    found.add_word("://", ("/", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("c", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """A number of at most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def url_at(text: str, sign: int, after: int) -> tuple[int, int] | None:
    """The address around "://": a scheme to its left, a host with a dot or a port to its right."""
    start = sign
    while start > after and text[start - 1] in SCHEME:
        start -= 1
    while start < sign and not text[start].isalpha():
        start += 1
    rest = URL_REST.match(text, sign + 3)
    if start == sign or not rest:
        return None
    end = rest.end()
    while end > sign + 3 and text[end - 1] in ".,;:!?)*":
        end -= 1
    host = re.split(r"[/?#]", text[sign + 3 : end], maxsplit=1)[0].rpartition("@")[2]
    return (start, end) if re.fullmatch(r"[A-Za-z0-9-]+(?:(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?|:[0-9]+)", host) else None


def account_at(text: str, end: int, cue: str) -> tuple[int, int] | None:
    """The identifier that follows a cue: an IBAN that passes its check, else six characters with a digit."""
    at = GAP.match(text, end).end()
    if at == end:
        return None
    if cue.lower() == "iban":
        found = IBAN.match(text, at)
        while found and not valid_iban(found[0]):
            found = IBAN.match(text, at, found.end() - 1)
        return found and found.span()
    found = IDENTIFIER.match(text, at)
    return found.span() if found and len(found[0]) >= 6 and re.search("[0-9]", found[0]) else None


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(place of the kind, start, end) of every item, sorted."""
    found: list[tuple[int, int, int]] = []
    email = quad = card = phone = url = account = 0  # how far each kind has got
    for last, (anchor, length) in anchors().iter(text):
        at = last - length + 1
        if anchor == "0":
            if at >= card:
                m = CARD.match(text, at)
                card = m.end() if m else at + 1
                if m and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                    found.append((2, at, card))
            if at >= quad:
                m = QUAD.match(text, at)
                quad = (m or DIGITS.match(text, at)).end()
                if m and all(map(small, m.groups())):
                    found.append((1, at, quad))
        elif anchor == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                found.append((0, start, email))
        elif anchor == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((3, at, phone))
        elif anchor == "/":
            if at >= url and (span := url_at(text, at, url)):
                url = span[1]
                found.append((4, *span))
        elif at >= account and (span := account_at(text, last + 1, text[at : last + 1])):
            account = span[1]
            found.append((5, *span))
    found.sort()
    return found


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, sorted by kind and start."""

    def make():
        def one(batch):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans_of(x)] for x in strings(batch)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

        return one

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return over_batches(chosen, make, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str | None) -> str | None:
    """The text with each item, or run of overlapping items, replaced by the first one's kind in angle brackets."""
    if not text:
        return text
    parts, done, kind = [], 0, ""
    for a, b, k in sorted((a, b, k) for k, a, b in spans_of(text)):
        if a < done and kind:
            done = max(done, b)
            continue
        parts += [text[done:a], kind := f"<{KINDS[k].upper()}>"]
        done = b
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same table with personal data replaced; ``length_col``, if there, is counted anew where the text is known."""
    at = docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))

    def make():
        def one(batch):
            columns = list(batch.columns)
            columns[at] = pa.array([redacted(x) for x in columns[at].to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays(columns, names)

        return one

    out = over_batches(docs.toDF(*names), make, fields).toDF(*docs.columns)
    if length_col in docs.columns:
        known = F.length(F.col(text_col)).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.coalesce(known, F.col(length_col)))
    return out
