"""Personal data in texts: patterns propose spans, checksums confirm them, and
words nearby adjust the score.

Offsets are code points, the end is exclusive.  Base kinds (email, ip, card,
phone) are reported whenever their pattern and their check hold.  The further
kinds need a score of :data:`ACCEPT`: an IBAN has it by its checksum, a social
security number only with a telling word within :data:`NEAR` characters.

Nulls count as empty texts and give no spans.  Ids may be null or repeat; every
input row gives one row.  Other columns of the input play no part.  Each pattern
is scanned in time linear in the text, long digit runs included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import per_text, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED
RANK = {kind: i for i, kind in enumerate(KINDS)}
ACCEPT = 0.5
NEAR = 48

#: Score of a confirmed span without any context.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Words near a span that raise its score by :data:`RAISE`.
CONTEXT = {
    "email": "mail e-mail email contact write",
    "ip": "ip host server address login",
    "card": "card visa credit debit payment mastercard amex",
    "phone": "phone call tel mobile fax contact",
    "iban": "iban bank account transfer bic",
    "ssn": "ssn social security taxpayer tax",
}
RAISE = 0.3
#: Words that say the digits are something else; they lower it by :data:`LOWER`.
AGAINST = "version isbn order invoice serial model sku"
LOWER = 0.2

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: What may follow those four characters; it cannot end before a letter or digit.
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){1,30}")
_IBAN_INSIDE = re.compile(r"[A-Za-z0-9]")
LEAST_IBAN = 15
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    country: int(length) for length, countries in (
        line.split(":") for line in (
            "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
            "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
            "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV",
            "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
        )
    ) for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[a-z][a-z-]*")
_WORDS = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
_OTHER = frozenset(AGAINST.split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match starts where its run of local characters does, or where the match
    # before it ended; "@" is no such character, so no run crosses it.
    floor = 0
    for m in _AT.finditer(text):
        at = m.start()
        floor = max(floor, text.rfind("@", floor, at) + 1)
        part = text[floor:at]
        length = len(part) - len(part.rstrip(LOCAL))
        if length:
            yield at - length, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)


def _in_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The country's length decides where an IBAN ends; without one, the first end of a
    run of characters at which the checksum holds."""
    floor = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        if start < floor:
            continue
        rest = _IBAN_REST.match(text, m.end())
        length = IBAN_LENGTH.get(m[0][:2])
        for end in range(m.end() + 1, rest.end() + 1):
            if text[end - 1] == " " or _IBAN_INSIDE.match(text, end):
                continue
            iban = text[start:end].replace(" ", "")
            if (len(iban) >= LEAST_IBAN if length is None else len(iban) == length) and mod97(iban):
                yield start, end
                floor = end
                break


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and check both hold."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if _DIGIT.search(text) is None:
        return
    for m in _IP.finditer(text):
        if all(map(_in_byte, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m.groups()
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", m.start(), m.end()


def score(kind: str, start: int, end: int, text: str) -> float:
    around = f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()
    words = set(_WORD.findall(around))
    value = START[kind] + RAISE * bool(words & _WORDS[kind]) - LOWER * bool(words & _OTHER)
    return min(max(value, 0.0), 1.0)


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """``(start, end, kind, score)`` by start, then by the order of :data:`KINDS`."""
    found = []
    for kind, start, end in proposals(text):
        value = score(kind, start, end, text)
        if kind in BASE or value >= ACCEPT:
            found.append((start, end, kind, value))
    return sorted(found, key=lambda s: (s[0], RANK[s[2]]))


def mask(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, done = [], 0
    for start, end, kind, _ in spans(text):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def _joined(found: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in found)


def _report() -> object:
    def of(text: str) -> tuple:
        found = spans(text)
        kinds = [kind for _, _, kind, _ in found]
        base = _joined([s for s in found if s[2] in BASE])
        return (
            *(kinds.count(k) for k in KINDS),
            hashlib.sha256(base.encode()).hexdigest(),
            _joined(found),
            ",".join(f"{s[3]:.2f}" for s in found),
        )

    return of


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: counts by kind, all spans and their scores, and a digest of the base spans."""
    fields = ", ".join(f"n_{k} long" for k in KINDS)
    return per_text(
        docs, id_column, text_or_empty(text_column),
        f"{fields}, base_sha256 string, spans string, scores string", _report,
    )


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by ``<KIND>``.  All columns
    stay; ``n_chars``, if there, follows the new text.  Null texts stay null."""
    at = docs.columns.index(text_column)
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            masked = [None if t is None else mask(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(masked, pa.string()))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        length = F.length(F.col(text_column)).cast(kind)
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return out
