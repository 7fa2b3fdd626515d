"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs,
plus signs, digits, ``://`` and cues of identifiers. At each anchor a
deterministic local parser expands to the left or right and validates what it
found; no pattern is searched for over the whole text.

Base kinds, leftmost and non-overlapping per kind: email, ip (parts at most
255), card (16 to 19 digits, Luhn) and phone (8 to 15 digits). Added kinds: url
(an address whose authority carries a user and a password, with its whole scheme)
and account (a value after a cue such as ``token =`` or ``iban:``, in whatever
case of A-Z; one that is already within a base span is not repeated). What a value
must look like depends on its cue: an IBAN has a country, check digits and the
right remainder by 97; a social security number has an area, a group and a serial
that are given out; a tax id is nine digits or a country and eight to twelve; a
passport or bank account number has six characters or more and five digits; a
secret has six characters or more and a digit.

Null and empty texts have no spans; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")

# Cues of identifiers, in lower case, by the check that their values must pass.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api key", "api-key", "access key", "access_key", "access-key", "private key", "private_key"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security", "social security number"),
    "tax": ("tax id", "tax_id", "taxid", "tax number", "vat number", "vat id", "ein", "tin"),
    "number": ("passport", "account", "acct"),
}

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "ad": 24, "ae": 23, "al": 28, "at": 20, "az": 28, "ba": 20, "be": 16, "bg": 22, "bh": 22, "bi": 27, "br": 29, "by": 28, "ch": 21, "cr": 22, "cy": 28, "cz": 24, "de": 22, "dj": 27, "dk": 18, "do": 28,
    "ee": 20, "eg": 29, "es": 24, "fi": 18, "fk": 18, "fo": 18, "fr": 27, "gb": 22, "ge": 22, "gi": 23, "gl": 18, "gr": 27, "gt": 28, "hr": 21, "hu": 28, "ie": 22, "il": 23, "iq": 23, "is": 26, "it": 27,
    "jo": 30, "kw": 30, "kz": 20, "lb": 28, "lc": 32, "li": 21, "lt": 20, "lu": 20, "lv": 21, "ly": 25, "mc": 27, "md": 24, "me": 22, "mk": 19, "mn": 20, "mr": 27, "mt": 31, "mu": 30, "ni": 28, "nl": 18,
    "no": 15, "om": 23, "pk": 24, "pl": 28, "ps": 29, "pt": 25, "qa": 29, "ro": 24, "rs": 22, "ru": 33, "sa": 24, "sc": 31, "sd": 18, "se": 24, "si": 19, "sk": 24, "sm": 27, "so": 23, "st": 25, "sv": 28,
    "tl": 23, "tn": 24, "tr": 26, "ua": 29, "va": 22, "vg": 24, "xk": 20, "ye": 30,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]++")
URL = re.compile(r"//[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCHEME = LETTERS | frozenset("0123456789+.-")
LEAD = re.compile(r"[ \t]*(?:(?:no|nr|number|id)\.?[ \t]*)?[\"']?[ \t]*[:=#][ \t]*[\"']?")
# What a value may consist of, read from lower-case text; then its check.
SECRET = re.compile(r"[a-z0-9][a-z0-9._/+-]{5,}")
IBAN = re.compile(r"[a-z]{2}[0-9]{2}(?:[ -]?[a-z0-9]){11,30}")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![a-z0-9])")
TAX = re.compile(r"(?:[0-9]{2}-?[0-9]{7}|(?!000|666)[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4}|[a-z]{2} ?[a-z0-9]?[0-9]{7,11}[a-z0-9]?)(?![a-z0-9])")
NUMBER = re.compile(r"[a-z0-9](?:[ -]?[a-z0-9]){5,}")
DIGITS = "0123456789"


def iban_end(value: str) -> int:
    """How much of the value is an IBAN: as many characters as its country's have, no word cut, and 1 when divided by 97; 0 if it is none."""
    compact = [(k, c) for k, c in enumerate(value) if c not in " -"]
    n = IBAN_LENGTHS.get(value[:2], 0)
    if not n or len(compact) < n or (end := compact[n - 1][0] + 1) < len(value) and value[end] not in " -":
        return 0
    code = "".join(str(int(c, 36)) for _, c in compact[4:n] + compact[:4])
    return end if int(code) % 97 == 1 else 0


def number_end(value: str) -> int:
    """The groups of a number go on as long as each has a digit; it needs six characters and five digits."""
    end = 0
    for m in re.finditer(r"[a-z0-9]+", value):
        if end and not any(c in DIGITS for c in m[0]):
            break
        end = m.end()
    found = value[:end]
    return end if sum(c in DIGITS for c in found) >= 5 and sum(c not in " -" for c in found) >= 6 else 0


def account(kind: str, lower: str, at: int) -> tuple[int, int] | None:
    """The span of the value after a cue that ends at ``at``, if it is one of that kind."""
    lead = LEAD.match(lower, at)
    if lead is None:
        return None
    start = lead.end()
    if kind == "iban":
        m = IBAN.match(lower, start)
        size = iban_end(m[0]) if m else 0
    elif kind == "number":
        m = IBAN.match(lower, start)
        size = iban_end(m[0]) if m else 0
        if not size and (m := NUMBER.match(lower, start)):
            size = number_end(m[0])
    else:
        m = {"ssn": SSN, "tax": TAX, "secret": SECRET}[kind].match(lower, start)
        size = len(m[0]) if m and any(c in DIGITS for c in m[0]) else 0
    return (start, start + size) if size else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("d", 1))
    for anchor in ("@", "+", "://"):
        found.add_word(anchor, (anchor[0], len(anchor)))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _local_start(text: str, at: int, floor: int) -> int:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    return start


def _scheme_start(text: str, at: int, floor: int) -> int:
    """Where the scheme that ends at ``at`` begins, a letter; ``at`` if there is none."""
    start = at
    while start > floor and text[start - 1] in SCHEME:
        start -= 1
    while start < at and text[start] not in LETTERS:
        start += 1
    return start


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, as code points with an exclusive end, in order of start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    if not text:
        return out
    after = dict.fromkeys(out, 0)  # where the search for the next match of a kind goes on
    accounts = []
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only, so places hold
    for last, (kind, size) in automaton().iter(lower):
        at = last - size + 1
        if kind == "d":
            if at >= after["card"] and (m := CARD.match(text, at)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= after["ip"] and not (at and text[at - 1] in DIGITS) and (m := IP.match(text, at)):
                after["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
                    out["ip"].append(m.span())
        elif kind == "@":
            start = _local_start(text, at, after["email"])
            if start < at and (m := DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                out["email"].append((start, m.end()))
            else:
                after["email"] = max(after["email"], at + 1)
        elif kind == "+":
            if m := PHONE_RUN.match(text, at):
                end = m.end()
                while end > at + 3 and text[end - 1] not in DIGITS:
                    end -= 1
                if end > at + 3 and 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    out["phone"].append((at, end))
        elif kind == ":":
            if at >= after["url"] and (m := URL.match(text, at + 1)) and (start := _scheme_start(text, at, after["url"])) < at:
                after["url"] = m.end()
                out["url"].append((start, m.end()))
        elif at >= after["account"] and (kind == "secret" or at == 0 or lower[at - 1] not in LETTERS) and (found := account(kind, lower, last + 1)):
            after["account"] = found[1]
            accounts.append(found)
    out["account"] = not_within(accounts, [out[k] for k in BASE]) if accounts else []
    return out


def not_within(accounts: list, kinds: list[list]) -> list:
    """The spans that lie in no span of the lists; all are in order, and none of a list overlap."""
    out = []
    for a, b in accounts:
        near = (spans_[k - 1] for spans_ in kinds if (k := bisect_right(spans_, (a, 1 << 62))))
        if not any(s <= a and b <= e for s, e in near):
            out.append((a, b))
    return out


def listed(found: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str | None, found: dict | None = None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the
    union is replaced, under the kind of the first."""
    if not text:
        return text
    found = spans(text) if found is None else found
    every = sorted((a, b, k) for k, list_ in found.items() for a, b in list_)
    if not every:
        return text
    merged: list[list] = []
    for a, b, k in every:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    parts, at = [], 0
    for a, b, k in merged:
        parts += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*parts, text[at:]])


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, the number of spans of each base kind, the digest of the base spans and
    all spans as ``kind:start:end`` by kind, then start."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [spans(t.as_py()) for t in batch.column(text)]
            columns = {key: batch.column(key)}
            columns |= {f"n_{k}": pa.array([len(r[k]) for r in rows], pa.int64()) for k in BASE}
            columns["base_sha256"] = pa.array([hashlib.sha256(listed(r, BASE).encode()).hexdigest() for r in rows], pa.string())
            columns["spans"] = pa.array([listed(r, (*BASE, *ADDED)) for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType().add(key, df.schema[key].dataType)
    for k in BASE:
        schema = schema.add(f"n_{k}", "long")
    return df.select(key, text).mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with all spans of the text replaced."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            clean = pa.array([redact(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), clean)

    return df.mapInArrow(run, df.schema)
