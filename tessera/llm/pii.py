"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs, schemes and the cues of identifiers.
From each anchor a deterministic parser expands to the boundaries and validates what it finds. A parser reads the
text around its anchor only, and each kind keeps the end of its last match, so that matches of a kind don't overlap.

Base kinds: email, ip, card, phone. Added kinds: iban (ISO 13616 check digits), account (a cue such as "account no."
and 6 to 20 digits), login (user and password in a URL), key (cloud access keys) and secret (password or token
assignments). Spans are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "login", "key", "secret")
KINDS = BASE + ADDED

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?|#|id))?[ ]?[:#=]?[ ]?([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.IGNORECASE)
LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")
KEY = re.compile(r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"""["']?\s?[:=]\s?["']?""")
SECRET = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

#: The cues of identifiers, as they are spelled.
CUES = {
    "account": ("account", "Account", "ACCOUNT", "konto", "Konto", "cuenta", "Cuenta", "compte", "Compte"),
    "iban": ("IBAN", "iban", "Iban"),
    "key": ("AKIA", "ASIA"),
    "login": ("://",),
    "secret": ("password", "Password", "PASSWORD", "passwd", "token", "Token", "TOKEN", "secret", "Secret", "SECRET", "api_key", "apikey", "API_KEY"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d *= 2
            d -= 9 * (d > 9)
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Scanner:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for c in "0123456789":
            self.anchors.add_word(c, ("digit", 1))
        self.anchors.add_word("@", ("email", 1))
        self.anchors.add_word("+", ("phone", 1))
        for kind, cues in CUES.items():
            for cue in cues:
                self.anchors.add_word(cue, (kind, len(cue)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        end = dict.fromkeys(KINDS, 0)
        run = 0  # end of the digit run in which an address was already tried
        plain = 0  # end of a value without digits: what starts inside it has none either
        for last, (kind, width) in self.anchors.iter(text):
            at = last + 1 - width
            if kind == "digit":
                if at >= end["ip"] and at >= run:
                    if m := IP.match(text, at):
                        end["ip"] = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                            found["ip"].append(m.span())
                    else:
                        run = DIGITS.match(text, at).end()
                if at >= end["card"] and (m := CARD.match(text, at)):
                    end["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
            elif kind == "email":
                start = at
                while start > end["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    end["email"] = m.end()
                    found["email"].append((start, m.end()))
            elif kind == "phone":
                if at >= end["phone"] and (m := PHONE.match(text, at)):
                    end["phone"] = m.end()
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif kind == "secret":
                if at >= end["secret"] and (m := ASSIGNED.match(text, at + width)) and m.end() >= plain and (m := SECRET.match(text, m.end())):
                    if any(c.isdigit() for c in m[0]):
                        end["secret"] = m.end()
                        found["secret"].append(m.span())
                    else:
                        plain = m.end()
            elif at >= end[kind] and (span := self.cue(kind, text, at, at + width)):
                end[kind] = span[1]
                found[kind].append(span)
        return found

    @staticmethod
    def cue(kind: str, text: str, at: int, after: int) -> tuple[int, int] | None:
        """The span that a cue at text[at:after] leads to, if it is valid."""
        if kind == "key":
            m = KEY.match(text, at)
            return m.span() if m and not (at and text[at - 1].isalnum()) else None
        if kind == "login":
            m = LOGIN.match(text, at)
            return m.span(1) if m else None
        if kind == "account":
            m = ACCOUNT.match(text, after)
            return m.span(1) if m and not (at and text[at - 1].isalnum()) else None
        while after < len(text) and text[after] in " :":
            after += 1
        m = IBAN.match(text, after)
        return m.span() if m and iban_valid(m[0]) else None


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner, names = Scanner(), [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        found = [scanner.spans(t) for t in texts(batch.column(1))]
        counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
        digests = [hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found]
        yield pa.record_batch([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([listed(f, KINDS) for f in found], pa.string())], names=names)


def find_private(docs: DataFrame) -> DataFrame:
    """A row for each row of docs; see COLUMNS and the head of this module.

    A null text is empty and has no spans. Null and repeated doc_ids are rows like others; other columns play no
    part. An empty table gives an empty result. No shuffle; each anchor costs what its parser reads, and no parser reads
    again what another anchor of its kind has read without a match, so the cost follows the length of a text.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, COLUMNS)


def mask(text: str, scanner: Scanner | None = None) -> str:
    """text with each span replaced by <KIND>; overlapping spans become one, named after the first."""
    spans = sorted((a, -b, k) for k, own in (scanner or Scanner()).spans(text).items() for a, b in own)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def op5_private(spark, sf_dir: str) -> DataFrame:
    return find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
