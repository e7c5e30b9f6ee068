"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs before digits, scheme marks
and identifier cues. A deterministic parser for each kind grows the span around its anchor and validates it.
Anchors come in order and a kind never looks before the end of its last match, so its spans are leftmost
and do not overlap; a match that fails its validation is dropped and not tried again.

The kinds email, ip, card and phone are the base. The method adds `address` (a scheme's address that names
a user or carries an identifying parameter) and `account` (an IBAN, SSN or account number after a cue).
Offsets are code points, ends exclusive. A null text is empty and has no spans; null ids and repeated rows
are kept; texts of any length are scanned whole, in time proportional to their length; an empty table gives an
empty result. Spans that start together come in the order of the kinds, ties in the table are rows each. Other
columns are ignored by find; clean returns all of them, in their order and under their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
CUES = ("iban", "ssn", "account", "acct", "passport", "konto", "compte", "cuenta")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}\Z")
ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]+")
NAMES = re.compile(r"[/?&;](?:user|uid|email|phone|token|account|ssn)=[^&#]+", re.I)
ACCOUNT = re.compile(r"(?:[\s:#=.-]{0,3}(?:number|no|nr|id|num))?[\s:#=.-]{1,4}([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z0-9]{2,5}){0,8})", re.I)
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, "digit")
        found.add_word(f"+{d}", "plus")
    found.add_word("@", "at")
    found.add_word("://", "scheme")
    for cue in CUES:
        for form in (cue, cue.title(), cue.upper()):
            found.add_word(form, "cue")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def account(text: str, at: int) -> tuple[int, int] | None:
    m = ACCOUNT.match(text, at)
    if not m:
        return None
    if s := SSN.match(text, m.start(1)):
        return s.span()
    ends = [m.end(1), *(i for i in range(m.end(1) - 1, m.start(1), -1) if text[i] in " -")]
    for end in ends:  # the longest part that is valid
        code = re.sub("[ -]", "", text[m.start(1) : end]).upper()
        if IBAN.fullmatch(code) and mod97(code):
            return m.start(1), end
    plain = re.compile(r"[A-Za-z]{0,4}[0-9]{6,20}(?![A-Za-z0-9])").match(text, m.start(1))
    return plain.span() if plain else None


class Finder:
    def __init__(self):
        self.anchors = automaton()

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then by kind as listed."""
        spans, upto = [], dict.fromkeys(KINDS, 0)

        def keep(kind: str, start: int, end: int, valid: bool) -> None:
            upto[kind] = end
            if valid:
                spans.append((start, KINDS.index(kind), end))

        tried = -2
        for last, kind in self.anchors.iter(text):
            if kind == "digit":
                if last >= upto["card"] and (m := CARD.match(text, last)):
                    digits = only_digits(m[0])
                    keep("card", *m.span(), 12 <= len(digits) <= 19 and luhn(digits))
                # Later digits of a run that failed from its first one fail too.
                if last >= upto["ip"]:
                    if tried != last - 1:
                        if m := IP.match(text, last):
                            keep("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
                            continue
                    tried = last
            elif kind == "plus":
                if last - 1 >= upto["phone"] and (m := PHONE.match(text, last - 1)):
                    keep("phone", *m.span(), 9 <= len(only_digits(m[0])) <= 15)
            elif kind == "at":
                start = last
                while start > upto["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < last and (m := DOMAIN.match(text, last + 1)):
                    keep("email", start, m.end(), True)
            elif kind == "scheme":
                m = SCHEME.search(text[max(0, last - 18) : last - 2])
                start = last - 2 - len(m[0]) if m else -1
                # What an earlier address covers is not matched again: a run of characters is read once.
                if start >= upto["address"] and (rest := ADDRESS.match(text, last + 1)):
                    found = rest[0].rstrip(".,;:!?)]")
                    host, slash, path = found.partition("/")
                    keep("address", start, last + 1 + len(found), "@" in host or bool(NAMES.search(slash + path)))
            elif last + 1 >= upto["account"] and not text[last + 1 : last + 2].isalpha() and (found := account(text, last + 1)):
                keep("account", *found, True)
        return [(s, e, KINDS[k]) for s, k, e in sorted(spans)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Every span becomes its kind in brackets; overlapping spans become one."""
    out, upto = [], 0
    for s, e, kind in spans:
        if s >= upto:
            out += [text[upto:s], f"[{kind.upper()}]"]
        upto = max(upto, e)
    return "".join(out) + text[upto:]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def start():
        finder = Finder()

        def work(doc_ids: list, texts: list) -> list:
            found = [finder(t) if t else [] for t in texts]
            base = [[x for x in spans if x[2] in BASE] for spans in found]
            counts = [[sum(x[2] == k for x in spans) for spans in base] for k in BASE]
            return [doc_ids, *counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(s) for s in found]]

        return work

    return common.map_columns(docs.select(F.col("doc_id").cast("long"), "text"), schema, start)


def clean(docs: DataFrame) -> DataFrame:
    """docs with every span redacted and n_chars, if there, brought up to date; other columns stay."""
    counted = "n_chars" in docs.columns

    def start():
        finder = Finder()

        def work(texts: list, *_: list) -> list:
            texts = [redact(t, s) if t and (s := finder(t)) else t for t in texts]
            return [texts, [None if t is None else len(t) for t in texts]][: 1 + counted]

        return work

    return common.replace_columns(docs, ["text", "n_chars"][: 1 + counted], start)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
