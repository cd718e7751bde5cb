"""Personal data: patterns propose spans, checksums confirm them, and words near by adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.llm.common import bounded_batches, fresh, table

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match ends where its digits end, so the next one never begins within a run of digits
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Score of a confirmed proposal, words near by that raise it, and words that lower it. Added kinds need THRESHOLD.
SCORES = {
    "email": (0.9, frozenset("mail email contact write".split()), frozenset()),
    "ip": (0.6, frozenset("ip address addresses host server client".split()), frozenset("version release section".split())),
    "card": (0.8, frozenset("card cards visa credit debit payment mastercard carte karte tarjeta".split()), frozenset("order tracking isbn".split())),
    "phone": (0.7, frozenset("phone telephone tel call mobile fax telefon teléfono téléphone".split()), frozenset("order serial".split())),
    "iban": (0.8, frozenset("iban account bank transfer konto cuenta compte".split()), frozenset({"serial"})),
    "national_id": (
        0.3, frozenset("ssn social security national identity tax dni nie nif identidad documento nir insee sociale steuer steuernummer identifikationsnummer idnr".split()),
        frozenset("order part parts serial".split()),
    ),
}
THRESHOLD, NEAR, RAISED, LOWERED = 0.6, 48, 0.4, 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards, so that long words without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Matches that mod 97 confirms: the longest, or else a shorter one that ends at a blank. After none, the next one may begin within."""
    at = 0
    while m := _IBAN.search(text, at):
        at, end = m.start() + 1, m.end()
        while end > m.start():
            if 15 <= len(account := text[m.start() : end].replace(" ", "")) <= 34 and mod97(account):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)


def _plausible_ssn(shown: str) -> bool:
    area, group, serial = shown.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _letter_mod_23(shown: str) -> bool:
    """A number of eight digits, the first of which may be X, Y or Z for 0, 1 or 2, and the letter that its remainder names."""
    number = shown.replace("-", "")
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == number[-1]


def _key_mod_97(shown: str) -> bool:
    """Thirteen signs, where 2A and 2B stand for 19 and 18, and a key of two digits."""
    number = shown.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return 97 - int(number[:13]) % 97 == int(number[13:])


def _mod_11_10(shown: str) -> bool:
    """Eleven digits of which just one occurs twice or thrice in the first ten, with an ISO 7064 check digit."""
    digits = [int(c) for c in shown if c != " "]
    if sorted(digits[:10].count(d) for d in set(digits[:10]))[-2:] not in ([1, 2], [1, 3]):
        return False
    carry = 10
    for d in digits[:10]:
        carry = ((carry + d) % 10 or 10) * 2 % 11
    return (11 - carry) % 10 == digits[10]


#: Patterns of national numbers, what confirms them, and what that adds to the score.
NATIONAL = (
    (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _plausible_ssn, 0.0),
    (re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z](?![A-Za-z0-9])"), _letter_mod_23, 0.2),
    (re.compile(r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?(?:[0-9]{2}|2[AB])\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])"), _key_mod_97, 0.4),
    (re.compile(r"(?<![0-9])[1-9][0-9](?:\x20?[0-9]{3}){3}(?![0-9])"), _mod_11_10, 0.1),
)


def national_ids(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, added score) of the confirmed matches of all patterns, leftmost and longest first; later ones do not overlap them."""
    found = [(m.start(), -m.end(), added) for pattern, holds, added in NATIONAL for m in pattern.finditer(text) if holds(m.group())]
    done = 0
    for start, end, added in sorted(found):
        if start >= done:
            done = -end
            yield start, done, added


def _propose(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, added score)."""
    for start, end in emails(text):
        yield "email", start, end, 0.0
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end(), 0.0
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), 0.0
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end(), 0.0
    for start, end in ibans(text):
        yield "iban", start, end, 0.0
    for start, end, added in national_ids(text):
        yield "national_id", start, end, added


def _before(text: str, start: int) -> str:
    """The NEAR characters before a span, without a word that they cut."""
    first = max(0, start - NEAR)
    near = text[first:start]
    return re.sub(r"^\w+", "", near) if first and re.match(r"\w", text[first - 1]) else near


def _after(text: str, end: int) -> str:
    near = text[end : end + NEAR]
    return re.sub(r"\w+$", "", near) if re.match(r"\w", text[end + NEAR : end + NEAR + 1]) else near


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind, then start, in code points with the end exclusive. Base kinds stay whatever their score.

    Only whole words near by count.
    """
    out = []
    for kind, start, end, added in _propose(text) if text else ():
        base, good, poor = SCORES[kind]
        near = set(_WORD.findall(f"{_before(text, start)} {_after(text, end)}".lower()))
        score = base + added + RAISED * bool(near & good) - LOWERED * bool(near & poor)
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    return out


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]]) if spans else text


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _scan_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [find_spans(t) for t in texts]
        yield pd.DataFrame({"spans": [[s._asdict() for s in x] for x in found], "redacted": [redact(t, x) for t, x in zip(texts, found, strict=True)]})


def redact_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``text`` redacted and ``n_chars``, where there is one, counted anew; null texts stay null.

    One row for each input row, repeated ones included. Columns whose names clash with those used here come through unchanged.
    """
    found = fresh(docs.columns, "found")[0]
    scanned = docs.withColumn(found, F.pandas_udf(_scan_batches, f"struct<spans:{_SPANS},redacted:string>")("text"))
    text = F.col(found)["redacted"]
    new = {"text": text, "n_chars": F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long")} if "n_chars" in docs.columns else {"text": text}
    return scanned.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


_ADDED = KINDS[len(BASE) :]
_DIGEST_NAMES = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in _ADDED), "min_score"]
_DIGESTS = "struct<" + ",".join(f"{n}:{'bigint' if n.startswith('n_') else 'double' if n == 'min_score' else 'string'}" for n in _DIGEST_NAMES) + ">"


def _digest_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    shown = lambda spans: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)
    for texts in batches:
        rows = []
        for text in texts:
            found = find_spans(text)
            kinds = [s.kind for s in found]
            base = shown(s for s in found if s.kind in BASE)
            rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), shown(found), *(kinds.count(k) for k in _ADDED), min((s.score for s in found), default=None)))
        yield pd.DataFrame(rows, columns=_DIGEST_NAMES).astype({"min_score": "float64"})


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, counts of the added kinds, min_score), one row for each input row.

    A null text is empty; ``min_score`` is null where there is no span.
    """
    return docs.select("doc_id", F.pandas_udf(_digest_batches, _DIGESTS)("text").alias("d")).select("doc_id", "d.*")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return span_digests(table(spark, sf_dir, "documents"))
