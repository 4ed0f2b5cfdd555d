"""Personal data in whole texts, also where it is disguised, with offsets into the text as it stands.

Plain patterns are matched first. Texts with signs of a disguise then pass through a chain of transducers: look-alike
characters, disguised "at" and "dot", spelled digits. Each keeps, for every character it puts out, the span of source
characters it came from. The same patterns run over the normalised text, and what they find is mapped back.
"""

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only and never given back: what fails there fails at every later digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "АВЕКМНОРСТУХІЈЅԚԜ": "ABEKMHOPCTYXIJSQW",
    "авекмнорстухіјѕһԁԛԝ": "abekmhopctyxijshdqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αικνορτυχ": "aiknoptux",
    "ıɑɡ": "iag",
}
# Characters read as a full stop, a hyphen, an at sign.
_SIGNS = {"。": ".", "․": ".", "•": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹫": "@"}
_INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"

# Digits as words, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# Last labels that a host after a bare word "at" may have where its dots are written as dots; prose has "at" too.
COMMON_ENDS = frozenset("com org net edu gov int info biz name io ai app dev co me eu us uk ca au nz de fr es it nl be ch at pl se no fi dk pt ie ru cn jp in br mx ar example test".split())

_AT, _DOT = "at|ät|arobase|arroba|chez", "dot|punkt|point|punto"
_OPEN, _CLOSE, _GAP = r"[\[({<]", r"[\])}>]", r"[ \t]{0,3}"
_BRACKETED_AT = re.compile(rf"{_GAP}{_OPEN}{_GAP}(?:{_AT}|@){_GAP}{_CLOSE}{_GAP}|{_GAP}(?:&#64;|&commat;|%40){_GAP}|(?<=[A-Za-z0-9])[ \t]{{1,3}}@[ \t]{{0,3}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ \t]{{1,3}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[_-](?:at)[_-](?=[A-Za-z0-9])", re.I)
_BRACKETED_DOT = re.compile(rf"{_GAP}{_OPEN}{_GAP}(?:{_DOT}|\.){_GAP}{_CLOSE}{_GAP}|{_GAP}(?:&#46;|&period;|%2e){_GAP}|(?<=[A-Za-z0-9])[_-](?:dot)[_-](?=[A-Za-z0-9])", re.I)
_WORD_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}(?=[A-Za-z0-9])", re.I)
_SAID_DOT = re.compile(r"[ \t](?:dot|punkt)[ \t]", re.I)
_WORD_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{_AT})[ \t]{{1,3}}(?=[A-Za-z0-9-]+\.[A-Za-z0-9])", re.I)
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ ]{{1,2}})?+(?:{_NUMBER}|[0-9]++)(?![^\W_])(?:(?:[ ,-]{{1,2}}|\.)(?:{_NUMBER}|[0-9]++)(?![^\W_]))++", re.I)
_NUMBER_TOKEN = re.compile(rf"plus[ ]{{1,2}}|{_NUMBER}|[0-9]+|\.|[ ,-]+", re.I)

# Signs of a disguise; a text without any has nothing to normalise.
_FOREIGN = re.compile("[^\x00-¬®-İĲ-ɏ‘’“”…€]")
_SIGN_OF_AT_DOT = re.compile(rf"{_OPEN}{_GAP}(?:{_AT}|{_DOT}|[@.]){_GAP}{_CLOSE}|&#(?:64|46);|&commat;|&period;|%40|%2e|[ \t]@|@[ \t]|[ \t](?:{_DOT})[ \t]|[a-z0-9](?:_|-)(?:at|dot)(?:_|-)|[ \t](?:{_AT})[ \t]{{1,3}}[a-z0-9-]+\.[a-z0-9]", re.I)
_FEW_NUMBERS = re.compile(rf"(?<![^\W_])(?:{_NUMBER})[ ,.-]{{1,2}}(?:{_NUMBER}|[0-9]+|{_DOT})(?![^\W_])", re.I)


def _look_alike_table() -> dict[int, str]:
    """Plus, by Unicode's own decompositions, wide, styled and circled forms and the digits of all scripts."""
    table = {ord(a): b for source, target in LOOK_ALIKES.items() for a, b in zip(source, target, strict=True)}
    table |= {ord(a): b for a, b in _SIGNS.items()}
    for code in (*range(0xA0, 0x3400), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if code not in table and unicodedata.decimal(char, None) is not None:
            table[code] = str(unicodedata.decimal(char))
        elif code not in table and len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in " .@+-()_"):
            table[code] = plain
    return table


_TABLE = _look_alike_table()
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def find(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, leftmost and without overlap; matches that fail their check are dropped."""
    emails, ips, cards, phones = [], [], [], []
    if "@" in text:
        low = 0
        for m in _DOMAIN.finditer(text):
            head = text[low : m.start()]
            local = len(head) - len(head.rstrip(_LOCAL))
            if local:
                emails.append((m.start() - local, m.end()))
            low = m.end() if local else m.start() + 1
    if _DIGIT.search(text):
        if "." in text:
            ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                cards.append(m.span())
        if "+" in text:
            phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return [emails, ips, cards, phones]


class _Tape:
    """A text on its way through the transducers, with what each of them replaced: memory follows the replacements."""

    def __init__(self, text: str):
        self.source = self.text = text
        self.steps: list[tuple[array, array, array, array]] = []

    def rewrite(self, pattern: re.Pattern, write) -> None:
        """Replaces each match by what `write(match)` gives: a list of (characters read, text written)."""
        out, done, shift = [], 0, 0
        step = put_at, put_end, took_at, took_end = array("q"), array("q"), array("q"), array("q")
        for m in pattern.finditer(self.text):
            out.append(self.text[done : m.start()])
            at = m.start()
            for read, written in write(m):
                out.append(written)
                for place, value in zip(step, (at + shift, at + shift + len(written), at, at + read), strict=True):
                    place.append(value)
                shift += len(written) - read
                at += read
            done = m.end()
        if put_at:
            self.text = "".join([*out, self.text[done:]])
            self.steps.append(step)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that became `text[start:end]`."""
        last = end - 1
        for put_at, put_end, took_at, took_end in reversed(self.steps):
            bounds = []
            for at in (start, last):
                k = bisect_right(put_at, at) - 1
                if k >= 0 and at < put_end[k]:
                    bounds.append((took_at[k], took_end[k] - 1))
                else:
                    own = at + (took_end[k] - put_end[k] if k >= 0 else 0)
                    bounds.append((own, own))
            start, last = bounds[0][0], bounds[1][1]
        return start, last + 1


def _spelled(m: re.Match) -> list[tuple[int, str]]:
    """Words become digits; what stands between two of them goes, so that numbers spelled digit by digit close up."""
    tokens = _NUMBER_TOKEN.findall(m[0])
    written = [DIGIT_WORDS.get(t.lower(), "+" if t.lower().startswith("plus") else t) for t in tokens]
    spelled = [t.lower() in DIGIT_WORDS for t in tokens]
    if sum(spelled) < 3:
        return [(len(m[0]), m[0])]
    for i in range(1, len(tokens) - 1):
        if spelled[i - 1] and spelled[i + 1] and tokens[i] != ".":
            written[i] = ""
    return [(len(t), w) for t, w in zip(tokens, written, strict=True)]


def normalise(text: str) -> _Tape | None:
    """The text without disguises, or None if it shows no sign of any."""
    foreign = not text.isascii() and bool(_FOREIGN.search(text))
    signs, numbers = bool(_SIGN_OF_AT_DOT.search(text)), bool(_FEW_NUMBERS.search(text))
    if not (foreign or signs or numbers):
        return None
    tape = _Tape(text)
    if foreign:
        tape.text = text.translate(_TABLE)  # one for one, so nothing moves
        tape.rewrite(_HIDDEN, lambda m: [(len(m[0]), "")])
    for pattern, sign in ((_BRACKETED_DOT, "."), (_BRACKETED_AT, "@"), (_WORD_DOT, "."), (_WORD_AT, "@")):
        tape.rewrite(pattern, lambda m, sign=sign: [(len(m[0]), sign)])
    tape.rewrite(_SPELLED, _spelled)
    return tape


def _credible(tape: _Tape, kind: int, start: int, end: int) -> bool:
    """Whether a find on the normalised text is one. A bare word "at" needs a second sign of an address: a spelled dot before any host
    end of three letters or more, or a common end with a spelled dot or a name that is no plain word."""
    found = tape.text[start:end]
    if kind == 0:
        sign = start + found.index("@")
        first, last = tape.span(sign, sign + 1)
        if "@" not in tape.source[first:last] and tape.source[first:last].strip().isalpha():
            domain = tape.span(sign + 1, end)
            last_label = found.rpartition(".")[2].lower()
            if last_label not in COMMON_ENDS:
                # Both signs are words; prose hardly has "at" and "dot" around a single word, and short words least.
                return last_label.isalpha() and 3 <= len(last_label) <= 24 and bool(_SAID_DOT.search(tape.source[slice(*domain)]))
            return bool(re.search("[0-9._%+-]", found[: sign - start])) or tape.source[slice(*domain)] != found[sign - start + 1 :]
    return kind == 0 or len(set(_digits(found))) > 1


def spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans, and all spans with those the normalised text adds: disguised ones that no base span holds."""
    base = find(text)
    tape = normalise(text)
    if tape is None:
        return base, base
    every = []
    for kind, (plain, found) in enumerate(zip(base, find(tape.text), strict=True)):
        added = []
        for start, end in found:
            first, last = tape.span(start, end)
            held = any(a <= first and last <= b for a, b in plain)
            if not held and tape.source[first:last] != tape.text[start:end] and _credible(tape, kind, start, end):
                added.append((first, last))
        every.append(sorted({*plain, *added}))
    return base, every


def write_spans(found: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, found, strict=True) for a, b in own)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans of every row.

    Offsets are code points of the text as given, end exclusive. Null and empty texts have no spans: zero counts, the hash of
    the empty text, empty `spans`. Every row gives one row, repeated and null ids too; an empty table an empty one. Texts
    are read whole. Other columns are not read.
    """

    def search(batches):
        for batch in batches:
            for part, texts in slices(batch):
                both = [spans(t or "") for t in texts]
                counts = [pa.array([len(every[k]) for _, every in both], pa.int64()) for k in range(len(KINDS))]
                digests = [hashlib.sha256(write_spans(base).encode()).hexdigest() for base, _ in both]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(digests, pa.string()), pa.array([write_spans(every) for _, every in both], pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(search, f"doc_id {dict(rows.dtypes)['doc_id']}, {counts}, base_sha256 string, spans string")
