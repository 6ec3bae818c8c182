"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field is trained from a small labelled table of sentences (TRAINING, written here, or any
table of the same form) and finds names after a cue, birth dates, identity numbers and local
phone numbers. Texts are cut into words at white space and into pieces at line ends and
after PIECE words; a piece is decoded with CONTEXT words of its line on both sides, whose own labels
come from their pieces. All pieces of a batch are decoded together by Viterbi in numpy.

Edge cases: null text is empty; a text without spans has counts 0, the hash of the empty string
and an empty span list; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, rows_out
from .crf import Crf

BASE = ("email", "ip", "card", "phone")
FOUND = ("name", "birth", "idno", "local")
KINDS = (*BASE, *FOUND)
#: Words of a piece that is decoded at once, and of its line that are decoded with it on each side.
PIECE, CONTEXT = 64, 8

# base patterns; a search can only start where a run of its characters starts, so it is linear
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: The labelled table: sentences in which {kind:words} marks a span. Written for this module.
TRAINING = (
    "My name is {name:Maria Lopez} and I work here.",
    "my name is {name:John Smith}",
    "Hello, my name is {name:Peter} and this is my house.",
    "Name: {name:Anna Karlsson}",
    "Dear Mr. {name:Robert Brown}, thank you for the letter.",
    "Please ask Mrs. {name:Clara Weber} for the key.",
    "Contact Dr. {name:Alan Moore} for details.",
    "Signed by Ms. {name:Julia Novak} on Monday.",
    "Name: {name:Pierre Dubois}, manager.",
    "The report of Mr. {name:Tom Hill} is late.",
    "Date of birth: {birth:12/03/1984}",
    "She was born on {birth:1979-11-02} in the north.",
    "DOB: {birth:04.07.1990}",
    "born on {birth:23/08/1965} and raised by the sea.",
    "SSN: {idno:123-45-6789}",
    "Her SSN is {idno:987-65-4320} and nothing else.",
    "Passport number: {idno:X1234567}",
    "social security number {idno:078-05-1120}",
    "Call me at {local:(555) 123-4567} tomorrow.",
    "Tel: {local:555-867-5309}",
    "phone {local:(212) 555-0187} or write.",
    "Our phone: {local:030-555-4821}",
    "The name of the river is old and nobody knows it.",
    "What is the name of The Blue House?",
    "Then they went to London and Paris in May.",
    "The meeting was on 12/03/1984 in the hall.",
    "Version 1.2.3 was released on 2019-04-01 by the team.",
    "In 1990 the price was 12,500 and in 1991 it was 13,000.",
    "Green hills and Old walls lie behind the town.",
    "Many rivers run south. Others run north and Some run west.",
    "Der Ein und die Erst in Lich.",
    "La Casa de los Bosques es grande.",
    "Order 555-123 was shipped in box 12-34-5678.",
    "The entry 4785380592391139 stands in the ledger.",
    "Mr and Mrs are words, and so is Dr in a list.",
    "call it a day or phone home",
    "She said that the number is 42 and the born are many.",
    "NAME LIST AND OTHER THINGS",
    "call The Man from The Hill",
    "He was born in The Old Town and lived on.",
    "My name is {name:Laura B. Fields}.",
    "My name is {name:Bruno} and I wrote last week.",
    "The visitor was Mr. {name:George H. Patel} from the bank.",
    "Mr. {name:Leo} left early.",
    "Mrs. {name:Dora} took the train.",
    "Mrs. {name:Edith W. Lange} paid in cash.",
    "Ms. {name:Nina} is waiting outside.",
    "A letter from Ms. {name:Vera}, cashier, came today.",
    "Dr. {name:Emil} will see you now.",
    "Dr. {name:Ruth G. Silva} wrote the paper.",
    "We thank Mr. {name:Sean O'Neill} and his team.",
    "Name: {name:Irene}, driver",
    "Name: {name:Carl V. Jensen}",
    "Name: {name:Anne Smith-Jones}, nurse",
    "first name: {name:Rosa}",
    "Date of birth: {birth:03/08/1955} Sex: F",
    "Date of birth: {birth:1968-12-24}, city: Lyon",
    "DOB: {birth:19/06/2001}; class: B",
    "My son was born on {birth:11.09.1947}.",
    "Passport number: {idno:K7654321}",
    "The form says SSN: {idno:219-09-9999}, and a date.",
    "Their phone is {local:555-403-2217} in the evening.",
    "His phone is {local:404-238-0175} now.",
    "phone is {local:(303) 555-0110} there",
    "Please call me at {local:404-555-0199} tonight.",
    "call me at {local:(617) 244-0133} instead",
    "phone: {local:617-555-0133}, mornings only",
    "Phone: {local:(617) 555-0171}",
    "Tel: {local:702-318-4410} or by post",
    "Call {local:702-555-0148} now.",
    "Name of the ship: Old Star",
    "First came plan A. B. Then came C. and the rest.",
    "It ended. A. I. Older lists have more of them.",
    "host name: server.local",
    "user name: admin",
    "Table name: orders, column name: total",
    "Name and address of the shop are on the door.",
    "Box number: 77 is empty.",
    "The phone is broken and the line is dead.",
    "Call me at noon or at 10:45.",
    "Mr. and Mrs. were the first words.",
    "There is 555-700 and there is 123-45-6789-10 in the list.",
)

#: Cue words, as features of their own.
CUES = ("name", "name:", "is", "mr.", "mrs.", "ms.", "dr.", "born", "on", "birth:", "dob:", "ssn", "ssn:", "number", "number:", "security", "passport", "tel:", "phone", "phone:", "call", "me", "at")
_SHAPES = 509


def shape(word: str) -> str:
    """Classes of a word's characters: X upper, x lower, d digit, others stay; long runs of letters shorten."""
    out = []
    for c in word[:40]:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not (k in "Xx" and len(out) >= 2 and out[-1] == out[-2] == k):
            out.append(k)
    return "".join(out)


def _bucket(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(shape(word).encode(), digest_size=4).digest(), "big") % _SHAPES


def word_features(word: str) -> tuple[int, int, int]:
    """Numbers of a word's shape (a bucket of a hash), of its shape without the marks at its end, and of its cue, 0 if it is none."""
    low = word.lower()
    return _bucket(word), _bucket(word.rstrip(".,;:!?")), 1 + CUES.index(low) if low in CUES else 0


class Words(dict):
    """Features of each word as (bare shape * 512 + shape) * 64 + cue; short words are remembered, up to about 100 MB."""

    def __missing__(self, word: str) -> int:
        h, bare, cue = word_features(word)
        out = (bare * 512 + h) * 64 + cue
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = out
        return out


_TABLES = (_SHAPES, _SHAPES, _SHAPES, _SHAPES, 64, 64, 64)
ROWS = sum(_TABLES)


def features(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of the tables for each word: own bare shape, own, last and next shape, own, last and last but one cue.

    Pieces do not see each other: beyond the ends there is shape 0 and cue 0 of the edge.
    """
    n = len(words)
    at = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - at
    bare, s, c = words >> 15, words >> 6 & 511, words & 63

    def moved(x: np.ndarray, k: int, edge: int) -> np.ndarray:
        out = np.full(n, edge)
        if k > 0:
            out[k:] = x[:-k]
            out[at < k] = edge
        else:
            out[:k] = x[-k:]
            out[left <= -k] = edge
        return out

    parts = (bare, s, moved(s, 1, 0), moved(s, -1, 0), c, moved(c, 1, 63), moved(c, 2, 63)) if n else (s,) * 7
    return np.column_stack([p + o for p, o in zip(parts, np.cumsum((0, *_TABLES[:-1])), strict=True)])


def labelled(sentence: str) -> tuple[list[str], list[int]]:
    """Words and labels (0, then begin and inside of each kind) of a marked sentence."""
    words, labels = [], []
    for part in re.split(r"(\{\w+:[^}]*\}\S*)", sentence):
        m = re.fullmatch(r"\{(\w+):([^}]*)\}(\S*)", part)
        for k, w in enumerate((m[2] + m[3] if m else part).split()):
            words.append(w)
            labels.append(0 if not m else 1 + 2 * FOUND.index(m[1]) + (k > 0))
    return words, labels


@lru_cache(maxsize=4)
def trained(sentences: tuple[str, ...] = TRAINING) -> Crf:
    known, sequences = Words(), []
    for x in sentences:
        words, labels = labelled(x)
        f = np.array([known[w] for w in words])
        sequences.append((features(f, np.array([len(f)])), np.array(labels)))
    return Crf.trained(sequences, ROWS, 1 + 2 * len(FOUND))


def field_spans(texts: list[str], crf: Crf, known: Words) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the field finds in each text."""
    words, sizes, of, skip, core = [], [], [], [], []
    for t, text in enumerate(texts):
        for line in text.split("\n"):
            ws = line.split()
            for i in range(0, len(ws), PIECE):
                piece = ws[max(0, i - CONTEXT) : i + PIECE + CONTEXT]
                words.append(piece)
                sizes.append(len(piece))
                of.append(t)
                skip.append(min(i, CONTEXT))
                core.append(min(PIECE, len(ws) - i))
    out: list[list] = [[] for _ in texts]
    lengths = np.array(sizes, np.int64)
    f = np.fromiter((known[w] for p in words for w in p), np.int64, int(lengths.sum()))
    labels = crf.decoded(features(f, lengths), lengths)
    at = np.arange(len(f)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first, lengths_inner = np.array(skip, np.int64), np.array(core, np.int64)
    labels = labels[(at >= np.repeat(first, lengths)) & (at < np.repeat(first + lengths_inner, lengths))]
    lengths = lengths_inner
    if not labels.any():
        return out
    begin = np.cumsum(lengths) - lengths
    piece_of = np.repeat(np.arange(len(sizes)), lengths)
    for t in sorted({of[p] for p in np.unique(piece_of[labels > 0]).tolist()}):
        mine = [p for p in range(len(of)) if of[p] == t]
        tags = np.concatenate([labels[begin[p] : begin[p] + lengths[p]] for p in mine]).tolist()
        places = [(m.start(), m.end()) for m in re.finditer(r"\S+", texts[t])]
        k = 0
        while k < len(tags):
            if tags[k] == 0:
                k += 1
                continue
            kind, first = (tags[k] - 1) // 2, k
            k += 1
            while k < len(tags) and tags[k] == 2 + 2 * kind:
                k += 1
            a, b = places[first][0], places[k - 1][1]
            while b > a and texts[t][b - 1] in ".,;:!?":
                b -= 1
            out[t].append((a, len(BASE) + kind, b))
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{x}", pa.int64()) for x in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])


def described(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: tuple[str, ...] = TRAINING) -> DataFrame:
    """One row a document: counts of the base kinds, the hash of the base spans, all spans."""
    crf = trained(tuple(sentences))
    parts = (crf.emission, crf.transition, crf.start)

    def run(batches):
        field, known = Crf(*parts), Words()
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            more = [s for i in range(0, len(texts), 64) for s in field_spans(texts[i : i + 64], field, known)]
            out = {x.name: [] for x in _FOUND}
            for text, added in zip(texts, more, strict=True):
                base = base_spans(text)
                new = [x for x in added if not any(a < x[2] and x[0] < b for a, _, b in base)]
                for k, x in enumerate(BASE):
                    out[f"n_{x}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(described(base).encode()).hexdigest())
                out["spans"].append(described(sorted(base + new)))
            out["doc_id"] = batch.column("id")
            yield rows_out(out, _FOUND)

    schema = "doc_id long, " + ", ".join(f"n_{x} long" for x in BASE) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)
