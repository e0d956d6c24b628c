"""Personal data in texts: four patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans of e-mail addresses, IP addresses, payment cards and phone numbers.
The field adds spans that are written in other ways, and secrets behind words such as password. It is
trained from a small labelled table, on the shapes of a token and its neighbours, and decodes lines as
wholes. Lines without a digit, an @ and the word at are passed over, which loses nothing: no span goes
over a line end, and `plausible` takes none that has none of these. Lines are decoded together, in
padded numpy batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import lean, portions

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

# --- Base spans -------------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@+=\[]")


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the @ signs so that long words cost linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)
    return out


def _ip_valid(found: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in found.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points."""
    if not _MARK.search(text):
        return []
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_valid(m[0])]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- The field --------------------------------------------------------------------------------------------------------

#: The labelled table: sentences with the spans marked as {kind|text}.
EXAMPLES = (
    "please write to {email|jane.roe@mail.example.com} today",
    "or ask {email|j_doe7@example.org}, who knows",
    "mail: {email|anna.k (at) example.com} any time",
    "reach me under {email|tom dot lee at example dot net} please",
    "her address is {email|maria [at] example [dot] org} since may",
    "send it to {email|sales [at] shop.example.com} soon",
    "contact {email|r.voss at mail dot example dot de} for it",
    "the server {ip|192.0.2.44} was down",
    "from {ip|198.51.100.7} to {ip|203.0.113.250} in a minute",
    "blocked {ip|192.0.2[.]17} and {ip|198[.]51[.]100[.]9} again",
    "host {ip|10.0.0.1}, then host {ip|172.16.4.21}.",
    "Seen at {ip|42.144.35.254} twice. Then {ip|55.63.178.142} and {ip|8.8.4.4} once",
    "near {ip|203.0.113.5} Der {ip|99.52.9.129} the {ip|7.212.14.63}",
    "Words end. Then {email|kbo.42@mail8.example.com} follows",
    "more. {email|x_y.07@mail3.example.org} And more words",
    "write bob, or {email|bob dot smith at mail dot example dot com} at noon",
    "ask {email|kim (at) example.org} or {email|lea (at) mail.example.com} about it",
    "the card {card|4111 1111 1111 1111} was charged",
    "paid with {card|5500-0000-0000-0004} on monday",
    "card no. {card|4012888888881881} is valid",
    "number {card|3782 822463 10005} of the card",
    "and {card|4716461583322103} the other",
    "call {phone|+1 (212) 555-0188} now",
    "call {phone|(212) 555-0147} after six",
    "phone: {phone|212-555-0199} or later",
    "tel. {phone|+49 30 5550123} in the office",
    "tel {phone|0221 / 555 0133} in the evening",
    "her phone is {phone|030 / 555 0177} at home",
    "dial {phone|555.010.4477} for help",
    "my mobile {phone|+44 20 7946 0958}, ask for me",
    "fax {phone|212 555 0110} only",
    "password={secret|hunter2a9f03} is set",
    "the password: {secret|Tr0ub4dor3} must change",
    'token = "{secret|9f8e7d6c5b4a39281706}" in the file',
    "api_key={secret|sk9a8b7c6d5e4f3a2b1c} was leaked",
    "secret = {secret|a1b2c3d4e5f60718} there",
    'key: "{secret|0123456789abcdef01234567}" found',
    "passwd={secret|x7y8z9w0} again",
    'a token = "{secret|06a1917ea4e9feb9cda8}" is in it',
    'the token = "{secret|0b1beb58b8af68}" once more',
    'with secret = "{secret|c0ffee99}" in quotes',
    "and password={secret|531ccd051a} la here",
    "and password={secret|0030ef94f364d8} as here",
    "it has token {secret|BD7EW7YT55JDR} at its end",
    "Licensed under the Apache License, Version 2.0.",
    "under the license, version 3. De la osra. The end",
    "released under terms 4.0. &&& and *** the rest",
    "phone {phone|+1 (269) 555-0196} {card|4524132264652876} and so",
    "of {card|4451718024887799} {ip|27.65.9.12} there",
    "in 2021 the price was 19.99 per unit",
    "on 2023-04-17 at 12:30 we met",
    "version 2.10.3 was released on 17.04.2023",
    "chapter 7, pages 112-134, in volume 3",
    "about 1,250,000 people and 37 % of them",
    "order 4711 has 12 items of 250 g each",
    "between 1914 and 1918, for 4 years",
    "the ratio is 3/4 and x = 5 in the equation",
    "if a = b + c then c = a - b follows",
    "see [1] and [12] for the proof",
    "room 212, floor 5, building 10",
    "isbn 978-3-16-148410-0 is a book number",
    "speed of 299792458 m per second",
    "a list [a, b, c] and an array [0]",
    "the 1st, 2nd and 3rd of 24 teams",
    "meet me @ noon or @ 5 there",
    "follow @someone and @another2 for news",
    "1 + 1 = 2 and 2 + 2 = 4 hold",
    "c++ and a+ are names, b+ as well",
    "at 100 dot com boom in 1999 and 2000",
    "the key = value form, the token = word form",
    "temperatures from -12 to +35 degrees",
    "serial no 20394857 and lot 88120",
    "sections 1.2.3 and 4.5.6 and 10.11",
    "id 550e8400 of 16 bytes, page 3 of 9",
    "she scored 98 of 100 points, he 75",
    "a 1234567 b 7654321 c 1000000",
    "top 10 of 2024: 5 films, 3 books",
    "the code 4 5 6 7 8 9 was shown on 3 screens",
)
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\w\s]|_")
_WORDS = frozenset("at dot mail email phone tel fax call dial mobile password passwd token secret key card api host server com org net de".split())
#: What every span that `plausible` takes has: a digit, an @ or the token at.
_NEEDED = re.compile(r"[0-9@]|(?<![^\W0-9_])at(?![^\W0-9_])")
#: Tokens of a padded batch.
PADDED = 100_000
STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def shape(token: str) -> str:
    """The kind of a token: digits by number, known words, other words by case and length, symbols themselves."""
    if "0" <= token[0] <= "9":
        return f"d{min(len(token), 9)}"
    if token[0].isalpha() or token[0].isalnum():
        lower = token.lower()
        if lower in _WORDS:
            return f"w:{lower}"
        case = "u" if token.isupper() else "t" if token[0].isupper() else "l"
        return f"{case}{1 if len(token) == 1 else 3 if len(token) < 4 else 9}"
    return f"s:{token}" if token in "@+=-.:/()[],\"'_|<>#%" else "s"


def stretches(text: str) -> list[tuple[int, int]]:
    """The lines of a text that can hold a span."""
    out: list[tuple[int, int]] = []
    found = _NEEDED.search(text)
    while found:
        start, end = text.rfind("\n", 0, found.start()) + 1, text.find("\n", found.end())
        end = len(text) if end < 0 else end
        out.append((start, end))
        found = _NEEDED.search(text, end)
    return out


@dataclass
class Sequence:
    starts: list[int]
    ends: list[int]
    shapes: list[str]
    glued: list[bool]


def tokens(text: str, start: int = 0, end: int | None = None) -> Sequence:
    found = [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]
    glued = [i > 0 and found[i - 1][1] == s for i, (s, _) in enumerate(found)]
    return Sequence([s for s, _ in found], [e for _, e in found], [shape(text[s:e]) for s, e in found], glued)


class Field:
    """Weights of a linear-chain conditional random field: shapes at five places, gluedness, transitions."""

    places = (-2, -1, 0, 1, 2)

    def __init__(self, shapes: list[str]):
        self.index = {s: i for i, s in enumerate(["", "?", *shapes])}
        k = len(STATES)
        self.emit = np.zeros((len(self.places), len(self.index), k))
        self.glue = np.zeros((2, k))
        self.next = np.zeros((k, k))

    def features(self, seq: Sequence) -> np.ndarray:
        """Shape numbers of each token and its neighbours, and gluedness, as columns."""
        known = np.array([self.index.get(s, 1) for s in seq.shapes], dtype=np.int64)
        n, pad = len(known), np.concatenate(([0, 0], known, [0, 0]))
        return np.stack([*(pad[2 + p : 2 + p + n] for p in self.places), np.array(seq.glued, dtype=np.int64)], axis=1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.glue[features[..., -1]]
        for i in range(len(self.places)):
            out = out + self.emit[i][features[..., i]]
        return out

    def decode(self, sequences: list[Sequence], batch: int = 512) -> list[np.ndarray]:
        """The best states of each sequence (Viterbi), in padded batches of sequences of like length.

        A batch has at most `batch` sequences and, unless it is one sequence, `PADDED` tokens.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if s.shapes), key=lambda i: len(sequences[i].shapes))
        moves = self.next + _FORBIDDEN
        while order:
            longest = len(sequences[order[-1]].shapes)
            count = max(1, min(batch, PADDED // longest))
            order, part = order[:-count], order[-count:]
            sizes = np.array([len(sequences[i].shapes) for i in part])
            emit = np.zeros((len(part), sizes.max(), len(STATES)))
            for row, i in enumerate(part):
                emit[row, : sizes[row]] = self.scores(self.features(sequences[i]))
            best = emit[:, 0] + _FORBIDDEN[0]
            back = np.zeros((len(part), sizes.max(), len(STATES)), np.int8)
            final = np.where(sizes == 1, best.argmax(axis=1), 0)
            for t in range(1, sizes.max()):
                paths = best[:, :, None] + moves
                back[:, t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + emit[:, t]
                ends = sizes == t + 1
                final[ends] = best[ends].argmax(axis=1)
            for row, i in enumerate(part):
                states = np.zeros(sizes[row], np.int64)
                states[-1] = final[row]
                for t in range(sizes[row] - 1, 0, -1):
                    states[t - 1] = back[row, t, states[t]]
                out[i] = states
        return out


#: An inside state only follows the begin or inside state of its kind; row 0 also stands for the start.
_FORBIDDEN = np.array(
    [[-np.inf if t[0] == "I" and (s == "O" or s[2:] != t[2:]) else 0.0 for t in STATES] for s in STATES]
)


def labelled_sequence(marked: str) -> tuple[Sequence, np.ndarray]:
    """Tokens and states of a sentence of the labelled table."""
    text, spans = "", []
    for kind, inner, plain in re.findall(r"\{(\w+)\|([^}]*)\}|([^{]+)", marked):
        if kind:
            spans.append((kind, len(text), len(text) + len(inner)))
        text += inner or plain
    seq = tokens(text)
    states = np.zeros(len(seq.starts), np.int64)
    for kind, start, end in spans:
        inside = [i for i, s in enumerate(seq.starts) if start <= s < end]
        for n, i in enumerate(inside):
            states[i] = STATES.index(f"{'I' if n else 'B'}-{kind}")
    return seq, states


def train(examples=EXAMPLES, rounds: int = 200, decay: float = 0.005, step: float = 0.3) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient steps scaled by their history."""
    data = [labelled_sequence(e) for e in examples]
    field = Field(sorted({s for seq, _ in data for s in seq.shapes}))
    features = [field.features(seq) for seq, _ in data]
    size, k = max(map(len, features)), len(STATES)
    x = np.zeros((len(data), size, features[0].shape[1]), np.int64)
    y, real = np.zeros((len(data), size), np.int64), np.zeros((len(data), size), bool)
    for i, (f, (_, states)) in enumerate(zip(features, data)):
        x[i, : len(f)], y[i, : len(f)], real[i, : len(f)] = f, states, True
    weights = (field.emit, field.glue, field.next)
    history = [np.full_like(w, 1e-6) for w in weights]
    for _ in range(rounds):
        forward, backward = np.zeros((len(data), size, k)), np.zeros((len(data), size, k))
        emit, moves = field.scores(x), field.next + _FORBIDDEN
        forward[:, 0] = emit[:, 0] + _FORBIDDEN[0]
        for t in range(1, size):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(size - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], new, backward[:, t + 1])
        state = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        both = real[:, 1:]
        joint = np.exp(
            forward[:, :-1, :, None] + moves + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * both[..., None, None]
        target = np.eye(k)[y] * real[..., None]
        miss = target - state
        slopes = [np.zeros_like(w) for w in weights]
        for i in range(len(field.places)):
            np.add.at(slopes[0][i], x[..., i], miss)
        np.add.at(slopes[1], x[..., -1], miss)
        slopes[2] -= joint.sum(axis=(0, 1))
        np.add.at(slopes[2], (y[:, :-1][both], y[:, 1:][both]), 1.0)
        for w, slope, past in zip(weights, slopes, history):
            slope -= decay * w
            past += slope**2
            w += step * slope / np.sqrt(past)
    return field


def plausible(kind: str, found: str) -> bool:
    """Whether a stretch can be of its kind at all; the field may join or cut what cannot."""
    digits = _digits(found)
    if "\n" in found:
        return False
    if kind == "email":
        return bool(re.search(r"@|\bat\b", found)) and bool(re.search(r"\.|\bdot\b", found))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and _ip_valid(".".join(parts))
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return len(found) >= 8 and not re.search(r"\s", found) and bool(digits)


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """The spans the field finds in each text, without the patterns."""
    parts = [(n, tokens(text, a, b)) for n, text in enumerate(texts) for a, b in stretches(text)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (n, seq), states in zip(parts, field.decode([s for _, s in parts])):
        for i in np.flatnonzero(states % 2 == 1):
            end = i
            while end + 1 < len(states) and states[end + 1] == states[i] + 1:
                end += 1
            kind, start, stop = STATES[states[i]][2:], seq.starts[i], seq.ends[end]
            if kind == "secret":  # the whole word
                while start > 0 and texts[n][start - 1].isalnum():
                    start -= 1
                while stop < len(texts[n]) and texts[n][stop].isalnum():
                    stop += 1
            if plausible(kind, texts[n][start:stop]):
                out[n].append((kind, start, stop))
    return out


def merged(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All base spans, and the others that overlap none of them; by kind, then start."""
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else np.zeros(0, int)
    free = []
    for span in more:
        before = int(np.searchsorted(starts, span[2], "left"))
        if before == 0 or reach[before - 1] <= span[1]:
            free.append(span)
    return sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced together."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def with_personal_data(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """Adds `base_spans`, `spans` (kind:start:end, joined by commas) and `masked` to `docs`.

    A null text counts as empty and has no spans; columns of those names are replaced, others stay.
    """
    field = field or train()
    found = "struct<base_spans:string,spans:string,masked:string>"

    @F.pandas_udf(found)
    @lean
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in portions(t or "" for t in batch):
                rows = []
                for value, more in zip(part, field_spans(part, field)):
                    base = base_spans(value)
                    spans = merged(base, more)
                    rows.append((joined(base), joined(spans), masked(value, spans) if spans else value))
                yield pd.DataFrame(rows, columns=["base_spans", "spans", "masked"])

    return docs.withColumn("_found", find(F.col(text).cast("string"))).withColumns(
        {c: F.col(f"_found.{c}") for c in ("base_spans", "spans", "masked")}
    ).drop("_found")


def span_counts(base: str) -> dict:
    """Columns that derive the counts and the checksum from the column of base spans."""
    counts = {f"n_{k}": F.regexp_count(F.col(base), F.lit(f"(^|,){k}:")).cast("long") for k in BASE}
    return {**counts, "base_sha256": F.sha2(F.col(base), 256)}
