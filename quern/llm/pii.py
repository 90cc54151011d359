"""Personal data: exact patterns, and spans that a trained character tagger adds.

The base patterns find e-mail addresses, IP addresses, card and phone numbers in their usual
forms. They miss what runs into other numbers (a phone number and a card number with a blank
between are one run of digits to them) and what is written otherwise (``name at host dot
org``, numbers without a plus). A bidirectional LSTM with CRF transitions
(:mod:`quern.llm.char_tagger`) labels every character of every text; its spans are added
where no base span is, if their digits or words hold up (the card's check digit, octets of
at most 255, and so on).

The tagger is trained here, from labelled spans: contexts cut from a bounded sample of the
texts, with their base matches, and items of all kinds, plain, rewritten, adjacent, and
look-alikes of none, that are put into them. Texts are independent: no shuffle but for the
sample.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import char_tagger
from quern.llm.char_tagger import Tagger
from quern.llm.common import documents, text_of

KINDS = ["email", "ip", "card", "phone"]

#: Texts that contexts are cut from, at most, and the characters of a context.
SAMPLE = 2_000
CONTEXT = 60
#: Training texts that are made, of each context as often as of any other.
MADE = 6_000

#: Digits of a card and of a phone number, and a part of an IP address.
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)
MOST_IP = 255

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "A-Za-z0-9._%+-"
_NOT_LOCAL = re.compile(f"[^{_LOCAL}]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[\x20().0-9-][0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards, as long runs before it would be read again and again."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _DOMAIN.match(text, at + 1)
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if host and start < at:
            yield start, host.end()
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ip_holds(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= MOST_IP for p in text.split("."))


def _card_holds(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)


def _phone_holds(text: str) -> bool:
    return PHONE_DIGITS[0] <= len(_NOT_DIGIT.sub("", text)) <= PHONE_DIGITS[1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns: leftmost, not overlapping within a kind."""
    out = [(0, s, e) for s, e in _emails(text)]
    for kind, pattern, holds in ((1, _IP, _ip_holds), (2, _CARD, _card_holds), (3, _PHONE, _phone_holds)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return out


# Forms that an added span must have, beside what holds for its kind.
_AT = r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s|\s@\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\s\.\s)"
_ADDED_EMAIL = re.compile(
    rf"[A-Za-z0-9_%+-]+(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]+){{0,3}}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{1,4}}", re.I
)
_ADDED_CARD = re.compile(r"[0-9](?:[\x20./-]?[0-9])+")
_ADDED_PHONE = re.compile(r"(?:\+|00|\()?[0-9][\x20()./0-9-]*[0-9]")
_GROUPS = re.compile(r"[0-9]+")
_NOT_BLANK = re.compile(r"\S+")
#: A span of more words than this is no span of numbers.
MOST_WORDS = 16


def _added_holds(kind: int, text: str) -> bool:
    if kind == 0:
        return bool(_ADDED_EMAIL.fullmatch(text))
    if kind == 1:
        return bool(_IP.fullmatch(text)) and _ip_holds(text)
    if kind == 2:
        return bool(_ADDED_CARD.fullmatch(text)) and _card_holds(text)
    if not _ADDED_PHONE.fullmatch(text) or not _phone_holds(text):
        return False
    groups = _GROUPS.findall(text)
    # Without a plus, a number that is parted like a phone number.
    return text[0] == "+" or (len(groups) >= 3 and len("".join(groups)) >= 10 and max(map(len, groups)) <= 7)


def _trimmed(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """To whole runs of digits (or of an address), and without marks beside them."""
    inside = str.isdigit if kind else lambda c: c.isascii() and (c.isalnum() or c in "_%+-.")
    while start > 0 and inside(text[start - 1]) and inside(text[start]):
        start -= 1
    while end < len(text) and inside(text[end]) and inside(text[end - 1]):
        end += 1
    first = "+(0123456789" if kind == 3 else "0123456789" if kind else None
    while start < end and not (text[start] in first if first else text[start].isalnum()):
        start += 1
    while start < end and not (text[end - 1] in "0123456789" if kind else text[end - 1].isalnum()):
        end -= 1
    if kind == 3 and start > 0 and text[start - 1] in "+(":
        start -= 1
    return start, end


def _holding(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span if it holds up, or else the longest part of it, between blanks, that does."""
    if _added_holds(kind, text[start:end]):
        return start, end
    words = [(m.start(), m.end()) for m in _NOT_BLANK.finditer(text, start, end)]
    if kind == 0 or len(words) > MOST_WORDS:
        return None
    parts = [(a, b) for i, (a, _) in enumerate(words) for _, b in words[i:]]
    for a, b in sorted(parts, key=lambda p: (p[0] - p[1], p)):
        a, b = _trimmed(kind, text, a, b)
        if a < b and start <= a and b <= end and _added_holds(kind, text[a:b]):
            return a, b
    return None


def all_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """``(kind, start, end, base)`` of each text, by kind and place."""
    out = []
    for text, tagged in zip(texts, char_tagger.spans_of(model, texts)):
        base = base_spans(text)
        # Base spans of different kinds may overlap; here they are joined.
        taken: list[list[int]] = []
        for s, e in sorted((s, e) for _, s, e in base):
            if taken and s < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], e)
            else:
                taken.append([s, e])
        starts = [s for s, _ in taken]
        found, done = [(k, s, e, True) for k, s, e in base], 0
        for start, end, kind, _ in tagged:
            start, end = _trimmed(kind, text, start, end)
            near = bisect_left(starts, end) - 1
            free = start >= done and (near < 0 or taken[near][1] <= start)
            if start < end and free and (held := _holding(kind, text, start, end)):
                found.append((kind, *held, False))
                done = held[1]
        out.append(sorted(found))
    return out


# What training texts are made of.


class Maker:
    """Items of every kind in many forms, and look-alikes, from a seeded source."""

    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.random.choice("0123456789") for _ in range(n))

    def word(self, low: int = 2, high: int = 9) -> str:
        return "".join(self.random.choice("abcdefghijklmnoprstuvwz") for _ in range(self.random.randint(low, high)))

    def parted(self, sizes: list[int], mark: str) -> str:
        return mark.join(self.digits(n) for n in sizes)

    def email(self) -> str:
        r = self.random
        first, second = self.word(), self.word()
        local = r.choice([first, f"{first}.{second}", f"{first}.{self.digits(2)}", f"{first}_{self.digits(3)}"])
        host = [self.word() + r.choice(["", self.digits(1)]), r.choice(["com", "org", "net", "de", "io"])]
        if r.random() < 0.4:
            host.insert(1, self.word())
        plain, marked = ("@", "."), [(" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)")]
        at, dot = r.choice([plain, plain, plain, (" at ", " dot "), *marked])
        return local + at + dot.join(host)

    def ip(self) -> str:
        return ".".join(str(self.random.randint(0, MOST_IP)) for _ in range(4))

    def card(self) -> str:
        return self.parted([4, 4, 4, 4], self.random.choice(["", "", "", "", " ", "-", "."]))

    def phone(self) -> str:
        r, mark = self.random, self.random.choice([" ", "-", "."])
        own = f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}"
        country = f"+{self.digits(r.randint(1, 2))}"
        return r.choice(
            [
                f"{country} {own}",
                f"{country} {own}",
                own,
                self.parted([3, 3, 4], mark),
                f"{country}{mark}{self.parted([3, 3, 4], mark)}",
                f"{country}{self.digits(10)}",
            ]
        )

    def other(self) -> str:
        """Numbers, marks and words that look a little like an item."""
        r = self.random
        return r.choice(
            [
                self.digits(r.randint(1, 7)),
                self.digits(r.randint(8, 12)),
                f"{self.digits(1)}.{self.digits(1)}",
                f"{self.digits(1)}.{self.digits(1)}.{self.digits(2)}",
                f"{r.randint(1900, 2050)}-{r.randint(1, 12):02}-{r.randint(1, 31):02}",
                f"{r.randint(1, 31):02}/{r.randint(1, 12):02}/{r.randint(1900, 2050)}",
                f"{r.randint(1900, 2050)}-{r.randint(1900, 2050)}",
                f"{r.randint(0, 23):02}:{r.randint(0, 59):02}",
                "token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"',
                "".join(r.choice("0123456789ABCDEF") for _ in range(r.choice([8, 16, 32, 40]))),
                f"${self.digits(1)},{self.digits(3)}.{self.digits(2)}",
                f"#{self.digits(r.randint(2, 6))}",
                f"v{self.digits(1)}.{self.digits(2)}",
                f"({self.digits(4)})",
                f"@{self.word()}",
                f"{self.word()} at {self.word()}",
                f"{self.word()} dot {self.word()}. {self.word()}",
                f"+{self.digits(2)} %",
            ]
        )

    def run(self) -> tuple[str, list[tuple[int, int, int]]]:
        """One to three items with a blank or another mark between, and their spans."""
        text, spans = "", []
        for i in range(self.random.choice([1, 1, 2, 2, 3])):
            if i:
                text += self.random.choice([" ", " ", " ", ", ", "; ", " | ", "\n"])
            kind = self.random.choice([0, 1, 2, 2, 3, 3, None, None])
            item = self.other() if kind is None else (self.email, self.ip, self.card, self.phone)[kind]()
            if kind is not None:
                spans.append((len(text), len(text) + len(item), kind))
            text += item
        return text, spans


_UNSURE = re.compile(r"\S*[0-9@]\S*")


def labelled_context(context: str, maker: Maker) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with known spans: the context with its base matches, and items put into it.

    What else has digits or at signs in a context is cut out, as nobody has labelled it.
    """
    base = sorted((s, e, k) for k, s, e in base_spans(context))
    text, spans, done, parts = "", [], 0, []
    for m in _UNSURE.finditer(context):
        if not any(s < m.end() and m.start() < e for s, e, _ in base):
            parts.append((m.start(), m.end(), None))
    for s, e, kind in sorted(parts + base, key=lambda p: p[:2]):
        if s < done:
            continue  # within another
        text += context[done:s]
        if kind is not None:
            spans.append((len(text), len(text) + e - s, kind))
            text += context[s:e]
        done = e
    text += context[done:]
    # Items go where a blank is, outside of spans.
    gaps = [m.start() for m in re.finditer(" ", text) if not any(s <= m.start() < e for s, e, _ in spans)]
    for at in sorted(maker.random.sample(gaps, min(len(gaps), maker.random.choice([0, 1, 1, 2]))), reverse=True):
        item, own = maker.run()
        end = maker.random.choice(["", "", "", ".", ",", "!!", "***", "$$$", ")"])
        put = f" {item}{end}"
        spans = [(s + len(put) * (s >= at), e + len(put) * (s >= at), k) for s, e, k in spans]
        spans += [(at + 1 + s, at + 1 + e, k) for s, e, k in own]
        text = text[:at] + put + text[at:]
    if maker.random.random() < 0.1 and len(text.upper()) == len(text):
        text = text.upper()
    return text, sorted(spans)


def training_set(contexts: list[str], seed: int = 1, made: int = MADE):
    """``made`` texts and their spans; of items alone where there is no context."""
    maker = Maker(seed)
    pairs = [labelled_context(contexts[i % len(contexts)], maker) if contexts else maker.run() for i in range(made)]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def contexts_of(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[str]:
    """Stretches of at most :data:`CONTEXT` characters of ``sample`` texts, one of each.

    Texts are chosen by a hash of their own, equal ones once; the hash also places the
    stretch. Only this bounds what is trained on; all texts are then read whole.
    """
    t = text_of(text)
    rows = docs.select(t.alias("t"), F.xxhash64(t, F.lit("context")).alias("h")).filter(F.length("t") > 0)
    place = F.pmod(F.col("h"), F.greatest(F.length("t") - CONTEXT, F.lit(1)).cast("long")).cast("int") + 1
    some = rows.select("h", F.substring("t", place, F.lit(CONTEXT)).alias("c")).distinct()
    return [r["c"] for r in some.orderBy("h", "c").limit(sample).collect()]


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, seed: int = 1) -> Tagger:
    """A tagger trained on contexts of at most ``sample`` texts; without any, on items alone."""
    texts, spans = training_set(contexts_of(docs, text, sample), seed)
    return char_tagger.train(texts, spans, len(KINDS))


def spans_in(text: Column, model: Tagger) -> Column:
    """The spans of each text, an array of :data:`SPANS` by kind and place."""

    def of(texts: pd.Series) -> pd.Series:
        rows = all_spans(model, texts.tolist())
        return pd.Series([[(KINDS[k], s, e, b) for k, s, e, b in row] for row in rows])

    return F.pandas_udf(of, SPANS)(text)


def found(docs: DataFrame, model: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)`` of every row: kind, start, end in code points, and whether it is base.

    A null or empty text has no spans. Spans of one kind do not overlap, nor do added ones
    overlap any. Repeated rows are returned as often as they come, an empty table gives an
    empty result, and columns other than key and text play no part.
    """
    return docs.select(F.col(key).alias("_k"), spans_in(text_of(text), model).alias("_s")).select(
        F.col("_k").alias(key), F.col("_s").alias("spans")
    )


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document, a digest of the base spans, and all spans."""
    docs = documents(spark, folder)
    rows = found(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told("spans").alias("spans"),
    )


QUERIES = {"op12_personal_data": op12_personal_data}
SQL: dict[str, str] = {}
