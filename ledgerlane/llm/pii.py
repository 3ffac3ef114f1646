"""Personal data: exact patterns, and a semi-Markov conditional random field for spans the patterns miss.

The base scan finds e-mail addresses, IP addresses, card and phone numbers by fixed rules in linear time. Around marks that
they leave (digits, written-out at signs) the field scores whole candidate segments: features look at a segment as one
piece, its shape, digit count, check digit, separators and neighbours. Dynamic programming over segments of bounded length
chooses boundaries and kinds together. Its weights are learned from spans the base scan finds in a bounded sample of
documents, rewritten in ways that hide them from the patterns, next to look-alikes that are no personal data.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerlane.llm.common import text_or_empty
from ledgerlane.llm.labelled import hashed_sample

# The kinds in their order, and the patterns of the base scan.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, str]

#: Documents whose base spans the field is learned from, at most.
LEARNED_DOCUMENTS = 400
#: Longest candidate segment, in characters; marks up to twice as far apart share a region.
LONGEST = 64
#: Characters past a region that a match begun inside it may take; no pattern of `WIDE` takes as many.
BEYOND = 160


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each at sign back over the letters a name may have, but not into the address before."""
    found, end = [], 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            found.append((start, end, "email"))
    return found


def numbers(text: str) -> list[Span]:
    """IP addresses and cards from the runs of digits, each looked at a fixed number of times."""
    runs = [m.span() for m in DIGITS.finditer(text)]
    found, n = [], len(runs)
    dotted = [i + 1 < n and runs[i + 1][0] == runs[i][1] + 1 and text[runs[i][1]] == "." for i in range(n)]
    i = 0
    while i + 3 < n:
        if dotted[i] and dotted[i + 1] and dotted[i + 2]:
            parts = [text[a:b] for a, b in runs[i : i + 4]]
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
                found.append((runs[i][0], runs[i + 3][1], "ip"))
            i += 4
        else:
            i += 1
    i = 0
    while i < n:
        j, size = i, runs[i][1] - runs[i][0]
        while j + 1 < n and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            size += runs[j][1] - runs[j][0]
        if 14 <= size <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            found.append((runs[i][0], runs[j][1], "card"))
        i = j + 1
    return found


def phones(text: str) -> list[Span]:
    found = []
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, in code points, by start and then kind. Kinds may overlap each other."""
    found = emails(text) if "@" in text else []
    if DIGITS.search(text):
        found += numbers(text)
        if "+" in text:
            found += phones(text)
    return in_order(found)


# Candidate segments of each kind: wider than the base rules, still anchored at digits or a written-out at sign.
AT = r"(?:@|\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\sat\s)"
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s|\s\.\s)"
WIDE = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]{{1,32}}{AT}[A-Za-z0-9-]{{1,24}}(?:{DOT}[A-Za-z0-9-]{{1,16}}){{1,3}}"),
    "ip": re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]{0,3}[0-9]{2,7}){2,5}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z])"),
}
#: Where the field may have something to say: every match of `WIDE` holds one.
MARK = re.compile(rf"[0-9]{{3}}|[0-9][.\s()\[{{/-]|@|[\[({{]\s?at\s?[\])}}]|\sat(?=\s[A-Za-z0-9-]{{1,24}}{DOT}[A-Za-z0-9-])")
WORD_BEFORE = re.compile(r"(\w+)\W*$")
CUES = {
    "email": {"email", "mail", "contact", "write"}, "ip": {"ip", "host", "address", "server"},
    "card": {"card", "visa", "account", "pay"}, "phone": {"tel", "phone", "call", "mobile", "fax"},
}


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """What a candidate segment looks like as a whole."""
    piece = text[start:end]
    digits = "".join(c for c in piece if "0" <= c <= "9")
    out = ["bias", f"digits{min(len(digits), 20)}"]
    separators = sorted({c for c in piece if not c.isalnum()})
    out.append("separators" + "".join(separators)[:6])
    out.append("groups" + "-".join(str(len(g)) for g in DIGITS.findall(piece))[:16])
    if kind == "card":
        out.append("luhn" if luhn(digits) else "no luhn")
    if kind == "ip":
        groups = DIGITS.findall(piece)
        out.append("bytes" if len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups) else "no bytes")
    if kind == "phone":
        out += ["plus" if piece[0] == "+" else "no plus", "brackets" if "(" in piece else "no brackets"]
        out.append("plain" if piece.isdigit() else "set apart")
    if kind == "email":
        out.append("at" if "@" in piece else "spelled at")
        out.append("dot" if "." in piece.rpartition("@")[2] else "spelled dot")
        out.append("marked" if re.search(r"[\[({@]", piece) else "bare")
    before = WORD_BEFORE.search(text[max(0, start - 24) : start])
    out.append("cue" if before and before[1].lower() in CUES[kind] else "no cue")
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        out.append("inside a word")
    return [f"{kind}:{f}" for f in out]


@dataclass
class Field:
    weights: dict[str, float]

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(n, 0.0) for n in names)

    def best(self, candidates: list[Span], scores: list[float]) -> list[Span]:
        """The candidates that together score highest without overlap; characters outside cost nothing."""
        order = sorted(range(len(candidates)), key=lambda i: (candidates[i][1], candidates[i][0]))
        ends = [candidates[i][1] for i in order]
        total, taken = [0.0] * (len(order) + 1), [None] * (len(order) + 1)
        for k, i in enumerate(order, 1):
            before = min(bisect_right(ends, candidates[i][0]), k - 1)
            with_it = total[before] + scores[i]
            if with_it > total[k - 1]:
                total[k], taken[k] = with_it, before
            else:
                total[k] = total[k - 1]
        chosen, k = [], len(order)
        while k:
            if taken[k] is None:
                k -= 1
            else:
                chosen.append(candidates[order[k - 1]])
                k = taken[k]
        return chosen[::-1]

    def found(self, text: str, held: list[Span]) -> list[Span]:
        """The spans the field adds to those already held; they never overlap them."""
        added, held = [], merged(held)
        for start, end in regions(text, held):
            options = candidates(text, start, end, held)
            if options:
                added += self.best(options, [self.score(features(text, *o)) for o in options])
        return added


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, in order; they neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def regions(text: str, held: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches around marks outside the held ones; no two overlap, so no candidate lies in two."""
    start = end = None
    k = 0
    for m in MARK.finditer(text):
        while k < len(held) and held[k][1] <= m.start():
            k += 1
        if k < len(held) and held[k][0] < m.end():
            continue
        if end is not None and m.start() - end <= 2 * LONGEST:
            end = m.end()
            continue
        if end is not None:
            yield max(0, start - LONGEST), min(len(text), end + LONGEST)
        start, end = m.span()
    if end is not None:
        yield max(0, start - LONGEST), min(len(text), end + LONGEST)


def candidates(text: str, start: int, end: int, held: list[tuple[int, int]]) -> list[Span]:
    """Segments of every kind that begin in a region, with shorter ones that stop at an earlier group of digits."""
    out = set()
    ends = [b for _, b in held]
    for kind, pattern in WIDE.items():
        # matches may run past the region, so none is cut by its end
        for m in pattern.finditer(text, start, min(len(text), end + BEYOND)):
            if m.start() >= end:
                break
            options = [m.span()]
            if kind in ("card", "phone"):
                groups = [g.span() for g in DIGITS.finditer(text, *m.span())]
                options += [(m.start(), g[1]) for g in groups[1:-1]] + [(g[0], m.end()) for g in groups[1:-1]]
            for a, b in options:
                k = bisect_right(ends, a)
                if b - a <= LONGEST and (k == len(held) or b <= held[k][0]):
                    out.add((a, b, kind))
    return sorted(out)


def log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def learn(examples: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Stochastic gradient ascent on the likelihood of the right segmentation of each region.

    Forward and backward sums run over the candidate segments of a region in order of their ends.
    """
    lattices = []
    for text, gold in examples:
        for start, end in regions(text, []):
            options = sorted(candidates(text, start, end, []), key=lambda c: (c[1], c[0]))
            if options:
                lattices.append((options, [features(text, *o) for o in options], [o in gold for o in options]))
    field = Field({})
    weights = field.weights
    dice = random.Random(5)
    for epoch in range(epochs):
        dice.shuffle(lattices)
        step = rate / (1 + epoch / 3)
        for options, names, right in lattices:
            scores = [field.score(n) for n in names]
            ends = [o[1] for o in options]
            before = [min(int(np.searchsorted(ends, o[0], side="right")), k) for k, o in enumerate(options)]
            forward = [0.0]
            for k, s in enumerate(scores):
                forward.append(log_sum(forward[k], forward[before[k]] + s))
            reach = [-math.inf] * (len(options) + 1)
            reach[-1] = 0.0
            for k in range(len(options) - 1, -1, -1):
                reach[k] = log_sum(reach[k], reach[k + 1])
                reach[before[k]] = log_sum(reach[before[k]], reach[k + 1] + scores[k])
            for k, s in enumerate(scores):
                share = math.exp(min(0.0, forward[before[k]] + s + reach[k + 1] - forward[-1]))
                slope = float(right[k]) - share
                if abs(slope) > 1e-4:
                    for n in names[k]:
                        weights[n] = weights.get(n, 0.0) * (1 - step * ridge) + step * slope
    return field


def disguised(text: str, span: Span, dice: random.Random) -> tuple[str, list[Span]]:
    """A short text around a base span, the span rewritten so that the patterns miss it, or made into a look-alike."""
    start, end, kind = span
    piece = text[start:end]
    left, right = text[max(0, start - 30) : start].rsplit("\n")[-1], text[end : end + 30].split("\n")[0]
    left, right = re.sub(r"[0-9@+]", "", left) + " ", " " + re.sub(r"[0-9@+]", "", right)
    digits = "".join(c for c in piece if "0" <= c <= "9")
    real = dice.random() < 0.6
    if kind == "email":
        name, _, host = piece.partition("@")
        if real:
            dot = dice.choice([".", " dot ", " [dot] ", "(dot)"])
            new = name + dice.choice([" (at) ", " [at] ", "(at)", "[at]", " at "]) + host.replace(".", dot)
        else:
            new = name.replace(".", " ") + " at " + host.replace(".", " ")
    elif kind == "ip":
        if real:
            new = piece.replace(".", dice.choice(["[.]", "(.)", " . ", " dot ", "[dot]"]))
        else:
            new = ".".join(str(dice.randrange(256, 1000)) for _ in range(4))
    elif kind == "card":
        if real:
            new = dice.choice([".", "  ", " - ", "/"]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
        else:
            last = str((int(digits[-1]) + dice.randrange(1, 10)) % 10)
            cut = digits[:-1] + last
            new = dice.choice(["", " ", ".", "-"]).join(cut[k : k + 4] for k in range(0, len(cut), 4))
    else:
        tail = digits[-10:]
        if real:
            new = dice.choice(["({}) {}-{}", "({}) {} {}", "00" + digits[:-10] + " ({}) {}-{}"]).format(tail[:3], tail[3:6], tail[6:])
        else:
            new = dice.choice([tail, digits, tail[:4] + " " + tail[4:8], tail[:6]])
    made = left + new + right
    return made, [(len(left), len(left) + len(new), kind)] if real else []


#: Look-alikes that no document needs to supply.
HARMLESS = [
    "Version 2.0 of 2019-11-05, see section 3.1.4.1 and page 1024.", "CC BY-NC 4.0 and 1 000 000 more.",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" here", "from 1998 to 2004, at 10.30 or 12.45",
    "meet at home dot", "order 20231105 12345678 shipped", "we looked at that dot in it", "pi is 3.14159265358979",
]


def fit(texts: list[str]) -> Field:
    """Learn the field from the base spans of some texts. Without any it learns from the look-alikes alone."""
    dice = random.Random(11)
    examples: list[tuple[str, list[Span]]] = [(t, []) for t in HARMLESS] * 4
    for text in texts:
        for span in base_spans(text)[:8]:
            examples += [disguised(text, span, dice) for _ in range(3)]
    return learn(examples)


def learned(docs: DataFrame, bound: int = LEARNED_DOCUMENTS) -> Field:
    """A field from at most `bound` documents that hold a digit run or an at sign, those first by a hash of the text."""
    likely = docs.where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9]{14}|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))
    return fit(sorted(r["text"] for r in hashed_sample(likely, bound).collect()))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def spans(docs: DataFrame, field: Field | None = None, text: str = "text") -> Column:
    """A column of structs: counts of base spans per kind, base spans and all spans as text, and the redacted text.

    A null text counts as empty. In the redacted text every span is replaced by its kind in brackets; spans that overlap
    are replaced as one, named after the first.
    """
    field = field or learned(docs)

    @pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted"]
        for batch in batches:
            rows = []
            for value in batch:
                base = base_spans(value)
                every = in_order(base + field.found(value, base))
                counts = [sum(s[2] == kind for s in base) for kind in KINDS]
                rows.append((*counts, written_spans(base), written_spans(every), redact(value, every)))
            yield pd.DataFrame(rows, columns=names)

    return run(text_or_empty(text))


def redact(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def digests(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The counts are those of the base spans, spans holds them and what the field adds. Texts without personal data give
    the digest of an empty text. Repeated rows are read each; nothing is shuffled.
    """
    field = field or learned(docs)
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    @pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        for batch in batches:
            out = []
            for value in batch:
                base = base_spans(value)
                every = in_order(base + field.found(value, base))
                digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
                out.append((*[sum(s[2] == kind for s in base) for kind in KINDS], digest, written_spans(every)))
            yield pd.DataFrame(out, columns=names)

    return rows.select("doc_id", run("text").alias("found")).select("doc_id", F.col("found.*"))
