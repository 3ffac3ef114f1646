"""Byte-pair encoding and decoding with a public vocabulary: speculate, verify, repair.

Greedy longest matches propose the tokens of a word. Every pair of neighbouring tokens is then tested at once with numpy:
a pair stands if no merge across its border would have come first. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerlane.llm.common import text_or_empty

# Fixed values of the vocabulary's own file format: its pre-tokenizer pattern and word end.
WORD_END = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PATTERN = r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9]+"

#: What an encoder remembers at most between batches: words, chunks between white space, and the letters of either.
CACHED_WORDS = 100_000
CACHED_CHUNKS = 200_000
CACHED_LETTERS = 16_000_000
#: Letters of text that are encoded together, at least one text.
TOGETHER = 2_000_000
#: Where no decoded text is held, so many times the words, chunks and letters together.
UNSPELLED = 4
#: Bytes of a word above which it is merged with a heap, by itself.
LONG_WORD = 64
CLOSE = "\x00"
SEPARATORS = ["\x1c", "\x1d", "\x1e", "\x1f"]
#: Ends a chunk where many are cut into words at once; no word holds white space.
BREAK = "\n"
NEVER = np.int64(1) << 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stays, the rest follow from code point 256."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, following = [""] * 256, 256
    for b in range(256):
        if b in kept:
            letters[b] = chr(b)
        else:
            letters[b] = chr(following)
            following += 1
    return letters


class Vocabulary:
    """Tables of one vocabulary file: tokens, merges, and which tokens merging can reach."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.ids.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.spaced = [t + " " for t in self.tokens]
        self.letters = byte_letters()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        # the merge that makes a token: its rank (-1 for letters), left and right part
        self.born = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            if (x, y) not in self.rank:
                self.rank[(x, y)] = (r, made)
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = r, x, y
        keys = np.array([(x << 20) | y for x, y in self.rank], np.int64)
        # a table by hash: a pair lies in the first slot from its own that holds it or nothing
        self.slot_bits = max(4, 2 + len(keys).bit_length())
        self.keys = np.full(1 << self.slot_bits, -1, np.int64)
        self.ranks = np.full(1 << self.slot_bits, NEVER)
        self.made = np.full(1 << self.slot_bits, -1, np.int64)
        waiting = np.arange(len(keys))
        while len(waiting):
            at = self.slot(keys[waiting])
            self.keys[at] = keys[waiting]
            waiting = waiting[self.keys[at] != keys[waiting]]
        at = self.slot(keys)
        self.ranks[at] = [r for r, _ in self.rank.values()]
        self.made[at] = [m for _, m in self.rank.values()]
        self.single = np.array([self.ids[c] for c in self.letters])
        self.single_end = np.array([self.ids[c + WORD_END] for c in self.letters])
        self.reachable = self.reach()
        self.greedy = {t: i for t, i in self.ids.items() if self.reachable[i]}
        # proposals come from one pass of leftmost longest matches; byte 255 is in no text and closes a word
        table = {b: letter for b, letter in enumerate(self.letters)}
        table[255] = CLOSE
        self.table = table
        self.matcher = ahocorasick.Automaton()
        for token, i in self.greedy.items():
            self.matcher.add_word(token.replace(WORD_END, CLOSE), i)
        self.matcher.make_automaton()
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def slot(self, key: np.ndarray) -> np.ndarray:
        """The slot that holds each pair, or an empty one."""
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        held = self.keys[at]
        taken = np.flatnonzero((held != key) & (held >= 0))
        while len(taken):
            at[taken] = (at[taken] + 1) & ((1 << self.slot_bits) - 1)
            held = self.keys[at[taken]]
            taken = taken[(held != key[taken]) & (held >= 0)]
        return at

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x.astype(np.int64) << 20) | y
        return self.ranks[self.slot(key.ravel())].reshape(key.shape)

    def stand(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b stay apart side by side while merges of a rank under `before` run.

        Walks back in time: the two pieces at the border are split, the younger first, and a merge of both that comes
        before either is used inside its own token breaks the pair. Equal ranks go to the merge further left.
        """
        x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok = np.ones(len(x), bool)
        until_x = np.full(len(x), NEVER - 1) if before is None else before.astype(np.int64).copy()
        until_y = until_x.copy()
        live = np.arange(len(x))
        while len(live):
            p, q = x[live], y[live]
            r = self.rank_of(p, q)
            broken = (r < until_x[live]) & (r <= until_y[live]) if before is None else (r < until_x[live]) & (
                (r < until_y[live]) | ((r == until_y[live]) & (until_y[live] != before[live]))
            )
            ok[live[broken]] = False
            older, newer = self.born[p], self.born[q]
            on = ~broken & ((older >= 0) | (newer >= 0))
            live, p, q, older, newer = live[on], p[on], q[on], older[on], newer[on]
            first = older > newer
            x[live[first]], until_x[live[first]] = self.right[p[first]], older[first]
            y[live[~first]], until_y[live[~first]] = self.left[q[~first]], newer[~first]
        return ok

    def reach(self) -> np.ndarray:
        made = np.flatnonzero(self.born >= 0)
        ok = np.ones(len(self.born), bool)
        ok[made] = self.stand(self.left[made], self.right[made], self.born[made])
        for i in made[np.argsort(self.born[made])]:
            ok[i] &= ok[self.left[i]] and ok[self.right[i]]
        return ok

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens, the end of each word's tokens, words not covered to their end."""
        joined = b"\xff".join([w.encode("utf-8") for w in words]) + b"\xff"
        letters = joined.decode("latin-1").translate(self.table)
        found = np.fromiter(chain.from_iterable(self.matcher.iter_long(letters)), np.int64).reshape(-1, 2)
        closes = np.flatnonzero(np.frombuffer(joined, np.uint8) == 255)
        ends = np.searchsorted(found[:, 0], closes, side="right")
        last = found[np.maximum(ends - 1, 0), 0] if len(found) else np.full(len(closes), -1)
        return found[:, 1], ends, np.flatnonzero(last != closes)

    def merged(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals, with a heap over linked neighbours."""
        units = [self.letters[b] for b in word.encode("utf-8")]
        units[-1] += WORD_END
        tokens = [self.ids[u] for u in units]
        n = len(tokens)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (merge := self.rank.get((tokens[i], tokens[j]))):
                heapq.heappush(heap, (merge[0], i, tokens[i], tokens[j], merge[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, p, q, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != p or j >= n or tokens[j] != q:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            if ahead[i] >= 0:
                offer(ahead[i])
            offer(i)
        return [t for t in tokens if t >= 0]

    def merged_together(self, letters: np.ndarray) -> np.ndarray:
        """Exact merging of words of one length, a row of letter tokens each; each step does one merge of every word.

        Returns the rows with -1 behind their last token.
        """
        out = np.full(letters.shape, -1, np.int64)
        rows, now = np.arange(len(letters)), letters.astype(np.int64)
        rank = self.rank_of(now[:, :-1], now[:, 1:])
        while len(rows):
            width = now.shape[1]
            at = rank.argmin(1) if width > 1 else np.zeros(len(rows), int)
            done = rank[np.arange(len(rows)), at] == NEVER if width > 1 else np.ones(len(rows), bool)
            out[rows[done], :width] = now[done]
            rows, now, rank, at = rows[~done], now[~done], rank[~done], at[~done]
            if not len(rows):
                break
            line = np.arange(len(rows))
            key = (now[line, at] << 20) | now[line, at + 1]
            now[line, at] = self.made[self.slot(key)]
            step = np.arange(width - 1)
            now = np.take_along_axis(now, step + (step > at[:, None]), 1)
            if width > 2:
                step = step[:-1]
                rank = np.take_along_axis(rank, step + (step >= at[:, None]), 1)
                has = np.flatnonzero(at < width - 2)
                rank[has, at[has]] = self.rank_of(now[has, at[has]], now[has, at[has] + 1])
                has = np.flatnonzero(at > 0)
                rank[has, at[has] - 1] = self.rank_of(now[has, at[has] - 1], now[has, at[has]])
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The tokens of each word, packed: proposed, verified at once, repaired where a pair fails."""
        if not words:
            return []
        flat, ends, open_ended = self.propose(words)
        back, pairs = pd.factorize((flat[:-1] << 20) | flat[1:])
        inside = np.ones(max(len(flat) - 1, 0), bool)
        inside[ends[(ends > 0) & (ends < len(flat))] - 1] = False
        fails = np.flatnonzero(inside & ~self.stand(pairs >> 20, pairs & ((1 << 20) - 1))[back])
        packed, stops = flat.astype("<u4").tobytes(), (ends * 4).tolist()
        found = [packed[a:b] for a, b in zip([0, *stops], stops)]
        groups: dict[int, list[int]] = {}
        for i in np.union1d(np.searchsorted(ends, fails, side="right"), open_ended).tolist():
            size = len(words[i].encode("utf-8"))
            if size > LONG_WORD:
                found[i] = np.array(self.merged(words[i]), "<u4").tobytes()
            else:
                groups.setdefault(size, []).append(i)
        for size, group in groups.items():
            letters = np.frombuffer(b"".join([words[i].encode("utf-8") for i in group]), np.uint8).reshape(-1, size)
            tokens = self.single[letters]
            tokens[:, -1] = self.single_end[letters[:, -1]]
            rows = self.merged_together(tokens)
            packed, stops = rows[rows >= 0].astype("<u4").tobytes(), (np.cumsum((rows >= 0).sum(1)) * 4).tolist()
            for i, a, b in zip(group, [0, *stops], stops):
                found[i] = packed[a:b]
        return found


def code_points(step: int = 0x800) -> Iterator[range]:
    """All code points but surrogates, in blocks: a list of all letters at once costs a worker hundreds of megabytes."""
    for first in range(0, 0x110000, step):
        if not 0xD800 <= first < 0xE000:
            yield range(first, first + step)


def symbols_of_later_versions(path: str) -> str:
    """Letters and digits to the pattern engine that the library's older Unicode tables take for symbols."""
    from tokenizers import Tokenizer

    known = (c for block in code_points() for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, block))))
    doubtful = [c for c in known if unicodedata.category(c)[0] not in "LN"]
    pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(" ".join(f"!{c}" for c in doubtful))
    # a symbol joins the mark before it into one piece
    joined = {start for _, (start, end) in pieces if end - start == 2}
    return "".join(c for k, c in enumerate(doubtful) if 3 * k in joined)


def lower_case_of_later_versions(path: str) -> dict[int, str]:
    """Lower case of the letters that the library knows and this Python's Unicode tables do not.

    Letters that both know are lower-cased alike: case mappings of assigned letters never change.
    """
    from tokenizers import Tokenizer

    normalizer = Tokenizer.from_file(path).normalizer
    found: dict[int, str] = {}
    for block in code_points():
        points = [c for c in block if unicodedata.category(chr(c)) == "Cn"]
        made = normalizer.normalize_str("\n".join(map(chr, points))).split(" ")
        found |= {c: lower for c, lower in zip(points, made) if chr(c) != lower}
    return found


class Memory:
    """Texts met before, numbered, and their tokens in one array; what was met again outlasts what was met once.

    The first texts, `fixed`, always stay.
    """

    def __init__(self, fixed: dict[str, list[int]]):
        self.fixed = len(fixed)
        self.numbers = {text: k for k, text in enumerate(fixed)}
        self.letters = 0
        self.pool = np.array(sum(fixed.values(), []), "<u4")
        self.sizes = np.array([len(tokens) for tokens in fixed.values()], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.again = np.ones(self.fixed, bool)
        # what each text decodes to, if it is told; there are no fixed texts then
        self.spelled: list[str] = []

    def find(self, texts: list[str]) -> np.ndarray:
        """The number of each text, -1 for those not met before."""
        found = np.fromiter(map(self.numbers.get, texts, repeat(-1)), np.int64, len(texts))
        self.again[found[found >= 0]] = True
        return found

    def add(self, texts: list[str], tokens: np.ndarray, sizes: np.ndarray, spelled: Iterable[str] = ()) -> np.ndarray:
        """The numbers that these new texts get."""
        made = np.arange(len(self.sizes), len(self.sizes) + len(texts))
        self.numbers.update(zip(texts, made.tolist()))
        self.letters += sum(map(len, texts))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, tokens.astype("<u4", copy=False)])
        self.again = np.concatenate([self.again, np.zeros(len(texts), bool)])
        self.spelled.extend(spelled)
        return made

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        """The tokens of these texts one after another."""
        return stretches(self.pool, self.starts[numbers], self.sizes[numbers])

    def trim(self, most: int, most_letters: int) -> None:
        """Beyond either bound, forget what was met once since the last time; all if that leaves over half of a bound."""
        if len(self.sizes) <= most and self.letters <= most_letters:
            return
        texts, kept = list(self.numbers), np.flatnonzero(self.again)
        letters = sum(len(texts[k]) for k in kept[self.fixed :].tolist())
        if 2 * len(kept) > most or 2 * letters > most_letters:
            kept, letters = kept[: self.fixed], 0
        self.pool = self.tokens(kept)
        self.sizes = self.sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.numbers = {texts[k]: n for n, k in enumerate(kept.tolist())}
        self.letters = letters
        self.spelled = [self.spelled[k] for k in kept.tolist()] if self.spelled else []
        self.again = np.arange(len(kept)) < self.fixed


class Encoder:
    """Encodes a batch of texts at once: each different chunk between white space is cut into words once.

    No word and no composed letter goes over white space. Words and chunks are remembered between batches with their
    tokens, bounded by number and letters.
    """

    def __init__(self, path: str | None = None, spell: bool = True):
        path = path or default_vocabulary()
        self.spell, self.room = spell, 1 if spell else UNSPELLED
        self.vocabulary = Vocabulary(path)
        self.ascii = re.compile(f"{ASCII_PATTERN}|{BREAK}", re.ASCII)
        pattern = f"{PATTERN}|{BREAK}"
        self.general = regex.compile(pattern)
        self.later = frozenset(symbols_of_later_versions(path))
        self.later_lower = lower_case_of_later_versions(path)
        self.unknown = frozenset(map(chr, self.later_lower))
        self.newer = self.later | self.unknown
        newer = "[" + "".join(map(regex.escape, sorted(self.later))) + "]" if self.later else "(?!)"
        self.rare = regex.compile(
            pattern.replace(r"[\p{L}]", rf"(?:(?!{newer})\p{{L}})")
            .replace(r"[\p{N}]", rf"(?!{newer})\p{{N}}")
            .replace(r"[^\s\p{L}\p{N}]", rf"(?:{newer}|[^\s\p{{L}}\p{{N}}])")
        )
        # number 0 is the break, which has no tokens; a special token's text is a word of its own only if the text held it
        self.known = Memory({BREAK: []} | {special: [i] for special, i in self.vocabulary.specials.items()})
        self.chunks = Memory({})

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own, before anything is normalised."""
        split = self.vocabulary.split
        parts = split.split(text) if split and "<|" in text else [text]
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.plain(part)) if w != BREAK]

    def plain(self, text: str) -> list[str]:
        """The words of a text without special tokens, and its line breaks."""
        if text.isascii():
            return self.ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # letter by letter, the final sigma has no form of its own
        lowered = text.replace("Σ", "σ").lower()
        if not self.unknown.isdisjoint(lowered):
            lowered = lowered.translate(self.later_lower)
        return (self.general if self.later.isdisjoint(lowered) else self.rare).findall(lowered)

    def numbered(self, words: list[str]) -> np.ndarray:
        """The numbers of these words; new ones are encoded and get the next numbers."""
        found = self.known.find(words)
        new = np.flatnonzero(found < 0).tolist()
        if new:
            missing = [words[k] for k in new]
            fresh = list(dict.fromkeys(missing))
            packed = self.vocabulary.encode_words(fresh)
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            self.known.add(fresh, np.frombuffer(b"".join(packed), "<u4"), sizes)
            found[new] = np.fromiter(map(self.known.numbers.__getitem__, missing), np.int64, len(missing))
        return found

    def cut(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all chunks one after another, number of tokens of each)."""
        numbers = self.numbered(self.plain(BREAK.join([*chunks, ""])))
        stops = np.cumsum(self.known.sizes[numbers])[numbers == 0]
        return self.known.tokens(numbers), np.diff(stops, prepend=0)

    def together(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Encode texts without special tokens, each chunk that is not remembered once."""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = self.chunks.find(chunks)
        # the slower patterns see only the chunks that need them
        groups: list[list[int]] = [[], [], []]
        for i in np.flatnonzero(place < 0).tolist():
            groups[0 if chunks[i].isascii() else 1 if self.newer.isdisjoint(chunks[i]) else 2].append(i)
        for group in groups:
            if group:
                fresh = [chunks[i] for i in group]
                tokens, size = self.cut(fresh)
                spelled: list[str] = []
                if self.spell:
                    # every token is followed by a space, the last one of a text loses it
                    spaced = list(map(self.vocabulary.spaced.__getitem__, tokens.tolist()))
                    stops = np.cumsum(size)
                    spelled = ["".join(spaced[a:b]) for a, b in zip((stops - size).tolist(), stops.tolist())]
                place[group] = self.chunks.add(fresh, tokens, size, spelled)
        used = place[coded.indices.to_numpy()]
        ids = self.chunks.tokens(used)
        packed = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
        offsets = split.offsets.to_numpy()
        ends = np.append(0, np.cumsum(self.chunks.sizes[used]))[offsets].tolist()
        known = self.chunks.spelled
        for k in range(len(texts)):
            decoded = ""
            if self.spell:
                decoded = "".join(map(known.__getitem__, used[offsets[k] : offsets[k + 1]].tolist()))[:-1]
            yield bytes(packed[4 * ends[k] : 4 * ends[k + 1]]), decoded

    def alone(self, text: str) -> tuple[bytes, str]:
        """Encode one text word by word."""
        ids = self.known.tokens(self.numbered(self.words(text)))
        return ids.tobytes(), decode_ids(self.vocabulary, ids) if self.spell else ""

    def ready(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        self.known.trim(CACHED_WORDS * self.room, CACHED_LETTERS)
        self.chunks.trim(CACHED_CHUNKS * self.room, CACHED_LETTERS)
        # four control characters part chunks for Arrow but not for the vocabulary
        special = ["<|" in text or any(s in text for s in SEPARATORS) for text in texts]
        rest = self.together([text for text, own in zip(texts, special) if not own])
        for text, own in zip(texts, special):
            yield self.alone(text) if own else next(rest)

    def encoded(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """Of each text, its ids as little-endian unsigned 32-bit integers and, if spelled, what they decode to.

        This vocabulary has no decoder: tokens are joined by spaces.
        """
        waiting: list[str] = []
        letters, most = 0, TOGETHER * self.room
        for text in texts:
            waiting.append(text)
            letters += len(text)
            if letters >= most:
                yield from self.ready(waiting)
                waiting, letters = [], 0
        yield from self.ready(waiting)


def stretches(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `values` with these starts and sizes, one after another."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return values[at]


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    return " ".join(vocabulary.tokens[i] for i in ids)


_ENCODERS: dict[tuple[str | None, bool], Encoder] = {}


def encoder(path: str | None = None, spell: bool = True) -> Encoder:
    """One encoder per worker process, vocabulary and use."""
    if (path, spell) not in _ENCODERS:
        _ENCODERS[path, spell] = Encoder(path, spell)
    return _ENCODERS[path, spell]


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Adds `bpe` = (ids binary, decoded string) to every row; other columns stay, an earlier `bpe` is replaced.

    ids are little-endian unsigned 32-bit integers, decoded is the text the ids decode to. A null text counts as empty
    and gives no ids. Repeated rows are encoded each. No shuffle; a text of any length is one row.
    """

    @pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = encoder(vocabulary)
        for batch in batches:
            yield pd.DataFrame(tool.encoded(batch), columns=["ids", "decoded"])

    return docs.withColumn("bpe", run(text_or_empty(text)))


def decode(rows: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Adds `decoded`: the text of a binary column of ids (null stays null)."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(vocabulary).vocabulary
        for batch in batches:
            yield batch.map(lambda b: None if b is None else decode_ids(tool, np.frombuffer(b, "<u4")))

    return rows.withColumn("decoded", run(ids))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ids and texts are digested where they arise."""

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = encoder(vocabulary)
        for batch in batches:
            rows = [
                (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                for ids, decoded in tool.encoded(batch)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run(text_or_empty()).alias("bpe")).select("doc_id", F.col("bpe.*"))
