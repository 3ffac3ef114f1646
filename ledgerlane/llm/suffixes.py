"""Removal of repeated 100-byte strings with difference-cover suffix sorting, dealt out by content.

A string of `LENGTH` bytes has one leading k-gram, the smallest by hash among those inside it. Consecutive starts with the
same leading k-gram form a piece (about 28 starts). Equal strings have equal leading k-grams, so only pieces that share one
need to be compared, and of pieces with equal content all but the first repeat it. What is left, pieces that share a k-gram
but differ, goes to the suffix sort: starts in two of three places are sorted by triples of characters, the triples are
named and the sort recurses on the names, the other starts are merged in by one character and the next rank; then each
suffix is compared with its neighbour over the prefix of `LENGTH` bytes.

Whole texts travel as compressed pages of about a megabyte. Pages and buckets exchange packed arrays, a row per page and
bucket; repeats inside a page are settled there, of whole pieces and of strings that are dealt out one by one, so a string
in every document comes to its bucket once per page at most. A k-gram with more than `LOCAL` different pieces in one page,
as of a passage that many documents share between texts of their own, is sent as one mark for the page, and all its strings
are dealt out one by one wherever it occurs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import text_or_empty, written

LENGTH = 100
GRAM = 40
WINDOW = LENGTH - GRAM + 1
#: Bytes after which a page is closed; the last document goes in whole.
PAGE = 1 << 20
#: Buckets per shuffle partition.
BUCKETS = 2
#: Pages behind a bucket, so that a bucket does not grow with the input.
BUCKET_PAGES = 64
#: Different pieces of one k-gram in one page above which the page sends a mark instead of the pieces.
LOCAL = 32
#: Different pieces of one k-gram above which their strings are dealt out one by one, by their own content.
CROWDED = 4096
#: Bytes of pieces that are sorted together, as long as a k-gram's pieces stay together.
SORTED_BYTES = 200_000
#: Bytes of a character of the suffix sort.
CHARACTER = 8
LEAST_ID = -(1 << 63)

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64(30)


# ---------------------------------------------------------------- suffix sorting


def dense(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, order): dense ranks of rows by these columns, the first column first; equal rows in any order."""
    tops = [int(c.max(initial=0)) + 1 for c in columns]
    if len(columns) > 1 and math.prod(tops) < 1 << 63:
        # one number a row, which sorts much faster than columns do
        whole = columns[0].astype(np.int64)
        for c, top in zip(columns[1:], tops[1:]):
            whole = whole * top + c
        columns = (whole,)
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    for c in columns:
        ordered = c[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    return names, order


def ranks(character: np.ndarray, behind: np.ndarray, place: np.ndarray, step: int, depth: int) -> np.ndarray:
    """Ranks of suffixes that agree with their order over `depth` bytes at least; equal over that depth may differ or not.

    character holds the names of `step` bytes at each suffix, behind the index of the suffix `step` bytes on (the last
    index stands for the end), place its offset in its text. This is the difference cover modulo three: suffixes whose
    place in steps is 1 or 2 modulo 3 are the sample.
    """
    end = len(character) - 1
    if step >= depth:
        return character
    kind = (place // step) % 3
    sample = np.flatnonzero(kind[:end] != 0)
    one, two = behind[sample], behind[behind[sample]]
    names, _ = dense(character[sample], character[one], character[two])
    # the sample as a text of its own: three steps on lies a suffix of the same kind
    where = np.full(len(character), len(sample))
    where[sample] = np.arange(len(sample))
    inner = np.append(names + 1, 0)
    onward = np.append(where[behind[two]], len(sample))
    recursed = ranks(inner, onward, np.append(place[sample], 0), 3 * step, depth)
    held = np.zeros(len(character), np.int64)
    held[sample] = dense(recursed[:-1])[0] + 1
    if 3 * step >= depth:
        held[sample] = names + 1
    # merge: the others come by one character and the rank behind it
    rest = np.flatnonzero(kind[:end] == 0)
    size = np.int64(len(character) + 1)
    pair = character * size + held[behind]
    rest_names, rest_order = dense(pair[rest])
    ones, twos = np.flatnonzero(kind[:end] == 1), np.flatnonzero(kind[:end] == 2)
    before = np.searchsorted(np.sort(pair[ones]), pair[rest], side="left")
    next_pair = pair[behind]
    # against the second kind two characters are needed, the rank behind them is again known
    triple, _ = dense(np.concatenate([character[rest], character[twos]]), np.concatenate([next_pair[rest], next_pair[twos]]))
    before = before + np.searchsorted(np.sort(triple[len(rest) :]), triple[: len(rest)], side="left")
    sample_order = np.argsort(held[sample], kind="stable")
    place_in = np.empty(len(sample), np.int64)
    place_in[sample_order] = np.arange(len(sample))
    ahead = np.cumsum(np.bincount(before, minlength=len(sample) + 1))
    out = np.zeros(len(character), np.int64)
    out[sample] = place_in + ahead[place_in] + 1
    by_rest = np.empty(len(rest), np.int64)
    by_rest[rest_order] = np.arange(len(rest))
    out[rest] = by_rest + before + 1
    # suffixes that agree over the depth must share a rank in the recursion above: ties are kept by name
    return tied(out, character, held, behind, end)


def tied(out: np.ndarray, character: np.ndarray, held: np.ndarray, behind: np.ndarray, end: int) -> np.ndarray:
    """Give neighbours in order the same rank if their character and the ranks behind show no difference."""
    order = np.argsort(out[:end], kind="stable")
    a, b = order[:-1], order[1:]
    both = (held[a] > 0) & (held[b] > 0)
    through = (held[behind[a]] > 0) & (held[behind[b]] > 0) | (behind[a] == end) | (behind[b] == end)
    second = behind[behind]
    same = np.where(
        both,
        held[a] == held[b],
        (character[a] == character[b])
        & np.where(
            through,
            held[behind[a]] == held[behind[b]],
            (character[behind[a]] == character[behind[b]]) & (held[second[a]] == held[second[b]]),
        ),
    )
    names = np.zeros(len(out), np.int64)
    if end:
        names[order] = np.cumsum(np.append(True, ~same))
    return names


def equal_starts(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, group) of all starts of whole `LENGTH`-byte strings; equal strings share a group."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    padded = b"".join(p + b"\0" * CHARACTER for p in pieces)
    text = np.frombuffer(padded + b"\0" * LENGTH, np.uint8)
    first = np.cumsum(sizes + CHARACTER) - (sizes + CHARACTER)
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = first[owner] + place
    character = np.zeros(total, np.uint64)
    for k in range(CHARACTER):
        character = (character << np.uint64(8)) | text[at + k]
    names, _ = dense(character)
    index = np.arange(total)
    behind = np.where(place + CHARACTER < sizes[owner], index + CHARACTER, total)
    rank = ranks(np.append(names + 1, 0), np.append(behind, total), np.append(place, 0), CHARACTER, LENGTH)
    starts = np.flatnonzero(place + LENGTH <= sizes[owner])
    starts = starts[np.argsort(rank[starts], kind="stable")]
    # neighbours in order are compared over the whole prefix
    same = np.zeros(len(starts), bool)
    for low in range(1, len(starts), 1 << 17):
        high = min(len(starts), low + (1 << 17))
        agree = np.ones(high - low, bool)
        # whole characters; the last one overlaps the one before
        for k in [*range(0, LENGTH - CHARACTER, CHARACTER), LENGTH - CHARACTER]:
            agree &= character[starts[low:high] + k] == character[starts[low - 1 : high - 1] + k]
        same[low:high] = agree
    return owner[starts], place[starts], np.cumsum(~same)


def repeated_starts(pieces: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of the strings that also start in a piece earlier in `order`."""
    owner, start, group = equal_starts(pieces)
    best = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, group, order[owner])
    later = order[owner] > best[group]
    return owner[later], start[later]


# ---------------------------------------------------------------- pieces of a page


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each k-gram, from hashes of 1, 2, 4 ... bytes."""
    now = (text.astype(np.uint64) + np.uint64(1)) * MIX
    eight, size = now, 1
    while size < 32:
        now = now[:-size] * STEP + (now[size:] ^ (now[size:] >> np.uint64(29))) * MIX
        size *= 2
        if size == 8:
            eight = now
    count = len(text) - GRAM + 1
    out = now[:count] * STEP + (eight[32 : 32 + count] ^ (eight[32 : 32 + count] >> np.uint64(31))) * MIX
    out ^= out >> np.uint64(32)
    return out * MIX


def page_pieces(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, hash of the leading k-gram) of the pieces of the documents that end at `ends`."""
    none = np.zeros(0, np.int64)
    if len(text) < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(np.frombuffer(text, np.uint8))
    # the leftmost of the smallest: hash above, place below
    low = ((hashes >> PLACE) << PLACE) | np.arange(len(hashes), dtype=np.uint64)
    now, size = low, 1
    while size * 2 <= WINDOW:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    count = len(hashes) - WINDOW + 1
    lead = np.minimum(now[:count], now[WINDOW - size : WINDOW - size + count]) & np.uint64((1 << int(PLACE)) - 1)
    lead = lead.astype(np.int64)
    # starts whose string crosses the end of a document are none
    inside = np.ones(count, bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    fresh = inside.copy()
    fresh[1:] &= (lead[1:] != lead[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh)
    stops = np.flatnonzero(inside & ~np.append(inside[1:] & ~fresh[1:], False)) + 1
    return first, stops - first, hashes[lead[first]]


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


PAGES = "page long, ids binary, text binary"
DEALT = "bucket long, page long, part binary"


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """ids, hashes of the texts, ends and the text of a page."""
    return *unpack(row.ids, "<i8", "<i8", "<i8"), zstandard.ZstdDecompressor().decompress(row.text)


def analysed(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First starts, numbers of starts, k-grams and contents of a page's pieces, and which equal an earlier one of it.

    Made anew wherever they are needed: that costs less than moving them.
    """
    first, count, lead = page_pieces(text, ends)
    content = np.array(
        [xxhash.xxh3_64_intdigest(text[a : a + n + LENGTH - 1]) for a, n in zip(first.tolist(), count.tolist())], np.uint64
    )
    order = np.lexsort((np.arange(len(first)), content, lead))
    same = np.zeros(len(first), bool)
    if len(first):
        same[order[1:]] = (lead[order][1:] == lead[order][:-1]) & (content[order][1:] == content[order][:-1])
    return first, count, lead, content, same


def pages_of(docs: DataFrame, page_bytes: int = PAGE) -> DataFrame:
    """Whole texts in pages: ids (doc_id or the least long, hash of the text, end) and compressed text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        page = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def close() -> pd.DataFrame:
            held.sort(key=lambda x: x[:2])
            text = b"".join(t for _, _, t in held)
            ends = np.cumsum([len(t) for _, _, t in held])
            ids = pack(np.array([d for d, _, _ in held], "<i8"), np.array([h for _, h, _ in held], "<i8"), ends.astype("<i8"))
            return pd.DataFrame({"page": [page], "ids": [ids], "text": [zstandard.ZstdCompressor(level=3).compress(text)]})

        for batch in batches:
            keys = batch["doc_id"].to_numpy()
            for doc_id, text in zip(keys.tolist(), batch["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                held.append((doc_id, xxhash.xxh64_intdigest(raw) - (1 << 63), raw))
                size += len(raw)
                if size >= page_bytes:
                    yield close()
                    held.clear()
                    size, page = 0, page + 1
        if held:
            yield close()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, PAGES)


def dealt(pages: DataFrame, buckets: int, local: int = LOCAL) -> DataFrame:
    """Per page and bucket: the pieces' k-grams, contents, numbers, documents' ids and hashes, and which are marks.

    A mark stands for all pieces of its k-gram in the page, where they differ in more than `local` ways.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, hashes, ends, text = opened(row)
                first, _, lead, content, same = analysed(text, ends)
                # a piece that an earlier one of its page equals is settled there
                open_ones = np.flatnonzero(~same)
                _, earliest, which, times = np.unique(
                    lead[open_ones], return_index=True, return_inverse=True, return_counts=True
                )
                many = times[which] > local
                sent = ~many | (earliest[which] == np.arange(len(open_ones)))
                open_ones, mark = open_ones[sent], many[sent]
                owner = np.searchsorted(ends, first[open_ones], side="right")
                bucket = (lead[open_ones] >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)))
                parts = []
                for group in np.split(order, cuts[1:]) if len(order) else []:
                    at, docs_of = open_ones[group], owner[group]
                    used, nth = np.unique(docs_of, return_inverse=True)
                    parts.append((int(bucket[group[0]]), row.page, pack(
                        lead[at], content[at], np.diff(at, prepend=0).astype("<i4"), np.diff(nth, prepend=0).astype("<i4"),
                        np.diff(ids[used], prepend=0), hashes[used], mark[group].astype("u1"))))
                yield pd.DataFrame(parts, columns=["bucket", "page", "part"])

    return pages.mapInPandas(run, DEALT)


#: What a bucket says of a piece: it repeats an earlier one; it must be sorted; its strings must be sorted one by one,
#: or those of all the page's pieces of its k-gram.
REPEATS, SORTED, SINGLE, MARKED = 1, 2, 3, 4


def judge(rows: pd.DataFrame, crowded: int) -> pd.DataFrame:
    """Of all pieces of a bucket, those that repeat the content of an earlier one and those that need sorting."""
    kinds = ("<u8", "<u8", "<i4", "<i4", "<i8", "<i8", "u1")
    lead, content, number, doc, text_hash, page, mark = [], [], [], [], [], [], []
    for k, row in enumerate(rows.itertuples(index=False)):
        a, c, at, nth, ids, hashes, marks = unpack(row.part, *kinds)
        nth = np.cumsum(nth)
        lead.append(a)
        content.append(c)
        number.append(np.cumsum(at))
        doc.append(np.cumsum(ids)[nth])
        text_hash.append(hashes[nth])
        page.append(np.full(len(a), k))
        mark.append(marks.astype(bool))
    lead, content, number, doc, text_hash, page, mark = map(
        np.concatenate, (lead, content, number, doc, text_hash, page, mark)
    )
    pages = rows["page"].to_numpy()
    order = np.lexsort((number, pages[page], text_hash, doc, content, lead))
    order = order[~mark[order]]
    same_lead = lead[order][1:] == lead[order][:-1]
    same = same_lead & (content[order][1:] == content[order][:-1])
    verdict = np.zeros(len(lead), np.uint8)
    verdict[mark] = MARKED
    verdict[order[1:][same]] = REPEATS
    # first ones of each content, where a k-gram has several contents
    firsts = order[np.append(True, ~same)[: len(order)]]
    starts = np.flatnonzero(np.append(True, lead[firsts][1:] != lead[firsts][:-1])[: len(firsts)])
    count = np.diff(starts, append=len(firsts))
    several = np.repeat(count, count)
    verdict[firsts[several > 1]] = SORTED
    verdict[firsts[(several > crowded) | np.isin(lead[firsts], lead[mark])]] = SINGLE
    told = np.flatnonzero(verdict)
    told = told[np.lexsort((number[told], page[told]))]
    out = []
    for group in np.split(told, np.flatnonzero(np.diff(page[told])) + 1) if len(told) else []:
        out.append((int(pages[page[group[0]]]), pack(number[group].astype("<i4"), verdict[group])))
    return pd.DataFrame(out, columns=["page", "told"])


TOLD = "page long, told binary"


def gathered(told: DataFrame, name: str) -> DataFrame:
    """All verdicts of a page in one row; there is at most one per bucket."""
    return told.groupBy("page").agg(F.collect_list("told").alias(name))


def single_starts(
    text: bytes, first: np.ndarray, count: np.ndarray, lead: np.ndarray, told: list[bytes]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first starts, their strings' hashes, later starts) of the strings of a page that are dealt out one by one."""
    pieces = []
    for number, verdict in (unpack(blob, "<i4", "u1") for blob in told):
        marked = number[verdict == MARKED]
        pieces.append(number[verdict == SINGLE])
        if len(marked):
            pieces.append(np.flatnonzero(np.isin(lead, lead[marked])))
    chosen = np.sort(np.concatenate([np.zeros(0, np.int64), *pieces]).astype(np.int64))
    starts = np.repeat(first[chosen], count[chosen])
    starts += np.arange(len(starts)) - np.repeat(np.cumsum(count[chosen]) - count[chosen], count[chosen])
    own = np.fromiter((xxhash.xxh64_intdigest(text[p : p + LENGTH]) for p in starts.tolist()), np.uint64, len(starts))
    _, earliest, which = np.unique(own, return_index=True, return_inverse=True)
    before = starts[earliest[which]]
    # strings of one hash that differ all stay
    later = np.fromiter(
        (a < p and text[a : a + LENGTH] == text[p : p + LENGTH] for a, p in zip(before.tolist(), starts.tolist())), bool, len(starts)
    )
    return starts[~later], own[~later], starts[later]


def to_sort(pages: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """Per page and bucket: the content of the pieces to sort, with their places; single strings once per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, hashes, ends, text = opened(row)
                first, count, lead = page_pieces(text, ends)
                found: dict[int, list[tuple[int, int, int]]] = {}
                for blob in row.told:
                    number, verdict = unpack(blob, "<i4", "u1")
                    for i in number[verdict == SORTED].tolist():
                        a, n = int(first[i]), int(count[i])
                        found.setdefault(int(lead[i] >> np.uint64(20)) % buckets, []).append((a, n, int(lead[i])))
                starts, hashed, _ = single_starts(text, first, count, lead, row.told)
                for p, own in zip(starts.tolist(), hashed.tolist()):
                    found.setdefault(own % buckets, []).append((p, 1, own))
                parts = []
                for bucket, places in found.items():
                    a, n = np.array([x[:2] for x in places], np.int64).T
                    owner = np.searchsorted(ends, a, side="right")
                    content = b"".join(text[p : p + c + LENGTH - 1] for p, c, _ in places)
                    group = np.array([x[2] for x in places], "<u8")
                    parts.append((bucket, row.page, pack(
                        a, n.astype("<i4"), ids[owner], hashes[owner], group, np.frombuffer(content, np.uint8))))
                yield pd.DataFrame(parts, columns=["bucket", "page", "part"])

    return pages.join(told, "page").mapInPandas(run, DEALT)


def sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """The starts of a bucket's pieces whose string starts earlier in another one."""
    place, ids, hashes, page, pieces, lead = [], [], [], [], [], []  # lead: the k-gram, or the string of a single start
    for k, row in enumerate(rows.itertuples(index=False)):
        a, n, doc, text_hash, group, content = unpack(row.part, "<i8", "<i4", "<i8", "<i8", "<u8", "u1")
        lead.append(group)
        raw, at = content.tobytes(), 0
        for size in (n + LENGTH - 1).tolist():
            pieces.append(raw[at : at + size])
            at += size
        place.append(a)
        ids.append(doc)
        hashes.append(text_hash)
        page.append(np.full(len(a), k))
    place, ids, hashes, page, lead = map(np.concatenate, (place, ids, hashes, page, lead))
    pages = rows["page"].to_numpy()
    order = np.empty(len(place), np.int64)
    order[np.lexsort((place, pages[page], hashes, ids))] = np.arange(len(place))
    # equal strings share a k-gram: pieces of different ones need not be sorted together
    by_lead = np.argsort(lead, kind="stable")
    size = np.cumsum([len(pieces[i]) for i in by_lead.tolist()])
    border = np.append(lead[by_lead][1:] != lead[by_lead][:-1], True)
    owners, starts, low, done = [], [], 0, 0
    for high in (np.flatnonzero(border) + 1).tolist():
        if size[high - 1] - done >= SORTED_BYTES or high == len(by_lead):
            chosen = by_lead[low:high]
            which, start = repeated_starts([pieces[i] for i in chosen.tolist()], order[chosen])
            owners.append(chosen[which])
            starts.append(start)
            low, done = high, size[high - 1]
    owner, start = np.concatenate(owners), np.concatenate(starts)
    at = place[owner] + start
    out = []
    sequence = np.lexsort((at, page[owner]))
    at, which = at[sequence], page[owner][sequence]
    for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(which)) + 1) if len(at) else []:
        out.append((int(pages[which[group[0]]]), pack(at[group])))
    return pd.DataFrame(out, columns=["page", "told"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def settled(pages: DataFrame, with_text: bool = False) -> DataFrame:
    """Removed bytes of every document from a page's own repeats, the buckets' verdicts and the sorted starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, _, ends, text = opened(row)
                first, count, lead, _, gone = analysed(text, ends)
                for blob in row.told if row.told is not None else []:
                    number, verdict = unpack(blob, "<i4", "u1")
                    gone[number[verdict == REPEATS]] = True
                _, _, later = single_starts(text, first, count, lead, row.told if row.told is not None else [])
                marks = np.zeros(len(text) + 1, np.int32)
                np.add.at(marks, later, 1)
                np.add.at(marks, later + LENGTH, -1)
                np.add.at(marks, first[gone], 1)
                np.add.at(marks, first[gone] + count[gone] + LENGTH - 1, -1)
                for blob in row.starts if row.starts is not None else []:
                    (at,) = unpack(blob, "<i8")
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + LENGTH, -1)
                covered = np.cumsum(marks[:-1]) > 0
                raw = np.frombuffer(text, np.uint8)
                out, begin = [], 0
                for doc_id, end in zip(ids.tolist(), ends.tolist()):
                    mine, part = covered[begin:end], raw[begin:end]
                    removed = int(np.count_nonzero(mine))
                    spans = int(mine[:1].sum()) + int(np.count_nonzero(mine[1:] & ~mine[:-1])) if removed else 0
                    kept = part[~mine].tobytes() if removed else part.tobytes()
                    known = None if doc_id == LEAST_ID else doc_id
                    out.append((known, end - begin, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                    begin = end
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame if with_text else frame.drop(columns="kept")

    return pages.mapInPandas(run, RESULT + (", kept binary" if with_text else ""))


def remove_repeats(docs: DataFrame, with_text: bool = False, page_bytes: int = PAGE, crowded: int = CROWDED, local: int = LOCAL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    A byte goes if a `LENGTH`-byte string over it also starts earlier: in a document with a smaller id (null ids come
    first), at equal ids in the text with the smaller hash, or earlier in the same document. Of repeated rows the first
    stays. A null text has no bytes, texts shorter than `LENGTH` lose none. Only doc_id and text are used.
    """
    spark = docs.sparkSession
    pages = written(pages_of(docs, page_bytes), "pages")
    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pages.count() / BUCKET_PAGES))
    told = written(dealt(pages, buckets, local).groupBy("bucket").applyInPandas(lambda rows: judge(rows, crowded), TOLD), "told")
    by_page = gathered(told, "told")
    parts = to_sort(pages, by_page, buckets)
    starts = written(parts.groupBy("bucket").applyInPandas(sort_bucket, TOLD), "starts")
    whole = pages.join(by_page, "page", "left").join(gathered(starts, "starts"), "page", "left")
    return settled(whole, with_text)
