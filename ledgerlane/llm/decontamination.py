"""Benchmark passages in documents, found by latent semantic retrieval and verified by their words.

Terms are the words of the benchmark. Document frequencies come from all documents. A randomised SVD, computed by Spark
over the TF-IDF passages of all documents together with the benchmark's own, gives the latent space: how often two terms
share a passage is counted exactly over every passage, and the products of the SVD are taken from these counts. Every
passage of every document is projected and compared with all items by cosine; as the passage's own length is known, the
bound is on its projection on the item, and is set from copies of the item with words left out. No figure comes from a
sample of the documents. Documents that hold the end of an item's answer have a lower bound for it, set from paraphrases
down to half of the words with the heaviest others left out. Candidates are verified by their longest common subsequence
with the item: most of the item's words in order, or half of them together with the item's answer, its closing words.

The benchmark is the stated query set. It is taken in blocks of `ITEMS` items, so whatever its size no task holds more, and
the space has room for every item of its block.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerlane.llm.common import text_or_empty, written
from ledgerlane.llm.labelled import hashed_sample  # noqa: F401, bounded samples are asked for here as well

ITEMS = 256
#: Words of a segment; a passage is two segments, so shorter runs of words lie in one passage whole.
SEGMENT = 32
DIMENSIONS = 256
EXTRA = 8
#: Documents whose passages a task looks at together when the space is fitted, on all documents; and their letters.
FITTED_DOCUMENTS = 4000
FITTED_BLOCK = 2_000_000
#: Pairs of terms that a task makes at once; it holds twice as many different ones before it passes them on.
PAIRS = 500_000
#: Share of an item's words found in order that counts as a copy, and the share that does together with the answer.
COPIED = 0.8
PARAPHRASED = 0.5
#: Items with fewer words must be found whole and in one piece.
SHORT = 8
#: Shortened copies of an item that set its bounds, and how far below the least of them a bound is.
TRIALS = 40
SLACK = 0.8
#: Share of the documents above which a term is common, and how many telling terms an item keeps.
COMMON = 0.05
#: Share of an item's length that a bound is at least. Where a paraphrase can keep less than that, the space cannot tell
#: them: then every passage of a document with the answer is a candidate.
BLIND = 0.05
TELLING = 5
BLOCK = 500_000
MARKS = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    """The words between white space, in lower case and without ASCII marks; words of marks only are left out."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, MARKS).split()


def numbered(text: str, numbers: dict[bytes, int]) -> np.ndarray:
    """The numbers of a text's words, 0 for words that are no term."""
    words = words_of(text)
    return np.fromiter(map(numbers.get, words, repeat(0)), np.int32, len(words))


@dataclass
class Items:
    """A block of items: their ids, their words as term numbers, and the numbers of all terms (from 1)."""

    ids: list[int]
    words: list[np.ndarray]
    numbers: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        numbers: dict[bytes, int] = {}
        words, ids = [], []
        for item, text in rows:
            found = words_of(text)
            if found:
                ids.append(item)
                words.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in found], np.int32))
        return cls(ids, words, numbers)


def segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, document) of the segments of texts with `sizes` words, laid end to end."""
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(owner)) - first[owner]
    return (np.cumsum(sizes) - sizes)[owner] + place * SEGMENT, owner


def blocks(
    texts: list[str], numbers: dict[bytes, int], most: int = BLOCK
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, term numbers per text) for blocks of bounded size, one text at least."""
    first, held, letters = 0, [], 0
    for i, text in enumerate(texts):
        held.append(numbered(text, numbers))
        letters += len(text)
        if letters >= most:
            yield first, held
            first, held, letters = i + 1, [], 0
    if held:
        yield first, held


def passages(held: list[np.ndarray], vectors: np.ndarray, weighs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, starts, document) of all passages: the summed term vectors of a segment and the one behind it."""
    sizes = np.array([len(h) for h in held])
    flat = np.concatenate(held) if len(held) else np.zeros(0, np.int32)
    starts, owner = segments(sizes)
    if not len(starts):
        return np.zeros((0, vectors.shape[1]), np.float32), starts, owner
    # most words are no terms or weigh nothing: only the others are added up
    met = np.flatnonzero(weighs[flat])
    sums = np.zeros((len(starts), vectors.shape[1]), vectors.dtype)
    which = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(flat)))[met]
    if len(met):
        first = np.flatnonzero(np.diff(which, prepend=-1))
        sums[which[first]] = np.add.reduceat(vectors[flat[met]], first, axis=0)
    same = owner[:-1] == owner[1:]
    sums[:-1] += np.where(same[:, None], sums[1:], 0)
    return sums, starts, owner


def bit_places(item: list[int]) -> dict[int, int]:
    """For each word of an item, its places as bits."""
    places: dict[int, int] = {}
    for k, word in enumerate(item):
        places[word] = places.get(word, 0) | (1 << k)
    return places


def common_length(places: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence with an item of `size` words, one step on a row of bits per word."""
    full = row = (1 << size) - 1
    for word in other:
        match = row & places.get(word, 0)
        if match:
            row = ((row + match) | (row - match)) & full
    return size - row.bit_count()


def holds(text: np.ndarray, part: np.ndarray) -> bool:
    """Whether `part` occurs in `text` in one piece."""
    if len(part) > len(text):
        return False
    at = np.flatnonzero(text[: len(text) - len(part) + 1] == part[0])
    return any((text[k : k + len(part)] == part).all() for k in at)


def answer(item: np.ndarray) -> np.ndarray:
    """The closing words of an item, a quarter of it and three at least."""
    return item[-max(3, len(item) // 4) :]


def verified(item: np.ndarray, places: dict[int, int], region: np.ndarray) -> float:
    """The share of the item's words found in order in a region, or 0 if that is no copy."""
    if len(item) < SHORT:
        return 1.0 if holds(region, item) else 0.0
    shared = [word for word in region.tolist() if word in places]
    if len(shared) < PARAPHRASED * len(item):
        return 0.0
    share = common_length(places, len(item), shared) / len(item)
    if share >= COPIED or (share >= PARAPHRASED and holds(region[region > 0], answer(item))):
        return share
    return 0.0


@dataclass
class Index:
    """A block of items in their latent space: what each term (row 0 is no term) adds to a passage's projection on each
    item, a vector of length 1, and the bounds of that projection: the passage's length times its cosine with the item.

    `bounds` holds everywhere, `paraphrases` in documents with the item's answer, as no other holds a paraphrase.
    """

    items: Items
    projected: np.ndarray
    bounds: np.ndarray
    paraphrases: np.ndarray

    def answered(self, held: list[np.ndarray]) -> np.ndarray:
        """Which texts (rows) hold the last three words of which items (columns), words that are no term left out."""
        out = np.zeros((len(held), len(self.items.words)), bool)
        flat = np.concatenate(held).astype(np.int64)
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])[flat > 0]
        flat = flat[flat > 0]
        base = len(self.items.numbers) + 1
        ends: dict[int, list[int]] = {}
        for j, words in enumerate(self.items.words):
            if len(words) >= SHORT:
                a, b, c = words[-3:].astype(np.int64)
                ends.setdefault(int((a * base + b) * base + c), []).append(j)
        keys = (flat[:-2] * base + flat[1:-1]) * base + flat[2:]
        wanted = np.fromiter(ends, np.int64, len(ends))
        for k in np.flatnonzero(np.isin(keys, wanted) & (owner[:-2] == owner[2:])).tolist():
            out[owner[k], ends[int(keys[k])]] = True
        return out

    def matches(self, texts: list[str]) -> list[dict[int, float]]:
        """Of each text, the verified items and the share of their words found."""
        out: list[dict[int, float]] = [{} for _ in texts]
        weighs = self.projected.any(1)
        places = [bit_places(words.tolist()) for words in self.items.words]
        for first, held in blocks(texts, self.items.numbers):
            flat_starts = np.cumsum([0] + [len(h) for h in held])
            for low in range(0, len(held), 4096):
                part = held[low : low + 4096]
                sums, starts, owner = passages(part, self.projected, weighs)
                answered = self.answered(part)
                some = np.flatnonzero(sums.any(1) | answered.any(1)[owner])
                for a in range(0, len(some), 8192):
                    rows = some[a : a + 8192]
                    near = sums[rows] >= self.bounds
                    asked = np.flatnonzero(answered.any(1)[owner[rows]])
                    near[asked] |= answered[owner[rows[asked]]] & (sums[rows[asked]] >= self.paraphrases)
                    for r, j in zip(*np.nonzero(near)):
                        r = rows[r]
                        doc = low + owner[r]
                        at = starts[r] + flat_starts[low] - flat_starts[doc]
                        item = self.items.words[j]
                        # an item that starts or ends outside the passage reaches no further than its own length
                        region = held[doc][max(0, at - len(item)) : at + 2 * SEGMENT + len(item)]
                        share = verified(item, places[j], region)
                        if share > out[first + doc].get(self.items.ids[j], 0.0):
                            out[first + doc][self.items.ids[j]] = share
        return out


def frequencies(docs: DataFrame, numbers: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Document frequency of every term over all documents, and how many documents there are."""
    size = len(numbers) + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total[0] += 1
                found = np.unique(numbered(text, numbers))
                total[found[found > 0]] += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    rows = docs.select(text_or_empty().alias("text")).mapInPandas(count, "term long, n long")
    out = np.zeros(size, np.int64)
    for row in rows.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out, int(out[0])


def meetings_in(held: list[np.ndarray], size: int, weighs: np.ndarray) -> Iterator[np.ndarray]:
    """The weighing words of all passages of some texts: first the term of every word of every passage, then of every two
    words of a passage, in pieces, both their terms as one number, the smaller one times `size` plus the larger one."""
    sizes = np.array([len(h) for h in held])
    flat = np.concatenate(held)
    starts, owner = segments(sizes)
    met = np.flatnonzero(weighs[flat])
    terms = flat[met].astype(np.int64)
    which = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(flat)))[met]
    edges = np.searchsorted(which, np.arange(len(starts) + 2))
    # a passage reaches over the following segment if that is of the same text
    low, high = edges[:-2], np.where(np.append(owner[:-1] == owner[1:], False), edges[2:], edges[1:-1])
    counts = high - low
    one = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    yield terms[one]
    behind = np.repeat(high, counts) - one - 1
    total = np.cumsum(behind)
    at = 0
    while at < len(one):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        times = behind[at:to]
        first = np.repeat(one[at:to], times)
        second = np.arange(len(first)) + np.repeat(one[at:to] + 1 - (np.cumsum(times) - times), times)
        a, b = terms[first], terms[second]
        yield np.minimum(a, b) * size + np.maximum(a, b)
        at = to


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def term_rows(keys: np.ndarray, counts: np.ndarray, own: np.ndarray) -> Iterator[pd.DataFrame]:
    """(term, others, counts) from pairs of words and from the words by themselves, every pair seen from both its ends."""
    size = len(own)
    alone = np.flatnonzero(own)
    both = np.concatenate([keys, keys % size * size + keys // size, alone * size + alone])
    both, total = summed(both, np.concatenate([counts, counts, own[alone]]))
    term, others = both // size, (both % size).astype(np.int32)
    first = np.flatnonzero(np.diff(term, prepend=-1)).tolist()
    ends = [*first[1:], len(both)]
    for k in range(0, len(first), 512):
        spans = list(zip(first[k : k + 512], ends[k : k + 512]))
        yield pd.DataFrame({
            "term": [int(term[a]) for a, _ in spans],
            "others": [others[a:b].tobytes() for a, b in spans],
            "counts": [total[a:b].tobytes() for a, b in spans],
        })


def meetings(docs: DataFrame, numbers: dict[bytes, int], weighs: np.ndarray) -> DataFrame:
    """(term, others, counts): the matrix of how often two weighing terms are in one passage, over all documents.

    An entry is the sum over all passages of the product of both terms' counts; `others` holds the columns of a row as
    int32, `counts` the entries as int64. Counts are whole numbers, so no order of the rows can move them. A task holds
    few more than twice `PAIRS` different pairs, and a row is summed as its parts stream by.
    """
    size = len(numbers) + 1
    kept = {word: term for word, term in numbers.items() if weighs[term]}
    schema = "term long, others binary, counts binary"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = counts = np.zeros(0, np.int64)
        own = np.zeros(size, np.int64)
        for batch in batches:
            for _, held in blocks(batch["text"].tolist(), kept, FITTED_BLOCK):
                for low in range(0, len(held), FITTED_DOCUMENTS):
                    words, *pieces = meetings_in(held[low : low + FITTED_DOCUMENTS], size, weighs)
                    own += np.bincount(words, minlength=size)
                    for piece in pieces:
                        more, n = np.unique(piece, return_counts=True)
                        keys, counts = summed(np.concatenate([keys, more]), np.concatenate([counts, n]))
                    if len(keys) > 2 * PAIRS:
                        yield from term_rows(keys, counts, own)
                        keys = counts = np.zeros(0, np.int64)
                        own[:] = 0
        yield from term_rows(keys, counts, own)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        term, row = None, np.zeros(size, np.int64)

        def made() -> pd.DataFrame:
            some = np.flatnonzero(row)
            return pd.DataFrame(
                {"term": [term], "others": [some.astype(np.int32).tobytes()], "counts": [row[some].tobytes()]}
            )

        for batch in batches:
            rows = []
            for k, others, counts in zip(batch["term"].tolist(), batch["others"], batch["counts"]):
                if k != term:
                    if term is not None:
                        rows.append(made())
                    term = k
                    row[:] = 0
                row[np.frombuffer(others, np.int32)] += np.frombuffer(counts, np.int64)
            if rows:
                yield pd.concat(rows)
        if term is not None:
            yield made()

    parts = docs.select(text_or_empty().alias("text")).mapInPandas(count, schema)
    return parts.repartition("term").sortWithinPartitions("term").mapInPandas(add, schema)


def gram_times(met: DataFrame, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """AᵀA x for the TF-IDF passages A of all documents, from the meetings of their terms; one row a term is sent."""
    size, width = x.shape
    weighted = weights[:, None] * x
    # rows that are multiplied together, of bounded size
    together = max(1, 4_000_000 // size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), together):
                part = batch.iloc[k : k + together]
                entries = np.zeros((len(part), size))
                for i, (others, counts) in enumerate(zip(part["others"], part["counts"])):
                    entries[i, np.frombuffer(others, np.int32)] = np.frombuffer(counts, np.int64)
                yield pd.DataFrame({"term": part["term"], "sums": [row.tobytes() for row in entries @ weighted]})

    out = np.zeros((size, width))
    for row in met.mapInPandas(run, "term long, sums binary").collect():
        out[row["term"]] += np.frombuffer(row["sums"], np.float64)
    return weights[:, None] * out


def term_weights(counts: np.ndarray, n: int, items: Items) -> np.ndarray:
    """IDF of the terms; those in more than `COMMON` of all documents weigh nothing in the search.

    The limit rises as far as it must for every item to keep `TELLING` different terms, or all it has.
    """
    share = counts / max(1, n)
    limit = COMMON
    for words in items.words:
        rarest = np.sort(share[np.unique(words)])
        limit = max(limit, rarest[min(TELLING, len(rarest)) - 1])
    weights = np.log((n + 1.0) / (counts + 1.0)) + 0.1
    weights[share > limit] = 0.0
    weights[0] = 0.0
    return weights


def latent_space(docs: DataFrame, items: Items, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(IDF weights, term vectors): a randomised SVD with one power step over passages and items together."""
    counts, n = frequencies(docs, items.numbers)
    weights = term_weights(counts, n, items)
    # counted once for both products
    met = written(meetings(docs, items.numbers, weights > 0), "meetings")
    # items weigh as much as the passages
    balance = max(1.0, n * 16 / max(1, len(items.words)))

    def times(x: np.ndarray) -> np.ndarray:
        out = gram_times(met, weights, x)
        for words in items.words:
            term, tf = np.unique(words, return_counts=True)
            row = tf * weights[term]
            out[term] += balance * row[:, None] * (row @ x[term])
        return out

    random = np.random.default_rng(seed)
    width = min(DIMENSIONS + EXTRA, len(weights))
    q, _ = np.linalg.qr(times(random.standard_normal((len(weights), width))))
    values, rotation = np.linalg.eigh(q.T @ times(q))
    vectors = q @ rotation[:, np.argsort(-values)[:DIMENSIONS]]
    vectors[0] = 0.0
    return weights, vectors


def paraphrased(words: np.ndarray, weights: np.ndarray, random: np.random.Generator | None) -> np.ndarray:
    """Places of the words that the scantest paraphrase keeps: the answer, and other words at random or else the lightest."""
    others = len(words) - len(answer(words))
    count = max(0, int(np.ceil(PARAPHRASED * len(words))) - len(answer(words)))
    if random is None:
        chosen = np.argsort(weights[words[:others]], kind="stable")[:count]
    else:
        chosen = random.choice(others, count, replace=False)
    return np.sort(np.append(chosen, np.arange(others, len(words))))


def build(docs: DataFrame, items: Items, seed: int = 4) -> Index:
    """The index of a block of items.

    Bounds come from copies with a fifth of the words left out, and from the scantest paraphrases: the least that one adds
    to the projection of the passage around it, whatever the other words are.
    """
    weights, space = latent_space(docs, items)
    vectors = weights[:, None] * space
    queries = np.stack([vectors[w].sum(0) for w in items.words])
    lengths = np.linalg.norm(queries, axis=1)
    projected = (vectors @ (queries / np.maximum(lengths[:, None], 1e-9)).T).astype(np.float32)
    random = np.random.default_rng(seed)
    bounds = np.zeros(len(items.words), np.float32)
    for j, words in enumerate(items.words):
        low = lengths[j]
        for _ in range(TRIALS):
            kept = words[np.sort(random.choice(len(words), max(1, int(len(words) * 0.8)), replace=False))]
            # a passage holds a segment's length of a long item at least
            at = random.integers(0, max(1, len(kept) - SEGMENT + 1))
            low = min(low, float(projected[kept[at : at + SEGMENT], j].sum()))
        bounds[j] = max(BLIND * lengths[j], SLACK * low)
    paraphrases = np.full(len(items.words), np.inf, np.float32)
    for j, words in enumerate(items.words):
        if len(words) < SHORT:
            continue
        low = lengths[j]
        for trial in range(TRIALS):
            kept = paraphrased(words, weights, random if trial % 2 else None)
            at = random.integers(0, max(1, len(words) - SEGMENT + 1))
            low = min(low, float(projected[words[kept[(kept >= at) & (kept < at + SEGMENT)]], j].sum()))
        paraphrases[j] = SLACK * low if low > BLIND * lengths[j] else -np.inf
    return Index(items, projected, bounds, paraphrases)


def item_blocks(benchmark: DataFrame, size: int = ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; null ids and null texts are no items, an id with several texts has several items."""
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    held: list[tuple[int, str]] = []
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def matches(index: Index, text: str | Column = "text") -> Column:
    """A map from item id to the share of its words found, of the verified items of one index."""

    @pandas_udf("items array<long>, shares array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = index.matches(batch.tolist())
            yield pd.DataFrame({"items": [sorted(f) for f in found], "shares": [[f[i] for i in sorted(f)] for f in found]})

    return run(text_or_empty(text))


def contained(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """A struct column: `items`, the benchmark items a text holds in ascending order, and `share`, the largest share.

    A null or empty text holds none, and an empty benchmark is held by none.
    """
    searched = docs.select(F.col(text).alias("text"))
    items, shares = F.array().cast("array<long>"), F.array().cast("array<double>")
    for rows in item_blocks(benchmark):
        block = Items.of(rows)
        if block.ids:
            found = matches(build(searched, block), text)
            items, shares = F.concat(items, found["items"]), F.concat(shares, found["shares"])
    return F.struct(
        F.array_sort(F.array_distinct(items)).alias("items"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("share"),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, share) of every row; items are joined by commas, repeated rows report each."""
    found = docs.select("doc_id", contained(docs, benchmark).alias("found"))
    return found.select(
        "doc_id", (F.size("found.items") > 0).alias("contaminated"), F.size("found.items").cast("long").alias("n_items"),
        F.array_join(F.col("found.items").cast("array<string>"), ",").alias("items"),
        F.round("found.share", 6).alias("share"),
    )
