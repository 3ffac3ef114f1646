import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from ledgerlane.llm import bpe, repair

POOL = "abcdeé'st\x01  \n.!0é߀ñカ中😀‍\x1c\x1f́İΣς<|"


def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def texts():
    dice = random.Random(1)
    found = ["", " ", "Hello World's 123", "x" * 5000, "<|startoftext|>a<|endoftext|> b", "\x00\x7f", "ab" * 70 + "é"]
    for _ in range(600):
        found.append("".join(dice.choice(POOL) for _ in range(dice.randrange(40))))
    words = ["erreth", "idiot", "thndhain", "réeuxment", "uncharacteristically", "antidisestablishment", "'re", "..!"]
    return found + [" ".join(dice.choices(words, k=12)) + dice.choice(["", "<|endoftext|>"]) for _ in range(50)]


def test_ids_and_decoded_text_equal_the_library():
    every, tool = texts(), library()
    found = list(bpe.Encoder().encoded(every))
    wanted = tool.encode_batch(every, add_special_tokens=False)
    for text, (ids, decoded), encoding in zip(every, found, wanted):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.ids, repr(text)
        assert decoded == tool.decode(encoding.ids, skip_special_tokens=False), repr(text)


def test_every_code_point_is_encoded_as_the_library_does():
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    tool = library()
    every = [" ".join(f"a {c}b {c}" for c in points[low : low + 500]) for low in range(0, len(points), 500)]
    wanted = [e.ids for e in tool.encode_batch_fast(every, add_special_tokens=False)]
    found = [np.frombuffer(ids, "<u4").tolist() for ids, _ in bpe.encoder().encoded(every)]
    assert [k for k, (a, b) in enumerate(zip(found, wanted)) if a != b] == []


def test_exact_merging_agrees_with_itself():
    table = bpe.Encoder().vocabulary
    dice = random.Random(4)
    words = ["".join(dice.choices("etaoinshr", k=dice.randrange(1, 14))) for _ in range(300)]
    for word, packed in zip(words, table.encode_words(words)):
        assert np.frombuffer(packed, "<u4").tolist() == table.merged(word)


def test_caches_are_bounded_and_do_not_change_results(monkeypatch):
    every = texts()[:200]
    wanted = list(bpe.Encoder().encoded(every))
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHED_LETTERS", 5)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    assert list(bpe.Encoder().encoded(every)) == wanted


def test_chunks_met_again_are_not_cut_again(monkeypatch):
    every = texts()
    wanted = list(bpe.Encoder().encoded(every))
    tool, cut = bpe.Encoder(), []
    whole = bpe.Encoder.cut
    monkeypatch.setattr(bpe.Encoder, "cut", lambda self, chunks: cut.extend(chunks) or whole(self, chunks))
    assert list(tool.encoded(every)) == wanted
    assert cut and len(cut) == len(set(cut))
    cut.clear()
    assert list(tool.encoded(every)) == wanted
    assert cut == []
    # beyond the bound, what came back lately stays and what came once goes
    common = "the same words again "
    list(tool.encoded([common]))
    list(tool.encoded([common]))
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 400)
    list(tool.encoded([" ".join(f"once{k}" for k in range(500))]))
    cut.clear()
    assert list(tool.encoded([common + "once3"])) == list(bpe.Encoder().encoded([common + "once3"]))
    assert len(tool.chunks.sizes) <= 400


ROWS = [(1, None, "x"), (2, "", None), (None, "A b's", "y"), (3, "same", "z"), (3, "same", "z"), (4, "long " * 9000, "")]


def test_rows_with_nulls_repeats_and_other_columns(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, bpe string")
    found = bpe.digests(rows).collect()
    tool = library()
    wanted = []
    for doc_id, text, _ in ROWS:
        ids = tool.encode(text or "", add_special_tokens=False).ids
        wanted.append((
            doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        ))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert bpe.digests(rows.limit(0)).count() == 0
    again = bpe.decode(bpe.encode(rows).select("bpe.ids", "bpe.decoded").withColumnRenamed("decoded", "first"), "ids")
    assert all(r["first"] == r["decoded"] for r in again.collect())


def test_grammar_round_trip_and_ranges():
    dice = np.random.default_rng(3)
    for size in (0, 1, 2, 50, 5000):
        for letters in (1, 2, 40, 40000):
            ids = dice.integers(0, letters, size).astype("<u4")
            rules, sequence = repair.compress(ids)
            assert (repair.expand(rules, sequence) == ids).all()
            assert len(sequence) + 2 * len(rules) <= max(1, len(ids))
            for _ in range(5):
                a, b = sorted(dice.integers(0, size + 1, 2).tolist())
                expansions = repair.lengths(rules)[repair.TERMINALS :]
                assert (repair.read_range(rules, expansions, sequence, a, b) == ids[a:b]).all()


def test_repeated_ids_shrink():
    ids = np.tile(np.arange(8, dtype="<u4"), 1000)
    rules, sequence = repair.compress(ids)
    assert len(sequence) < 400


def test_shards_keep_order_and_ids(spark, tmp_path):
    import zlib

    rows = spark.createDataFrame(ROWS, "doc_id long, text string, ids string").repartition(3)
    path = str(tmp_path / "shards")
    repair.write(rows, path, shard_ids=4)
    found = sorted(repair.read(spark, path).collect(), key=lambda r: r["start"])
    tool, at = library(), 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for row, (doc_id, text, _) in zip(found, order):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(found) == len(ROWS)
    assert repair.round_trip(rows.limit(0)).count() == 0


def test_ranges_are_read_from_the_table(spark, tmp_path):
    tool = library()
    texts = [" ".join(["one fine day", "x" * (k % 7), "the same words again"] * (k % 11)) for k in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    path = str(tmp_path / "ranges")
    repair.write(rows, path, shard_ids=300)
    every = [i for t in texts for i in [*tool.encode(t, add_special_tokens=False).ids, 1]]
    shards = spark.read.schema(repair.SHARD).parquet(path)
    assert shards.count() > 8 and shards.select("part").distinct().count() > 1
    for row in shards.collect():
        rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        held = np.frombuffer(row["expansions"], "<u4").tolist()
        assert held == [len(repair.expand(rules, np.array([repair.TERMINALS + k]))) for k in range(len(rules))]
    dice = random.Random(6)
    ranges = [(0, len(every)), (5, 5), (len(every) - 3, len(every) + 50), (len(every), len(every) + 9)]
    for a, b in ranges + [tuple(sorted(dice.sample(range(len(every)), 2))) for _ in range(4)]:
        found = sorted(repair.read_ids(spark, path, a, b).collect(), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in found), "<u4").tolist() == every[a:b]
        assert not found or found[0]["start"] == a
    assert repair.read_ids(spark, path, 10, 40).count() == 1


def test_an_encoder_is_made_in_little_memory():
    import tracemalloc

    path = bpe.default_vocabulary()
    for make in (bpe.symbols_of_later_versions, bpe.lower_case_of_later_versions):
        tracemalloc.start()
        made = make(path)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # every worker makes them once; all letters in one list took over 100 MB
        assert made and peak < 30e6, (make.__name__, peak)
