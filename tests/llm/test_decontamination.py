import random

import numpy as np

from ledgerlane.llm import decontamination


def prose(dice, n):
    syllables = ["th", "er", "on", "an", "re", "ing", "ed", "nd", "ha", "st", "le", "qua", "men", "ou"]
    return ["".join(dice.choices(syllables, k=dice.randrange(1, 4))) for _ in range(n)]


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_length():
    dice = random.Random(2)
    for _ in range(200):
        a = dice.choices(range(6), k=dice.randrange(1, 70))
        b = dice.choices(range(8), k=dice.randrange(90))
        assert decontamination.common_length(decontamination.bit_places(a), len(a), b) == longest(a, b)


def test_segments_cover_texts():
    starts, owner = decontamination.segments(np.array([0, 1, 32, 33, 100]))
    assert starts.tolist() == [0, 1, 33, 65, 66, 98, 130, 162] and owner.tolist() == [1, 2, 3, 3, 4, 4, 4, 4]


def planted(seed=1):
    dice = random.Random(seed)
    items = [prose(dice, dice.randrange(15, 56)) for _ in range(30)]
    rows, truth = [], {}
    for k in range(260):
        words, held = prose(dice, dice.randrange(20, 300)), set()
        for _ in range(dice.choice([0, 0, 1, 2])):
            i = dice.randrange(len(items))
            copy = list(items[i])
            if dice.random() < 0.5:
                # a paraphrase: a few words replaced, not at the end
                for at in dice.sample(range(len(copy) - 5), len(copy) // 8):
                    copy[at] = "changed"
            at = dice.randrange(len(words))
            words[at:at] = copy
            held.add(i)
        rows.append((k, " ".join(words)))
        truth[k] = held
    return rows, [(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)], truth


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rows, items, truth = planted()
    rows += [(900, None), (901, ""), (None, items[3][1]), (902, items[4][1].upper()), (902, items[4][1])]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(
        [*items, (None, "nothing at all"), (77, None), (78, ""), (79, "tiny item")], "item_id long, text string"
    )
    found = decontamination.report(docs, benchmark).collect()
    assert len(found) == len(rows)
    named = {}
    for r in found:
        named.setdefault(r["doc_id"], set()).update(int(x) for x in r["items"].split(",") if x)
    hit = sum(len(named[k] & held) for k, held in truth.items())
    assert hit >= 0.98 * sum(map(len, truth.values()))
    # a passage cut in two by a later one may count as absent, but no clean document is accused
    assert not [k for k, held in truth.items() if named[k] - held]
    assert named[None] == {3} and named[902] == {4} and not named[900] and not named[901]
    assert decontamination.report(docs.limit(0), benchmark).count() == 0
    assert decontamination.report(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rows, items, _ = planted(3)
    docs = spark.createDataFrame(rows[:60], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.report(docs, benchmark).select("doc_id", "items").collect()))
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (11,))
    assert sorted(map(tuple, decontamination.report(docs, benchmark).select("doc_id", "items").collect())) == whole


def test_paraphrases_from_half_of_the_words_are_found_as_by_brute_force(spark):
    dice = random.Random(8)
    usual = prose(dice, 60)
    rare = [f"rare{k}" for k in range(2000)]
    items = []
    for _ in range(40):
        n = dice.randrange(10, 70)
        # half of the words are telling ones; they may all be missing from a paraphrase
        items.append([dice.choice(rare) if dice.random() < 0.5 else dice.choice(usual) for _ in range(n)])
    texts = []
    for k in range(400):
        words = [dice.choice(usual) if dice.random() < 0.9 else dice.choice(rare) for _ in range(dice.randrange(30, 300))]
        if k % 4:
            item = items[k % 40]
            end = len(item) - max(3, len(item) // 4)
            missing = min(end, int(len(item) * dice.uniform(0.21, 0.5)))
            order = sorted(range(end), key=lambda i: (not item[i].startswith("rare") if k % 2 else 0, dice.random()))
            copy = list(item)
            for i in order[:missing]:
                copy[i] = "changed" + str(i)
            at = dice.randrange(len(words))
            words[at:at] = copy
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    block = decontamination.Items.of([(i, " ".join(w)) for i, w in enumerate(items)])
    found = decontamination.build(docs, block).matches(texts)
    places = [decontamination.bit_places(w.tolist()) for w in block.words]
    wanted = hit = 0
    for k, text in enumerate(texts):
        words = decontamination.numbered(text, block.numbers)
        for j, item in enumerate(block.words):
            held = any(
                decontamination.verified(item, places[j], words[max(0, at - len(item)) : at + 64 + len(item)])
                for at in range(0, len(words), decontamination.SEGMENT)
            )
            wanted += held
            hit += held and block.ids[j] in found[k]
            assert held or block.ids[j] not in found[k]
    assert wanted >= 250 and hit >= 0.995 * wanted, (hit, wanted)


def test_a_space_fitted_on_a_small_share_of_the_texts_finds_the_same(spark, monkeypatch):
    rows, items, truth = planted(4)
    monkeypatch.setattr(decontamination, "FITTED_DOCUMENTS", 12)
    # one hot text in a third of all rows takes a single place of the sample
    hot = [(10_000 + k, rows[0][1]) for k in range(len(rows) // 2)]
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string").repartition(13)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for r in decontamination.report(docs, benchmark).collect():
        found.setdefault(r["doc_id"], set()).update(int(x) for x in r["items"].split(",") if x)
    hit = sum(len(found[k] & held) for k, held in truth.items())
    assert hit >= 0.98 * sum(map(len, truth.values()))
    assert not [k for k, held in truth.items() if found[k] - held]
    assert all(found[k] == found[rows[0][0]] for k, _ in hot)


def test_the_fitted_sample_is_bounded_and_never_empty(spark):
    docs = spark.range(9000).selectExpr("concat('text ', id % 5000) AS text").repartition(40)
    fitted = decontamination.hashed_sample(docs, 700)
    assert fitted.count() == fitted.select("text").distinct().count() == 700
    assert decontamination.hashed_sample(docs.limit(3), 700).count() == docs.limit(3).distinct().count()


def test_the_space_is_fitted_on_every_passage_of_every_document(spark, monkeypatch):
    rows, items, _ = planted(6)
    texts = [text for _, text in rows[:90]] + [None, "", " ".join([items[0][1]] * 5), rows[0][1]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    block = decontamination.Items.of(items)
    weights, vectors = decontamination.latent_space(docs, block)
    # tasks that look at few texts and hold few pairs find the same space, to rounding
    monkeypatch.setattr(decontamination, "FITTED_DOCUMENTS", 7)
    monkeypatch.setattr(decontamination, "PAIRS", 400, raising=False)
    again = decontamination.latent_space(docs.repartition(5), block)
    assert (again[0] == weights).all()
    assert np.allclose(again[1] @ again[1].T, vectors @ vectors.T, atol=1e-6)
    # the products are those of all passages
    passages = []
    for text in texts:
        words = decontamination.numbered(text or "", block.numbers)
        for at in range(0, len(words), decontamination.SEGMENT):
            inside = words[at : at + 2 * decontamination.SEGMENT]
            passages.append(np.bincount(inside, minlength=len(weights)) * weights)
    a = np.array(passages)
    x = np.random.default_rng(1).standard_normal((len(weights), 9))
    met = decontamination.meetings(docs, block.numbers, weights > 0)
    assert np.allclose(decontamination.gram_times(met, weights, x), a.T @ (a @ x))
