"""Template filling and reply parsing against plain Python on small inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlane.functions import text as tx


def opens_an_item(line):
    line = line.strip()
    return bool(line) and (line[0].isdigit() or line[0] == "-")


def parse(spark, replies):
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    rows = df.select("id", tx.parse_variations(F.col("reply")).alias("v")).collect()
    return {r.id: r.v for r in rows}


def test_variations(spark):
    cases = [
        ("Here they are:\n1. first\n   goes on\n2. second", ["1. first goes on", "2. second"]),
        ("- a\n- b\n\nc", ["- a", "- b c"]),
        ("no items at all", []),
        ("", []),
        (" 1) nbsp\u00a0\u3000\n\n\n9 lines", ["1) nbsp", "9 lines"]),
        ("intro\n\n-\n\tx", ["- x"]),
        (
            "x\n² raised\n① circled\n\U0001f102 comma\n½ is none\n٣ decimal",
            ["² raised", "① circled", "\U0001f102 comma ½ is none", "٣ decimal"],
        ),
    ]
    got = parse(spark, [reply for reply, _ in cases])
    assert [got[i] for i in range(len(cases))] == [items for _, items in cases]


def test_variations_null(spark):
    assert parse(spark, [None])[0] is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab1-. \t\n  é", max_size=40), min_size=30, max_size=60))
def test_variations_on_any_text(spark, replies):
    for i, items in parse(spark, replies).items():
        lines = replies[i].split("\n")
        marked = [k for k, line in enumerate(lines) if opens_an_item(line)]
        assert len(items) == len(marked) and all(map(opens_an_item, items))
        # nothing from the first item on is lost, nothing before it is taken
        told = " ".join(lines[marked[0] :]).split() if marked else []
        assert " ".join(items).split() == told


def test_fill(spark):
    df = spark.createDataFrame(
        [
            ("Dear {name}, {{keep}} {missing}", {"name": "{other}", "other": "no"}),
            ("plain", {}),
            ("{a}{a}{b}", {"a": "1", "b": None}),
            ("open { and } close", {"a": "1"}),
        ],
        "t string, v map<string,string>",
    )
    rows = df.select(tx.fill_template(F.col("t"), F.col("v")), tx.missing_variables(F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in rows] == ["Dear {other}, {keep} {missing}", "plain", "11{b}", "open { and } close"]
    assert [r[1] for r in rows] == [["missing"], [], [], []]


PIECES = st.sampled_from(["{a}", "{bb}", "{c_1}", "{{", "}}", "x", " ", "€", "a", "{{a}}", "1."])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=20, max_size=40))
def test_fill_equals_format(spark, templates):
    values = {"a": "{bb}", "bb": "}}{", "c_1": "$1\\"}
    df = spark.createDataFrame([(i, t, values) for i, t in enumerate(templates)], "id int, t string, v map<string,string>")
    rows = df.select(
        "id",
        tx.fill_template(F.col("t"), F.col("v")).alias("whole"),
        F.transform(tx.template_parts(F.col("t")), lambda p: F.coalesce(F.try_element_at(F.col("v"), p["var"]), p["text"])).alias("parts"),
    ).collect()
    for row in rows:
        assert row.whole == templates[row.id].format(**values) == "".join(row.parts)


def test_literal_templates(spark):
    got = spark.range(1).select(tx.fill_literal("Hi {name}, {x}!", {"name": F.lit("A"), "x": F.lit("{y}")})).first()[0]
    assert got == "Hi A, {y}!"


def test_sentiment_replies(spark):
    replies = [
        '{"score": -0.8, "explanation": "angry"}',
        '{"explanation": "no score"}',
        '{"score": 0.4',
        "I think it is fine",
        None,
        "",
        '{"score": 0.4, "explanation": "x"} and more',
        '  {"score": 1, "explanation": null, "extra": [1]}\n',
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, r string")
    got = {r.id: r.s for r in df.select("id", tx.parse_sentiment(F.col("r")).alias("s")).collect()}
    assert (got[0].score, got[0].explanation) == (-0.8, "angry")
    assert (got[1].score, got[1].explanation) == (0.0, "no score")
    for bad in (2, 3, 4, 5, 6):
        assert got[bad].score == 0.0 and got[bad].explanation.startswith("Error analyzing sentiment")
    assert (got[7].score, got[7].explanation) == (1.0, None)
