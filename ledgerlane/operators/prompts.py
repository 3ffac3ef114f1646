"""Prompt tables: template rendering, suggestions, prompt rows per account, message or campaign.

The text model itself is the caller's: ``complete`` sends a prompt column to a
function the caller supplies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions import exprs as x
from ledgerlane.functions import text as tx
from ledgerlane.operators.skew import join_splitting_hot_keys
from ledgerlane.sources import dims
from ledgerlane.sources.files import stored_rows


def render_prompts(requests: DataFrame, templates: DataFrame, seed: int = 42) -> DataFrame:
    """Render one template per request (request_id, category, template_index, custom_variables).

    A variable takes the custom value if there is one, else an option picked by a hash
    of (seed, request, variable). The template table is joined without a hint, so Spark
    broadcasts it by its size.
    """

    def options_of(part: Column) -> Column:
        return F.get(F.filter("variables", lambda v: v["var"] == part["var"]), F.lit(0))["options"]

    # Read and cut up once per template, on the small side of the join.
    cut = templates.withColumn("parts", tx.template_parts(F.col("template"))).withColumn(
        "parts",
        F.transform(
            "parts", lambda t: F.struct(t["text"].alias("text"), t["var"].alias("var"), options_of(t).alias("options"))
        ),
    )
    names = templates.where("template_index = 0").select("category", F.col("category_name").alias("known_category"))
    found = requests.join(names, "category", "left").join(cut, ["category", "template_index"], "left")
    custom = F.coalesce("custom_variables", F.create_map().cast("map<string,string>"))

    def chosen(v: Column) -> Column:
        pick = x.hash32(str(seed), F.col("request_id"), v["var"]) % F.size(v["options"])
        return F.coalesce(F.try_element_at(custom, v["var"]), F.get(v["options"], pick.cast("int")))

    used = F.map_from_entries(
        F.transform("variables", lambda v: F.struct(v["var"].alias("key"), chosen(v).alias("value")))
    )
    filled = F.transform("parts", lambda t: F.when(t["options"].isNull(), t["text"]).otherwise(chosen(t)))
    error = F.when(F.col("known_category").isNull(), "Category not found").when(
        F.col("template").isNull(), "Template not found"
    )
    return found.select(
        "request_id",
        "category_name",
        "title",
        F.array_join(filled, "").alias("prompt"),
        used.alias("variables_used"),
        error.alias("error"),
    )


def template_usage(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Per template: its variables, the prompts it can give, and how many requests name it."""
    asked = requests.groupBy("category", "template_index").agg(F.count(F.lit(1)).alias("n_requests"))
    combinations = F.aggregate("variables", F.lit(1).cast("bigint"), lambda n, v: n * F.size(v["options"]))
    return templates.join(asked, ["category", "template_index"], "left").select(
        "category",
        "template_index",
        "title",
        F.size("variables").alias("n_variables"),
        combinations.alias("n_combinations"),
        F.coalesce("n_requests", F.lit(0)).alias("n_requests"),
    )


def template_options(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Every option of every variable of every template, and how many requests name the template."""
    asked = requests.groupBy("category", "template_index").agg(F.count(F.lit(1)).alias("n_requests"))
    variables = templates.select("category", "template_index", F.explode("variables").alias("v"))
    options = variables.select(
        "category", "template_index", F.col("v.var").alias("variable"), F.posexplode("v.options").alias("option_index", "option")
    )
    return options.join(asked, ["category", "template_index"], "left").withColumn(
        "n_requests", F.coalesce("n_requests", F.lit(0))
    )


def custom_prompts(df: DataFrame, template: str = "template", variables: str = "variables") -> DataFrame:
    """Fill a template held in each row; a placeholder without a value is an error."""
    missing = tx.missing_variables(F.col(template), F.col(variables))
    failed = F.size(missing) > 0
    return df.withColumns(
        {
            "missing": missing,
            "prompt": F.when(~failed, tx.fill_template(F.col(template), F.col(variables))),
            "error": F.when(failed, F.concat(F.lit("Missing variable: '"), F.get(missing, F.lit(0)), F.lit("'"))),
        }
    )


def suggestions(requests: DataFrame) -> DataFrame:
    """Five suggestions per request, and three more for the loan types that have some."""
    values = {"loan": F.col("loan_type"), "audience": F.col("audience"), "goal": F.col("goal")}

    def texts(items: list[str]) -> Column:
        return F.array(*[tx.fill_literal(t, values) for t in items])

    extra = F
    for word, items in dims.LOAN_SUGGESTIONS.items():
        extra = extra.when(F.contains(F.lower("loan_type"), F.lit(word)), texts(items))
    listed = F.concat(texts(dims.SUGGESTIONS), extra.otherwise(F.array().cast("array<string>")))
    return requests.select("request_id", F.posexplode(listed).alias("at", "suggestion")).select(
        "request_id", (F.col("at") + 1).alias("position"), "suggestion"
    )


def _settings(kind: str) -> list[Column]:
    return [F.lit(v).alias(name) for name, v in zip(("model", "temperature", "max_tokens"), dims.SETTINGS[kind])]


def collection_emails(accounts: DataFrame) -> DataFrame:
    """One prompt per overdue account (with ``customer``, ``email``, ``tone``, ``offer_plan``)."""
    details = F.to_json(F.struct(F.col("customer").alias("name"), "email", "loan_id"))
    amount = F.col("outstanding_amount").cast("decimal(18,2)").cast("string")
    system = F.concat_ws(
        "\n",
        F.lit("You write for the collections desk of a European lender."),
        x.lookup("collection_stage", dims.STAGE_PROMPTS, dims.DEFAULT_STAGE_PROMPT),
        F.lit("Be respectful, keep to EU debt collection rules, give next steps and a contact."),
        F.concat(F.lit("Tone: "), F.lower("tone")),
        F.when(F.col("offer_plan"), "Offer a payment plan."),
        F.concat(F.lit("Customer: "), details),
        F.concat(F.lit("Outstanding: €"), amount),
        F.concat(F.lit("Days overdue: "), F.col("days_overdue").cast("string")),
    )
    return accounts.select(
        "id",
        system.alias("system_prompt"),
        F.concat(F.lit("Write the "), "collection_stage", F.lit(" stage e-mail")).alias("user_prompt"),
        *_settings("collection"),
    )


def service_replies(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """One prompt per customer message, with the customer's profile as JSON where it is known."""
    whole = F.to_json(F.struct(*profiles.columns), {"ignoreNullFields": "false"})
    context = profiles.select("customer_id", whole.alias("context"))
    user = F.concat(
        F.coalesce(F.concat(F.lit("Customer context: "), "context"), F.lit("")),
        F.lit("\n\nCustomer message: "),
        "message",
    )
    return join_splitting_hot_keys(messages, context, "customer_id", "left", "id").select(
        "id",
        F.lit(
            "You answer customers of a European lender. Be polite and exact, respect GDPR,"
            " and offer a human colleague when you cannot help."
        ).alias("system_prompt"),
        user.alias("user_prompt"),
        *_settings("service"),
    )


def onboarding_system_prompt(customer_type: Column) -> Column:
    kind = F.when(customer_type == "individual", "an individual customer").otherwise("a business")
    return F.concat(
        F.lit("You guide "),
        kind,
        F.lit(
            " through identity checks of a European lender. For people ask for name, birth date, address, document,"
            " work and source of funds; for companies ask for registration, address, owners, activity and accounts."
            " Follow GDPR and AML rules, ask one question at a time and say why."
        ),
    )


def sentiment_prompts(messages: DataFrame) -> DataFrame:
    return messages.select(
        "id",
        F.lit(
            "Rate the feeling of the text from -1 to 1 and explain briefly."
            " Answer as JSON with the fields score and explanation."
        ).alias("system_prompt"),
        F.col("message").alias("user_prompt"),
        *_settings("sentiment"),
    )


def _prompt(kind: str, system: Column, user: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), system.alias("system_prompt"), user.alias("user_prompt"), *_settings(kind)
    )


def campaign_prompts(requests: DataFrame) -> DataFrame:
    """Marketing, content, enhancement and variation prompts for every campaign request.

    All four come from one scan: the row is exploded into its prompts.
    """
    instruction = x.lookup("enhancement_type", dims.ENHANCEMENTS, dims.ENHANCEMENTS["detailed"])
    marketing = _prompt(
        "marketing",
        F.concat(
            F.lit("You market a European lender. Write about "), "campaign_type", F.lit(" for "), "target_audience",
            F.lit(" on the "), "channel",
            F.lit(" channel. Keep to EU advertising rules, state terms clearly and end with a call to action.\n"),
            F.coalesce("instructions", F.lit("")),
        ),
        F.concat(F.lit("Write marketing content for "), "campaign_type"),
    )
    content = _prompt(
        "content",
        F.concat(
            F.lit("You write "), "content_type",
            F.lit(" for financial products: honest, persuasive, lawful in Europe, with any disclaimer needed."),
        ),
        F.col("prompt"),
    )
    enhancement = _prompt(
        "enhancement",
        F.concat(F.lit("You improve marketing prompts. "), instruction, F.lit(". Return only the better prompt.")),
        F.col("prompt"),
    )
    variation = _prompt(
        "variation",
        F.concat(
            F.lit("Write "), F.col("n_variations").cast("string"),
            F.lit(" variations of the prompt with the same aim and other angles, as a numbered list."),
        ),
        F.concat(F.lit("Base prompt: "), "prompt"),
    )
    return requests.select(
        F.col("request_id").alias("ref_id"), F.explode(F.array(marketing, content, enhancement, variation)).alias("p")
    ).select("ref_id", "p.*")


def statement_prompts(statements: DataFrame) -> DataFrame:
    """One analysis prompt per statement."""
    user = F.concat(
        F.lit("Assess this statement: "), "statement_data", F.lit("\nIndicators: "), "risk_indicators"
    )
    system = F.lit(
        "You analyse bank statements for lending. Judge income stability, spending, risk signs and cash flow;"
        " give a risk score from 1 (lowest) to 10 and a recommendation."
    )
    return statements.select(F.col("customer_id").alias("ref_id"), _prompt("statement", system, user).alias("p")).select(
        "ref_id", "p.*"
    )


def one_prompt_table(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def canned_answers(interactions: DataFrame) -> DataFrame:
    """The stock answer for each interaction whose subject is a common issue."""
    return (
        interactions.withColumn("issue", x.lookup("subject", dims.SUBJECT_ISSUE))
        .withColumn("answer", x.lookup("issue", dims.CANNED_ANSWERS))
        .where(F.col("answer").isNotNull())
    )


def complete(
    df: DataFrame,
    answer: Callable[[list[str]], list[str]],
    prompt: str = "user_prompt",
    reply: str = "reply",
    batch_size: int = 64,
) -> DataFrame:
    """Send a prompt column to ``answer``, ``batch_size`` prompts at a time.

    A call that fails leaves its error in the rows of that call and in no others.

    ``answer`` runs on the executors and must be safe to repeat, since a lost task is
    run again.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(reply, T.StringType()), T.StructField("error", T.StringType())])

    def send(batches):
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                replies, error = [None] * len(part), None
                try:
                    got = list(answer(part[prompt].tolist()))
                    if len(got) != len(part):
                        raise ValueError(f"{len(part)} prompts, {len(got)} replies")
                    replies = got
                except Exception as failure:  # the caller's function may fail in any way
                    error = str(failure)
                yield part.assign(**{reply: replies, "error": error})

    return df.mapInPandas(send, schema)


REPLIES = "prompt_sha256 string, reply string, batch string"


def stored_replies(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_sha256, reply): one reply per prompt of those kept at ``path``."""
    held = stored_rows(spark, path, REPLIES)
    if held is None:
        held = spark.createDataFrame([], REPLIES)
    return held.groupBy("prompt_sha256").agg(F.min("reply").alias("reply"))


def complete_once(
    df: DataFrame,
    answer: Callable[[list[str]], list[str]],
    path: str,
    prompt: str = "user_prompt",
    reply: str = "reply",
    batch_size: int = 64,
    parts: int = 16,
) -> DataFrame:
    """Send each different prompt once and keep its reply at ``path``; rows get the reply of their prompt.

    Prompts that have a reply there are not sent, so a run that was lost half way goes on and a rerun sends nothing.
    The rest is sent in ``parts`` by hash of the prompt, each written before the next is sent: a lost task repeats
    calls of its own part only, and its output counts once. A call that fails keeps nothing, so its prompts are sent by
    the next run; until then their rows have a null reply. Null prompts are not sent. The join splits prompts that many
    rows share. Only digests and replies are stored.
    """
    if reply in df.columns or "prompt_sha256" in df.columns:
        raise ValueError(f"the rows have a column {reply!r} or 'prompt_sha256' already")
    spark = df.sparkSession
    keyed = df.withColumn("prompt_sha256", F.sha2(F.col(prompt), 256))
    wanted = keyed.where(F.col(prompt).isNotNull()).groupBy("prompt_sha256").agg(F.min(prompt).alias(prompt))
    part = F.pmod(F.xxhash64("prompt_sha256"), F.lit(parts))
    for n in range(parts):
        # what earlier parts have written holds none of these prompts
        new = wanted.where(part == n).join(stored_replies(spark, path), "prompt_sha256", "left_anti")
        if new.isEmpty():
            continue
        sent = complete(new, answer, prompt, "reply", batch_size).where("error IS NULL")
        sent.select("prompt_sha256", "reply", F.lit(str(n)).alias("batch")).write.mode("append").parquet(path)
    # a prompt that many rows share is one row on the right; the facts are cut into pieces by their own hash
    spread = keyed.withColumn("__spread", F.xxhash64(*df.columns))
    replies = stored_replies(spark, path).withColumnRenamed("reply", reply)
    joined = join_splitting_hot_keys(spread, replies, "prompt_sha256", "left", "__spread")
    return joined.select(*df.columns, reply)
