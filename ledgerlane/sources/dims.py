"""Small fixed tables: stages, templates and their options, canned answers, prompt wording.

Keys, numbers and counts are fixed values; the prose is our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stage -> (name, actions).
STAGE_ACTIONS = {
    "early": ("Early Stage (15-30 days)", ["Friendly reminder", "Payment plan offer", "Account review"]),
    "mid": ("Mid Stage (31-60 days)", ["Formal notice", "Payment arrangement", "Account restriction"]),
    "late": ("Late Stage (61-90 days)", ["Final notice", "Settlement offer", "Pre-legal warning"]),
    "legal": ("Legal Stage (90+ days)", ["Legal notice", "Debt collection agency", "Court proceedings"]),
}

STAGE_PROMPTS = {
    "early": "Write a kind reminder for an account that is 15-30 days late",
    "mid": "Write a formal e-mail for an account that is 31-60 days late",
    "late": "Write a firm, businesslike e-mail for an account that is more than 60 days late",
    "legal": "Write the last notice before legal steps on a severely late account",
}
DEFAULT_STAGE_PROMPT = "Write a collection e-mail"

# The issues, and the 4.9% in the answer on rates.
CANNED_ANSWERS = {
    "Loan Application Status": "We are reviewing your application and expect to decide within 2-3 business days.",
    "Payment Schedule": "Change your payment schedule in your account, or ask our support team to do it.",
    "Interest Rates": "Rates depend on the loan and on your credit; personal loans start at 4.9% APR.",
    "Account Access": "Please reset your password; if that fails, our technical support will help.",
    "Document Upload": "Upload documents in your account or send them to our documents mailbox.",
}
# Subject of an interaction -> the common issue that answers it.
SUBJECT_ISSUE = {
    "Loan application inquiry": "Loan Application Status",
    "Payment schedule question": "Payment Schedule",
    "Interest rate information": "Interest Rates",
    "Account access issue": "Account Access",
    "Document upload help": "Document Upload",
}

# What a caller may ask suggestions for.
LOAN_TYPES = ["personal loans", "business loans", "mortgages", "credit cards", "auto loans"]
AUDIENCES = [
    "young professionals",
    "small business owners",
    "first-time buyers",
    "families",
    "students",
    "retirees",
]
GOALS = [
    "increase applications",
    "build awareness",
    "drive conversions",
    "educate customers",
    "promote features",
]

# {loan}, {audience} and {goal} are filled per request.
SUGGESTIONS = [
    "Plan a {loan} campaign that speaks to {audience} and aims to {goal}",
    "Draft a series of e-mails on {loan} for {audience} in order to {goal}",
    "Prepare social posts about {loan} that {audience} will share, to {goal}",
    "Lay out a landing page on {loan} that leads {audience} to {goal}",
    "Explain {loan} to {audience} in plain words so that we {goal}",
]
# The first word found in the loan type adds its three suggestions.
LOAN_SUGGESTIONS = {
    "personal": [
        "Point {audience} to fair rates and a fast decision",
        "Show {audience} that terms bend and prices are plain",
        "Tie the loan to plans and milestones of {audience}",
    ],
    "business": [
        "Show {audience} how funding lets them grow",
        "Offer {audience} our knowledge of their trade",
        "Help {audience} with cash flow and equipment",
    ],
    "mortgage": [
        "Picture the first home of {audience}",
        "Compare the savings of refinancing for {audience}",
        "Teach {audience} about the local market",
    ],
}

# category -> (name, description, [(title, template)])
# The category keys and the placeholders.
TEMPLATES = {
    "personal_loans": (
        "Personal Loans",
        "Campaign prompts for personal loans",
        [
            (
                "Rate first",
                "Write a {tone} {content_type} on personal loans for {audience}. Open with rates from {rate}%, then"
                " mention {benefit1} and {benefit2}. Close by inviting readers to {cta_action}.",
            ),
            (
                "Fast decision",
                "Prepare a {content_type} on our {approval_time} decision for {target_group}. Lead with {key_feature},"
                " say that customers can {action_benefit}, keep the voice {tone} and add {social_proof}.",
            ),
        ],
    ),
    "business_loans": (
        "Business Loans",
        "Campaign prompts for business loans",
        [
            (
                "Room to grow",
                "Prepare a {content_format} for {business_type} that want to {growth_goal}. Present {loan_feature} and"
                " {competitive_advantage}; state funding of {loan_amount} with {repayment_terms}.",
            ),
            (
                "One industry",
                "Prepare a {marketing_piece} for {industry} firms about {loan_type}. Start from {industry_challenge},"
                " show how {solution_approach} lets them {outcome}, and back it with {credibility_element}.",
            ),
        ],
    ),
    "mortgage_loans": (
        "Mortgage Loans",
        "Campaign prompts for home loans",
        [
            (
                "First home",
                "Prepare a {content_type} for first-time buyers on our {mortgage_program} with a {down_payment} down"
                " payment. Offer {support_feature} and {educational_resource}; be {emotional_tone} about"
                " {buyer_concern}.",
            ),
            (
                "Refinance",
                "Prepare a {campaign_type} on refinancing for owners with {current_situation}. Show {savings_benefit}"
                " through {refinance_feature}, mention {urgency_element} and end on {next_step}.",
            ),
        ],
    ),
    "credit_cards": (
        "Credit Cards",
        "Campaign prompts for credit cards",
        [
            (
                "Rewards",
                "Prepare a {marketing_format} for a {card_type} card that pays {rewards_structure}. Speak to"
                " {customer_segment} about {key_benefit} and {additional_perk}, offer {promotional_offer} and sound"
                " {brand_voice}.",
            ),
        ],
    ),
    "general_lending": (
        "General Lending",
        "Prompts across products",
        [
            (
                "Trust",
                "Prepare a {content_piece} that presents us as a {institution_type} with {years_experience} years"
                " behind it. Show {trust_factor} and {customer_commitment}, add {social_proof} and place us as"
                " {market_position}.",
            ),
            (
                "Digital service",
                "Prepare a {digital_content} on our {technology_feature} and how it {customer_benefit}. Address"
                " {tech_audience}, stress {innovation_aspect} with {security_message} and show {user_experience}.",
            ),
        ],
    ),
}

# Variables that mean the same kind of thing draw from one list of five options.
OPTION_POOLS = [
    (["tone", "emotional_tone", "brand_voice"], ["calm", "warm", "direct", "upbeat", "formal"]),
    (
        ["content_type", "content_format", "marketing_piece", "campaign_type", "marketing_format", "content_piece",
         "digital_content"],
        ["newsletter", "web page", "short film", "poster", "press text"],
    ),
    (
        ["audience", "target_group", "customer_segment", "tech_audience", "business_type"],
        ["new graduates", "shop owners", "freelancers", "parents", "commuters"],
    ),
    (["rate", "down_payment"], ["3.5", "4", "4.5", "5", "5.5"]),
    (["approval_time"], ["two-day", "same-day", "one-week", "48-hour", "overnight"]),
    (["years_experience"], ["two", "ten", "twenty", "thirty", "forty"]),
    (["loan_amount"], ["€5,000", "€20,000", "€80,000", "€300,000", "€1,000,000"]),
    (
        ["benefit1", "key_feature", "loan_feature", "support_feature", "refinance_feature", "technology_feature",
         "key_benefit"],
        ["a paperless form", "a named adviser", "a fixed instalment", "an early answer", "a free repayment break"],
    ),
    (
        ["benefit2", "competitive_advantage", "credibility_element", "trust_factor", "additional_perk",
         "innovation_aspect"],
        ["clear prices", "local branches", "long opening hours", "audited books", "a complaints desk"],
    ),
    (
        ["cta_action", "action_benefit", "growth_goal", "outcome", "customer_benefit"],
        ["apply by phone", "plan ahead", "hire staff", "cut costs", "open a second site"],
    ),
    (["social_proof"], ["reviews by neighbours", "a test award", "stories of borrowers", "press notes", "a user vote"]),
    (["market_position"], ["a regional lender", "a test winner", "an online bank", "a pioneer", "a family bank"]),
    (
        ["repayment_terms", "savings_benefit", "promotional_offer", "rewards_structure"],
        ["a lower instalment", "a month free", "one percent back", "no closing fee", "a shorter term"],
    ),
    (["industry", "card_type", "institution_type"], ["farming", "travel", "craft", "retail", "health"]),
    (["loan_type", "mortgage_program"], ["bridge credit", "stock finance", "a starter loan", "a green loan", "leasing"]),
    (
        ["industry_challenge", "buyer_concern", "current_situation", "urgency_element"],
        ["rising rates", "a slow season", "new rules", "old machines", "thin reserves"],
    ),
    (
        ["solution_approach", "customer_commitment", "security_message"],
        ["open talks", "strict privacy", "a second check", "plain contracts", "steady contact"],
    ),
    (
        ["educational_resource", "next_step", "user_experience"],
        ["a checklist", "a calculator", "a video call", "a walk-through", "a test account"],
    ),
]

# Model, temperature and reply length per kind of prompt.
SETTINGS = {
    "onboarding": ("gpt-4", 0.7, 500),
    "statement": ("gpt-4", 0.3, 800),
    "marketing": ("gpt-4", 0.8, 600),
    "service": ("gpt-4", 0.7, 500),
    "collection": ("gpt-4", 0.6, 600),
    "sentiment": ("gpt-3.5-turbo", 0.3, 200),
    "content": ("gpt-4", 0.7, 1000),
    "enhancement": ("gpt-4", 0.6, 500),
    "variation": ("gpt-4", 0.8, 800),
}

ENHANCEMENTS = {
    "detailed": "Add detail, context and exact requirements to the prompt",
    "creative": "Give the prompt a story, feeling and an unusual angle",
    "compliance": "Add what European rules on financial advertising require to the prompt",
    "conversion": "Turn the prompt towards action and results that can be measured",
}

OPTIONS = {variable: options for variables, options in OPTION_POOLS for variable in variables}

TEMPLATE_SCHEMA = (
    "category string, category_name string, description string, template_index int, title string, template string,"
    " variables array<struct<var: string, options: array<string>>>"
)


def placeholders(template: str) -> list[str]:
    """Names in braces, in order of first use."""
    return list(dict.fromkeys(part.split("}")[0] for part in template.split("{")[1:]))


def template_rows() -> list[tuple]:
    return [
        (category, name, description, index, title, text, [(v, OPTIONS[v]) for v in placeholders(text)])
        for category, (name, description, templates) in TEMPLATES.items()
        for index, (title, text) in enumerate(templates)
    ]


def template_table(spark: SparkSession) -> DataFrame:
    """The nine built-in templates with their options. A caller may pass any table of this shape."""
    return spark.createDataFrame(template_rows(), TEMPLATE_SCHEMA)
