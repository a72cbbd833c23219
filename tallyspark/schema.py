"""Schemas and fixed values of the ledger data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LEDGER_SCHEMA = T.StructType([
    T.StructField("tx_id", T.StringType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("t_type", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("amount", MONEY, True),
    T.StructField("tx_date", T.DateType(), True),
    T.StructField("note", T.StringType(), True),
])

USERS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("role", T.StringType(), True),
    T.StructField("household_id", T.LongType(), True),
])

HOUSEHOLDS_SCHEMA = T.StructType([
    T.StructField("household_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
])

# Raw text row as it arrives from CSV / JSON / a form: every field is text.
RAW_TX_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("amount", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("note", T.StringType(), True),
])

# ---- Fixed values that must equal the reference's for equal results ----
INCOME = "income"
EXPENSE = "expense"
TX_TYPES = ["income", "expense"]
ROLES = ["admin", "user"]
DEFAULT_ROLE = "user"
UNCATEGORIZED_FILL = "Uncategorized"       # fill for a missing category in reports
UNCATEGORIZED_RESOLVED = "uncategorized"   # last resort when resolving a typed category
SAVINGS_TARGET = 5000
WEEKLY_ALERT_FACTOR = 1.3
TREND_MONTHS = 3
DOMINANCE_SHARE = 0.8
UNDERREPRESENTED_SHARE = 0.05
USERNAME_PATTERN = "^[A-Za-z0-9_]{3,20}$"
HOUSEHOLD_NAME_MAX = 30
AUDIT_NOTE_MAX = 50
UTILITY_WORDS = ["electricity", "utility", "bill"]
SENSITIVE_NAME_PARTS = ["name", "account"]
ADVICE_MIN_ROWS = 10

# ---- Fixed values: Spark ML's default English stop words (H12), in its order ----
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
