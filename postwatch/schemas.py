"""Fixed schemas of the tables and payloads, and empty tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType, TimestampType

USER_KEY = ["email", "position", "location"]
LEDGER_KEY = ["email", "job_url", "position", "location"]
SEARCH_KEY = ["position", "location"]

_TYPES = {
    "string": StringType(),
    "boolean": BooleanType(),
    "int": IntegerType(),
    "long": LongType(),
    "strings": ArrayType(StringType()),
    "timestamp": TimestampType(),
}


def _struct(fields: str) -> StructType:
    """``name type, ...``; a type ending in "!" does not allow NULL. Needs no session, unlike a DDL string."""
    built = StructType()
    for field in fields.split(","):
        name, kind = field.split()
        built.add(name, _TYPES[kind.rstrip("!")], not kind.endswith("!"))
    return built


USERS = _struct(
    "id string!, email string!, position string!, location string!, job_type string!, "
    "is_new boolean!, is_confirmed boolean!, confirmation_token string"
)
SKILLS = _struct("id int!, user_id string!, skill string!")
EXPERIENCES = _struct("id int!, user_id string!, experience string!")
EDUCATIONS = _struct("id int!, user_id string!, education string!")
LEDGER = _struct("email string!, job_url string!, position string!, location string!")
OUTBOX = _struct(
    "user_id string, email string, position string, location string, subject string, body string, n_jobs int"
)
POSTINGS = _struct(
    "position string, location string, pos long, title string, company string, job_location string, "
    "link string, date_posted string, employment_type string, description string"
)
PAGES = _struct("url string, html string")
RESPONSES = _struct("position string, location string, run string, arrived timestamp, body string")
DAILY_COUNTS = _struct(
    "n_scored long, n_passed long, n_below_threshold long, n_unscored long, n_error long, n_delivered long, n_digests long"
)
TRIAGE_COUNTS = _struct("n_before long, n_new long, n_processed_total long, n_queue long, n_remaining long")
REJECTS = _struct("source string, row_key string, reject_reason string")

# One change request; the three kinds share a schema, each reads only its own fields.
CHANGE_BODY = _struct(
    "email string, position string, location string, jobType string, token string, "
    "skills strings, experience strings, education strings, _malformed string"
)
CHANGE_FEED = _struct("seq long, kind string, body string")

TABLES = {
    "users": USERS,
    "skills": SKILLS,
    "experiences": EXPERIENCES,
    "educations": EDUCATIONS,
    "sent_email": LEDGER,
}


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def create_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """All live tables, empty."""
    return {name: empty(spark, schema) for name, schema in TABLES.items()}
