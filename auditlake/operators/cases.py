"""Case state as a fold over an append-only event table.

Events carry (provider_id, seq, event_date, kind, stage, field, value): ``kind`` is ``stage`` for a
stage change and ``mark`` for a date entered by hand.  The fold is one aggregation, so a case with
very many events is combined map-side like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import dollars
from auditlake.params import Params

# ---- fixed values: stages, the status each one sets, and the date fields ----
INITIAL, REVIEW, HEARING, CLOSED = "Initial Action", "Full Audit Review", "Board Hearing", "Closed"
STAGES = (INITIAL, REVIEW, HEARING, CLOSED)
STATUS_OF = {
    INITIAL: "preliminary_review", REVIEW: "records_requested", HEARING: "hsarb_referred", CLOSED: "closed",
}
DATE_FIELDS = (
    "review_request_date", "records_requested_date", "ack_due_date", "ack_received_date",
    "findings_date", "gm_opinion_date",
)
LETTER_KINDS = ("records_request", "billing_education", "gm_opinion", "review_complete")
# ---- end of fixed values ----


def checked_events(events: DataFrame) -> DataFrame:
    """Events ready to append; an unknown stage or date field fails the write."""
    valid = ((F.col("kind") == "stage") & F.col("stage").isin(*STAGES)) | (
        (F.col("kind") == "mark") & F.col("field").isin(*DATE_FIELDS)
    )
    failure = F.raise_error(F.concat_ws(" ", F.lit("bad case event:"), "kind", "stage", "field"))
    return events.withColumn("kind", F.when(valid, F.col("kind")).otherwise(failure.cast("string")))


def _status(stage: Column) -> Column:
    named = F.lit(None).cast("string")
    for name, status in STATUS_OF.items():
        named = F.when(stage == name, status).otherwise(named)
    return named


def case_states(events: DataFrame, params: Params) -> DataFrame:
    """Current state of every case that has events.

    The first review request sets the request date, the acknowledgement deadline and the status,
    unless a request date was entered before it; a hearing sets the opinion date if none is known.
    """
    is_stage, is_mark = F.col("kind") == "stage", F.col("kind") == "mark"
    at = F.struct("seq", "event_date")
    marks = {f: F.max(F.when(is_mark & (F.col("field") == f), F.struct("seq", "value"))) for f in DATE_FIELDS}
    first_request_mark = F.min(F.when(is_mark & (F.col("field") == "records_requested_date"), F.col("seq")))
    folded = events.groupBy("provider_id").agg(
        F.max(F.when(is_stage, F.struct("seq", "stage"))).alias("last"),
        F.max(F.when(is_stage & (F.col("stage") != REVIEW), F.struct("seq", "stage"))).alias("last_other"),
        F.min(F.when(is_stage & (F.col("stage") == REVIEW), at)).alias("review"),
        F.min(F.when(is_stage & (F.col("stage") == HEARING), at)).alias("hearing"),
        first_request_mark.alias("request_mark"),
        F.max("event_date").alias("updated"),
        *[m.alias(f"mark_{f}") for f, m in marks.items()],
    )
    opens = F.col("review").isNotNull() & (
        F.col("request_mark").isNull() | (F.col("review.seq") < F.col("request_mark"))
    )
    due = F.date_add("review.event_date", params.ack_days)
    due_mark = F.col("mark_ack_due_date")
    due_by_review = opens & (due_mark.isNull() | (due_mark["seq"] < F.col("review.seq")))
    review_set_status = opens & (
        F.col("last_other").isNull() | (F.col("review.seq") > F.col("last_other.seq"))
    )
    marked = {f: F.col(f"mark_{f}")["value"] for f in DATE_FIELDS}
    return folded.select(
        "provider_id",
        F.coalesce("last.stage", F.lit(INITIAL)).alias("stage"),
        F.when(review_set_status, STATUS_OF[REVIEW])
        .otherwise(F.coalesce(_status(F.col("last_other.stage")), F.lit(STATUS_OF[INITIAL])))
        .alias("status"),
        marked["review_request_date"].alias("review_request_date"),
        F.coalesce(marked["records_requested_date"], F.when(opens, F.col("review.event_date"))).alias(
            "records_requested_date"
        ),
        F.when(due_by_review, due).otherwise(marked["ack_due_date"]).alias("ack_due_date"),
        marked["ack_received_date"].alias("ack_received_date"),
        marked["findings_date"].alias("findings_date"),
        F.coalesce(marked["gm_opinion_date"], F.col("hearing.event_date")).alias("gm_opinion_date"),
        F.col("updated").alias("updated_date"),
    )


def with_default_cases(providers: DataFrame, states: DataFrame) -> DataFrame:
    """One case per provider; one without events is in its initial stage."""
    return providers.select("provider_id").join(states, "provider_id", "left").fillna(
        {"stage": INITIAL, "status": STATUS_OF[INITIAL]}
    )


def overdue_cases(states: DataFrame, as_of: Column) -> DataFrame:
    """Cases whose acknowledgement deadline passed without an answer."""
    return states.where(F.col("ack_received_date").isNull() & (F.col("ack_due_date") < as_of))


def correspondence(log: DataFrame, provider_id: object | None = None) -> DataFrame:
    """Letters and notes, newest first."""
    rows = log if provider_id is None else log.where(F.col("provider_id") == F.lit(provider_id))
    return rows.orderBy(F.col("seq").desc())


def letters(cases: DataFrame, recovery: DataFrame, kind: str, as_of: Column, params: Params) -> DataFrame:
    """One letter per case, in the wording of this package."""
    if kind not in LETTER_KINDS:
        raise ValueError(f"kind must be one of {LETTER_KINDS}, got {kind!r}")
    found = recovery.select(
        "provider_id", "specialty", "concerns", "statutory_recoverable", "figure_status"
    )
    concerns = F.concat(F.lit("- "), F.replace(F.coalesce("concerns", F.lit("see the case file")), F.lit("; "), F.lit("\n- ")))
    due = F.coalesce("ack_due_date", F.date_add(as_of, params.ack_days)).cast("string")
    head = F.concat(
        F.lit("Date: "), as_of.cast("string"), F.lit("\nProvider: "), F.col("provider_id").cast("string"),
        F.lit(" ("), F.coalesce("specialty", F.lit("")), F.lit(")\nStage: "), F.col("stage"), F.lit("\n\n"),
    )
    indicative = F.when(
        F.coalesce("figure_status", F.lit("INDICATIVE")) == "DEFENSIBLE", F.lit("")
    ).otherwise(F.lit("The amount is indicative and not a final determination.\n"))
    body = {
        "records_request": F.concat(
            F.lit("Your records are requested for a review that has reached no conclusion. Points under review:\n"),
            concerns, F.lit("\nPlease confirm by "), due, F.lit(f" (within {params.ack_days} days)."),
        ),
        "billing_education": F.concat(
            F.lit("For your future claims we point out these patterns:\n"), concerns, F.lit("\nNo repayment is sought."),
        ),
        "gm_opinion": F.concat(
            F.lit("An opinion has been formed on these points:\n"), concerns, F.lit("\nAmount at issue: "),
            dollars(F.coalesce("statutory_recoverable", F.lit(0.0)), 0), F.lit(".\n"), indicative,
        ),
        "review_complete": F.lit("The review is complete and no further action will be taken."),
    }[kind]
    return cases.join(found, "provider_id", "left").select(
        "provider_id", F.lit(kind).alias("kind"), F.concat(head, body).alias("letter")
    )
