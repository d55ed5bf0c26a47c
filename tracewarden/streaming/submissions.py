"""The life of a submission as a state machine over its events, for bounded tables and for streams.

A submission is made (PENDING), audited (AUDITING) and then COMPLETE or REJECTED; an ERROR while it is PENDING or AUDITING makes it REJECTED.
Events count in the order of (ts, seq, event).  One that its state doesn't allow is refused and changes nothing, so
nothing leaves COMPLETE or REJECTED and a repeated event does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracewarden.session import ship
from tracewarden.streaming.inorder import InOrder, folded

#: What each event makes of the states that allow it; null is a submission that isn't there yet.
MOVES: dict[str, dict[str | None, str]] = {
    "PENDING": {None: "PENDING"},
    "AUDITING": {"PENDING": "AUDITING"},
    "COMPLETE": {"AUDITING": "COMPLETE"},
    "REJECTED": {"AUDITING": "REJECTED"},
    "ERROR": {"PENDING": "REJECTED", "AUDITING": "REJECTED"},
}


def _ord() -> Column:
    return F.struct("ts", "seq", "event")


def current(events: DataFrame) -> DataFrame:
    """(submission_id, status, accepted, refused) from events (submission_id, event, ts, seq); status is null where nothing was ever accepted.

    No state can come back, so a state is entered by the first event that allows it after its predecessor was: three rounds of
    smallest events, combined before they are shuffled, however many events a submission has.  Events without a time or of
    another kind are refused; rows without a submission are left out; an empty table gives none.
    """
    rows = events.where("submission_id is not null").select("submission_id", "event", "ts", "seq")
    known = F.col("ts").isNotNull()
    first = lambda when: F.min(F.when(known & when, _ord()))
    made = rows.groupBy("submission_id").agg(first(F.col("event") == "PENDING").alias("made"), F.count(F.lit(1)).alias("all"))
    after = rows.join(made, "submission_id").where(_ord() > F.col("made"))
    begun = after.groupBy("submission_id").agg(first(F.col("event") == "AUDITING").alias("begun"), first(F.col("event") == "ERROR").alias("broken"))
    after = rows.join(begun, "submission_id").where(_ord() > F.col("begun"))
    ended = after.groupBy("submission_id").agg(first(F.col("event").isin("COMPLETE", "REJECTED")).alias("ended"))
    all_ = made.join(begun, "submission_id", "left").join(ended, "submission_id", "left")
    broken = F.col("broken").isNotNull()
    # an error ends what has not ended before it
    by_error = broken & (F.col("ended").isNull() | (F.col("broken") < F.col("ended")))
    audited = F.col("begun").isNotNull() & (~by_error | (F.col("begun") < F.col("broken")))
    ends = by_error | (audited & F.col("ended").isNotNull())
    status = F.when(by_error, "REJECTED").when(audited & F.col("ended").isNotNull(), F.col("ended.event")).when(audited, "AUDITING").when(F.col("made").isNotNull(), "PENDING")
    accepted = F.col("made").isNotNull().cast("long") + F.coalesce(audited, F.lit(False)).cast("long") + F.coalesce(ends, F.lit(False)).cast("long")
    return all_.select("submission_id", status.alias("status"), accepted.alias("accepted"), (F.col("all") - accepted).alias("refused"))


class _Life(InOrder):
    """Carries (status, accepted, refused); emits what each event has made of a submission."""

    STATE = "status string, accepted long, refused long"

    def step(self, key: tuple, state: tuple | None, us: int, order: str) -> tuple[tuple | None, list[Row]]:
        status, accepted, refused = state or (None, 0, 0)
        seq, _, event = order.partition(" ")
        to = MOVES.get(event, {}).get(status)
        state = (status, accepted, refused + 1) if to is None else (to, accepted + 1, refused)
        return state, [Row(submission_id=key[0], us=us, seq=int(seq) - (1 << 62), event=event, before=status, status=state[0], accepted=to is not None)]


def transitions(events: DataFrame, late: str) -> DataFrame:
    """A stream of (submission_id, ts, seq, event, before, status, accepted): what each event was, and made of its submission, in order.

    Events may come up to ``late`` out of order.  The state of a submission is three values, for as long as the stream lasts.
    """
    ship(events.sparkSession)
    kind = events.schema["submission_id"].dataType.simpleString()
    # numbers as texts that sort as they do
    order = F.concat_ws(" ", F.lpad((F.col("seq").cast("long") + (1 << 62)).cast("string"), 19, "0"), F.coalesce("event", F.lit("")))
    rows = events.where("submission_id is not null")
    out = folded(rows, "submission_id", late, order, _Life(), f"submission_id {kind}, us long, seq long, event string, before string, status string, accepted boolean")
    return out.select("submission_id", F.timestamp_micros("us").alias("ts"), "seq", "event", "before", "status", "accepted")
