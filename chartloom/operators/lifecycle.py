"""Draft-to-case life-cycle over sets of intakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import config as c
from chartloom.functions.ids import case_id_of, case_key, valid_intake_id
from chartloom.functions.text import initials
from chartloom.functions.variants import at, is_object
from chartloom.operators.staging import evaluate_once, join_splittable


def is_expired(created_at: Column, as_of: Column, ttl_hours: int) -> Column:
    """Strictly older than the time to live."""
    return as_of > created_at + F.make_dt_interval(hours=F.lit(ttl_hours))


def expired_drafts(drafts: DataFrame, as_of: Column, ttl_hours: int) -> DataFrame:
    return drafts.where(is_expired(F.col("created_at"), as_of, ttl_hours))


def first_requests(requests: DataFrame, key: str, at_column: str) -> DataFrame:
    """Idempotent confirm: repeats of a request collapse to the earliest one, map-side first."""
    return requests.groupBy(key).agg(F.min(at_column).alias(at_column), F.count("*").alias("n_requests"))


def confirm_outcome(
    requests: DataFrame, drafts: DataFrame, cases: DataFrame, key: str,
    requested_at: str = "requested_at", ttl_hours: int = 24,
) -> DataFrame:
    """Answer every confirm request.

    ``drafts`` (key, created_at, manifest_ok) and ``cases`` (key) hold one row per
    key.  A stored draft decides first; without one an existing case answers the
    same way as the first time, and anything else is unknown.
    """
    d = drafts.select(key, "created_at", "manifest_ok", F.lit(True).alias("_draft"))
    k = cases.select(key, F.lit(True).alias("_case"))
    usable = ~is_expired(F.col("created_at"), F.col(requested_at), ttl_hours) & F.col("manifest_ok")
    outcome = (
        F.when(F.col("_draft"), F.when(usable, "confirmed").otherwise("invalid_or_expired"))
        .when(F.col("_case"), "already_confirmed")
        .otherwise("not_found")
    )
    return (
        join_splittable(join_splittable(requests, d, [key], "left"), k, [key], "left")
        .select(*requests.columns, outcome.alias("outcome"))
    )


def route_confirms(requests: DataFrame, drafts: DataFrame, cases: DataFrame, requested_at: str = "requested_at", ttl_hours: int = 24) -> DataFrame:
    """Answer every confirm request (intake_id, …) in one pass, with the reason.

    ``invalid_id``, ``not_found``, ``already_confirmed``, ``undecodable`` (the stored draft is no JSON object), ``invalid_or_expired``
    and ``confirmed``.  ``drafts`` (intake_id, created_at, analysis, manifest_ok) and ``cases`` (case_id) hold one row per id.
    Only flags travel through the joins.
    """
    flags = drafts.select(
        "intake_id", "created_at", "manifest_ok", F.coalesce(is_object(F.col("analysis")), F.lit(False)).alias("_readable"), F.lit(True).alias("_draft")
    )
    stored = cases.select(F.concat(F.lit("intake-"), F.substring_index("case_id", "case-", -1)).alias("intake_id"), F.lit(True).alias("_case"))
    usable = ~is_expired(F.col("created_at"), F.col(requested_at), ttl_hours) & F.col("manifest_ok")
    outcome = (
        F.when(~valid_intake_id(F.col("intake_id")), "invalid_id")
        .when(F.col("_draft") & ~F.col("_readable"), "undecodable")
        .when(F.col("_draft"), F.when(usable, "confirmed").otherwise("invalid_or_expired"))
        .when(F.col("_case"), "already_confirmed")
        .otherwise("not_found")
    )
    both = join_splittable(join_splittable(requests, flags, ["intake_id"], "left"), stored, ["intake_id"], "left")
    return both.select(*requests.columns, F.when(F.col("intake_id").isNull(), "invalid_id").otherwise(outcome).alias("outcome"))


def draft_states(
    drafts: DataFrame, requests: DataFrame, key: str, as_of: Column, ttl_hours: int = 24
) -> DataFrame:
    """State of every draft at a moment: open, confirmed, discarded or expired.

    ``requests`` (key, requested_at, action) are confirms and discards in any
    order and number.  The first one that reaches the draft in its time to live
    decides.  Requests join one draft row each and reduce map-side.
    """
    end = F.col("created_at") + F.make_dt_interval(hours=F.lit(ttl_hours))
    asked = join_splittable(requests, drafts.select(key, "created_at"), [key], "inner").where(
        (F.col("requested_at") >= F.col("created_at")) & (F.col("requested_at") <= end)
        & (F.col("requested_at") <= as_of)
    )
    first = asked.groupBy(key).agg(*[
        F.min(F.when(F.col("action") == action, F.col("requested_at"))).alias(f"_{action}")
        for action in ("confirm", "discard")
    ])
    state = (
        F.when(F.col("_confirm") <= F.coalesce(F.col("_discard"), F.col("_confirm")), "confirmed")
        .when(F.col("_discard").isNotNull(), "discarded")
        .when(as_of > end, "expired")
        .otherwise("open")
    )
    return drafts.join(first, key, "left").select(*drafts.columns, state.alias("state"))


def committed_cases(prefixes: DataFrame, documents: DataFrame) -> DataFrame:
    """Committed cases in no order.

    A prefix without a readable marker document is skipped.
    """
    named = documents.select(
        "case_id", F.col("analysis").isNotNull().alias("_readable"),
        F.coalesce(at(F.col("analysis"), "patient.full_name", "string"), F.lit("")).alias("patient_name"),
    )
    # Only the name travels through the join, never the document.
    readable = evaluate_once(named).where("_readable").drop("_readable")
    # The sort samples its input first; a join that ends in shuffle files keeps the
    # parsing from running a second time for that.
    return prefixes.join(readable.hint("merge"), "case_id").select(
        "case_id", "patient_name",
        case_key(F.col("case_id"), F.lit(c.MARKER_NAME)).alias("analysis_key"),
    )


def case_listing(prefixes: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Committed cases, newest first.

    ``limit`` asks for the newest rows of the whole set, taken after the sort.
    """
    listed = committed_cases(prefixes, documents).orderBy(F.desc("case_id"))
    return listed.limit(limit) if limit is not None else listed


def latest_per_case(rows: DataFrame, order: tuple[str, ...] = ("committed_at",)) -> DataFrame:
    """Latest version of each case; versions are reduced map-side before the shuffle."""
    payload = [name for name in rows.columns if name != "case_id"]
    newest = rows.groupBy("case_id").agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_row"))
    return newest.select("case_id", *[F.col(f"_row.{name}").alias(name) for name in payload])


def upsert_cases(current: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("committed_at",)) -> DataFrame:
    return latest_per_case(current.unionByName(incoming, allowMissingColumns=True), order)


def remove_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    return cases.join(ids.select("case_id"), "case_id", "left_anti")


def erased_objects(files: DataFrame, cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects that go with each erased case, its marker included; none at all means not found."""
    wanted = ids.select("case_id").distinct()
    per_case = (
        join_splittable(files, wanted, ["case_id"], "left_semi").groupBy("case_id").agg(F.count("*").alias("_files"))
    )
    marker = cases.select("case_id", F.lit(1).alias("_marker"))
    total = F.coalesce(F.col("_files"), F.lit(0)) + F.coalesce(F.col("_marker"), F.lit(0))
    return (
        wanted.join(per_case, "case_id", "left").join(marker, "case_id", "left")
        .select(
            "case_id", total.cast("bigint").alias("deleted_objects"),
            F.when(total > 0, "deleted").otherwise("not_found").alias("outcome"),
        )
    )


def erase_order(files: DataFrame, cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Keys to delete with the step they belong to: files first, the marker last."""
    wanted = ids.select("case_id").distinct()
    marker = cases.join(wanted, "case_id", "left_semi").select(
        "case_id", case_key(F.col("case_id"), F.lit(c.MARKER_NAME)).alias("key"), F.lit(2).alias("step")
    )
    content = join_splittable(files, wanted, ["case_id"], "left_semi").select("case_id", "key", F.lit(1).alias("step"))
    return content.unionByName(marker)


def discard_keys(drafts: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """Keys removed with discarded drafts: own-prefix files and the draft marker; absent drafts give none."""
    found = drafts.join(ids.select("intake_id").distinct(), "intake_id", "left_semi").select("intake_id")
    own = join_splittable(files, found, ["intake_id"], "left_semi").where(
        F.col("key").startswith(F.concat(F.lit("drafts/"), F.col("intake_id"), F.lit("/")))
    ).select("intake_id", "key")
    marker = found.select(
        "intake_id",
        F.concat(F.lit("drafts/"), F.col("intake_id"), F.lit("/"), F.lit(c.DRAFT_MARKER_NAME)).alias("key"),
    )
    return own.unionByName(marker)


def board(saved: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Case board: saved cases in display form, followed by sample rows with aligned columns."""
    rows = saved.select(
        initials(F.col("patient_name")).alias("initials"),
        F.col("patient_name").alias("patient"),
        F.lit(c.REPORT_DONE).alias("report"), F.lit(c.REVIEW_PENDING).alias("review"),
        F.lit("success").alias("tone"), F.lit(True).alias("saved"), "case_id",
    )
    return rows if samples is None else rows.unionByName(samples, allowMissingColumns=True)


def promote(drafts: DataFrame) -> DataFrame:
    """Case rows of confirmed drafts."""
    return drafts.withColumn("case_id", case_id_of(F.col("intake_id")))
