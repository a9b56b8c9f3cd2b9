"""Favourites as command batches, and linking of sign-ins to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postingflow.functions.text import is_blank, normalize_email, trim_space
from postingflow.operators.scan import spread_join

PAIR = ["user_id", "job_id"]


def list_favorites(favorites: DataFrame, postings: DataFrame, user_id: str | None = None) -> DataFrame:
    """Favourite postings, newest first; of one user, or of every user side by side. Any status."""
    mine = favorites if user_id is None else favorites.filter(F.col("user_id") == user_id)
    joined = spread_join(mine, postings.withColumnRenamed("id", "job_id"), ["job_id"])
    return joined.orderBy("user_id", F.col("created_at").desc(), "job_id")


def add_favorites(commands: DataFrame, favorites: DataFrame, users: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay add commands (seq, user_id, job_id, at). Returns (favourites after, status per command).

    A repeat inside the batch finds the favourite its first command made.
    """
    first = commands.groupBy(*PAIR).agg(F.min(F.struct("seq", "at")).alias("_first"))
    known = (
        first.join(users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user")).dropDuplicates(["user_id"]), "user_id", "left")
    )
    known = spread_join(known, postings.select(F.col("id").alias("job_id"), F.lit(True).alias("_job")).dropDuplicates(["job_id"]), ["job_id"], "left")
    known = known.join(favorites.select(*PAIR, F.lit(True).alias("_held")).dropDuplicates(PAIR), PAIR, "left")
    judged = spread_join(commands, known, PAIR).withColumn(
        "status",
        F.when(F.col("_user").isNull(), "UserNotFound").when(F.col("_job").isNull(), "JobNotFound")
        .when(F.col("_held") | (F.col("seq") != F.col("_first.seq")), "AlreadyExists").otherwise("Added"))
    new = known.filter(F.col("_user") & F.col("_job") & F.col("_held").isNull()).select(*PAIR, F.col("_first.at").alias("created_at"))
    after = favorites.select(*PAIR, "created_at").unionByName(new)
    return after, judged.select("seq", *PAIR, "status")


def remove_favorites(commands: DataFrame, favorites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay remove commands. Returns (favourites after, status per command)."""
    first = commands.groupBy(*PAIR).agg(F.min("seq").alias("_first"))
    held = first.join(favorites.select(*PAIR, F.lit(True).alias("_held")).dropDuplicates(PAIR), PAIR, "left")
    status = F.when(F.col("_held") & (F.col("seq") == F.col("_first")), "Removed").otherwise("NotFound")
    judged = spread_join(commands, held, PAIR).select("seq", *PAIR, status.alias("status"))
    return favorites.join(first, PAIR, "left_anti"), judged


def replay_favorites(log: DataFrame, favorites: DataFrame) -> DataFrame:
    """Favourites after a mixed log (seq, action add/remove, at): the last command of each pair decides.

    A pair that ends as added keeps the time it became a favourite: its first add after the last remove,
    or the stored time when no remove came.
    """
    adds, removes = F.col("action") == "add", F.col("action") == "remove"
    ends = log.groupBy(*PAIR).agg(
        F.max_by("action", "seq").alias("_final"), F.max(F.when(removes, F.col("seq"))).alias("_gone"))
    since = spread_join(log.filter(adds), ends.filter(F.col("_final") == "add"), PAIR).filter(
        F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    added = since.groupBy(*PAIR).agg(F.min_by("at", "seq").alias("created_at"), F.max(F.col("_gone").isNotNull()).alias("_renewed"))
    kept = favorites.select(*PAIR, "created_at").join(ends.filter((F.col("_final") == "remove") | F.col("_gone").isNotNull()), PAIR, "left_anti")
    new = added.join(kept, PAIR, "left_anti")
    return kept.unionByName(new.select(*PAIR, "created_at"))


def import_favorites(ids: DataFrame, favorites: DataFrame, users: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import legacy ids (user_id, job_id, at): (favourites after, ids to retry, counts per user)."""
    clean = ids.withColumn("job_id", trim_space(F.col("job_id"))).filter(~is_blank(F.col("job_id")))
    distinct = clean.groupBy(*PAIR).agg(F.min("at").alias("at")).withColumn("seq", F.lit(0).cast("long"))
    after, status = add_favorites(distinct, favorites, users, postings)
    ok = F.col("status").isin("Added", "AlreadyExists")
    counts = status.groupBy("user_id").agg(F.count(F.when(ok, 1)).alias("imported"), F.count(F.when(~ok, 1)).alias("failed"))
    return after, status.filter(~ok).select(*PAIR), counts


def _sign_in_error() -> Column:
    return (
        F.when(is_blank(F.col("subject")), "MissingProviderSubject").when(is_blank(F.col("email")), "MissingEmail")
        .when(~F.coalesce("email_verified", F.lit(False)), "EmailNotVerified")
    )


def link_identities(sign_ins: DataFrame, identities: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link sign-ins (seq, provider, subject, email, email_verified, display_name, avatar_url, at) to users.

    Known identity first, then a user with the same folded email, else a new user of that email. Returns
    (status and user_id per sign-in, users after). An identity seen first in this batch belongs to the user
    of its first email.
    """
    judged = sign_ins.withColumns({
        "status": F.coalesce(_sign_in_error(), F.lit("Success")), "provider": trim_space(F.col("provider")),
        "subject": trim_space(F.col("subject")), "normalized_email": normalize_email(F.col("email")),
    })
    good = judged.filter(F.col("status") == "Success")
    firsts = good.groupBy("provider", "subject").agg(F.min_by("normalized_email", "seq").alias("_email"))
    held = firsts.join(identities.select("provider", "subject", F.col("user_id").alias("_linked")), ["provider", "subject"], "left")
    by_email = users.groupBy("normalized_email").agg(F.min("id").alias("_owner"))
    found = spread_join(held, by_email.withColumnRenamed("normalized_email", "_email"), ["_email"], "left").select(
        "provider", "subject", F.coalesce("_linked", "_owner", F.concat(F.lit("u:"), F.left(F.sha2("_email", 256), F.lit(32)))).alias("user_id"))
    placed = spread_join(good, found, ["provider", "subject"])

    def last_text(c: str) -> Column:
        return F.max_by(trim_space(F.col(c)), F.when(~is_blank(F.col(c)), F.col("seq")))

    seen = placed.groupBy("user_id").agg(
        F.min_by(trim_space(F.col("email")), "seq").alias("_email"), F.min_by("normalized_email", "seq").alias("_normal"),
        last_text("display_name").alias("_name"), last_text("avatar_url").alias("_avatar"),
        F.min("at").alias("_verified"), F.max("at").alias("_login"))
    merged = users.withColumnRenamed("id", "user_id").join(seen, "user_id", "full").select(
        F.col("user_id").alias("id"), F.coalesce("email", "_email").alias("email"),
        F.coalesce("normalized_email", "_normal").alias("normalized_email"),
        F.coalesce("_name", "display_name", F.lit("")).alias("display_name"), F.coalesce("_avatar", "avatar_url").alias("avatar_url"),
        F.coalesce("email_verified_at", "_verified").alias("email_verified_at"), F.coalesce("_login", "last_login_at").alias("last_login_at"))
    bad = judged.filter(F.col("status") != "Success").select("seq", "status", F.lit(None).cast("string").alias("user_id"))
    return placed.select("seq", "status", "user_id").unionByName(bad), merged

