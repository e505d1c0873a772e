"""Turning rows into recipients, and enriching rows by lookup."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.values import normalize_phone
from evenkeel.operators.skew import join_unique

SEPARATORS = r"[,;\s]+"


def display_name() -> Column:
    full = F.trim(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))))
    return (F.when(full != "", full)
            .when(F.coalesce("username", F.lit("")) != "", F.concat(F.lit("@"), F.col("username")))
            .otherwise(F.coalesce("chat_id", F.lit("-"))))


def _first_by(contacts: DataFrame, keys: Sequence[Column], position: str) -> DataFrame:
    """The first contact in list order for each bot and key."""
    found = contacts.select("bot_id", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("token"),
                            position, "chat_id", "phone_number", display_name().alias("name"))
    return found.filter(F.col("token") != "").groupBy("bot_id", "token").agg(
        F.min(F.struct(position, "chat_id", "phone_number", "name")).alias("c"))


def resolve_recipients(rows: DataFrame, contacts: DataFrame, column: str, bot: str,
                       position: str = "contact_id") -> DataFrame:
    """One row per recipient token of ``column``.

    A token is a contact's chat id, phone, or the same phone in another notation,
    among the contacts of one bot; the first contact in list order counts. An
    unknown token stands for itself.
    """
    own = contacts.filter(F.col("bot_id") == bot)
    exact = _first_by(own, [F.col("chat_id"), F.col("phone_number")], position) \
        .select("token", F.col("c").alias("__exact"))
    phone = _first_by(own, [normalize_phone(F.col("phone_number"))], position) \
        .select(F.col("token").alias("__phone"), F.col("c").alias("__by_phone"))
    tokens = rows.withColumn("token", F.explode(F.split(F.col(f"`{column}`").cast("string"), SEPARATORS))) \
        .filter(F.col("token") != "").withColumn("__phone", normalize_phone(F.col("token")))
    for side, key in ((exact, "token"), (phone, "__phone")):
        tokens = join_unique(tokens, side, [key])
    best = F.least("__exact", "__by_phone")  # least skips nulls; structs compare by position first
    known = tokens.withColumn("__c", best)
    return known.select(
        *[F.col(f"`{c}`") for c in rows.columns], "token",
        F.coalesce("__c.chat_id", "token").alias("chat_id"),
        F.coalesce("__c.name", "token").alias("recipient_name"),
        F.coalesce(F.nullif(F.col("__c.phone_number"), F.lit("")), F.col("token")).alias("recipient_phone"))


def fixed_recipients(rows: DataFrame, contacts: DataFrame, contact_ids: str) -> DataFrame:
    """Every row goes to each contact of a fixed list of ids; unknown ids stand for themselves."""
    wanted = [t for t in re.split(SEPARATORS, contact_ids or "") if t]
    found = {str(r["contact_id"]): r for r in contacts.filter(
        F.col("contact_id").cast("string").isin(wanted) & F.col("chat_id").isNotNull())
        .select("contact_id", "chat_id", display_name().alias("name"), "phone_number").collect()}
    targets = []
    for token in wanted:
        hit = found.get(token)
        chat, name, phone = (hit["chat_id"], hit["name"], hit["phone_number"] or "-") if hit else (token, f"Direct: {token}", "-")
        targets.append(F.struct(F.lit(chat).alias("chat_id"), F.lit(name).alias("recipient_name"),
                                F.lit(phone).alias("recipient_phone")))
    if not targets:
        return rows.limit(0)
    return rows.withColumn("__t", F.explode(F.array(*targets))).select(*rows.columns, "__t.*")


def enrich(rows: DataFrame, view: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row is replaced by the view rows of its key; a row without any is dropped.

    Rows repeat as often as they came in, so the join stays an inner one; the
    planner splits partitions that come out skewed.
    """
    return rows.select(*keys).join(view, list(keys), "inner")
