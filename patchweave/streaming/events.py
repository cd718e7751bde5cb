"""Webhook events: status, routing, and the newest event of each change, in batch and as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions that start a review.
ACTIONS = ("opened", "reopened", "synchronize")
PAYLOAD = "action string, installation struct<id:string>, repository struct<owner:struct<login:string>,name:string>, pull_request struct<number:string>"


def hmac_sha256(message: Column, secret: str) -> Column:
    """The message's HMAC in hex; null for a null message."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def verify_signature(payload: Column, signature: Column, secret: str) -> Column:
    """Whether the signature is ``sha256=`` and the payload's HMAC in hex; false for nulls."""
    return F.coalesce(signature == F.concat(F.lit("sha256="), hmac_sha256(payload, secret)), F.lit(False))


def http_status(raw: DataFrame, secret: str | None) -> DataFrame:
    """``raw`` (event, signature, payload, ...) with the status that its delivery is answered with.

    503 without a secret, 401 for a bad signature, 200 for ping, 202 for a pull request, 400 for one that is no JSON, else 200.
    """
    if not secret:
        return raw.withColumn("http_status", F.lit(503))
    ok = verify_signature(F.col("payload"), F.col("signature"), secret)
    readable = F.try_parse_json("payload").isNotNull()
    status = F.when(~ok, 401).when(F.col("event") == "ping", 200).when((F.col("event") == "pull_request") & readable, 202).when(F.col("event") == "pull_request", 400).otherwise(200)
    return raw.withColumn("http_status", status)


def parse_payload(raw: DataFrame) -> DataFrame:
    """(delivery, action, installation, owner, name, number, received_at): numbers that are absent or no numbers are 0."""
    read = raw.withColumn("p", F.from_json("payload", PAYLOAD))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS bigint)"), F.lit(0))
    return read.select("delivery", "p.action", number("p.installation.id").alias("installation"), F.col("p.repository.owner.login").alias("owner"), F.col("p.repository.name").alias("name"), number("p.pull_request.number").alias("number"), "received_at")


def from_table(events: DataFrame) -> DataFrame:
    """The driver's events as routed payloads: the type names the action, props hold the installation, the user is the number."""
    action = F.expr("CASE event_type WHEN 'signup' THEN 'opened' WHEN 'view' THEN 'synchronize' WHEN 'click' THEN 'reopened' WHEN 'error' THEN 'closed' ELSE 'labeled' END")
    return events.select("event_id", action.alias("action"), F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("installation"), F.lit("acme").alias("owner"), F.lit("app").alias("name"), F.coalesce("user_id", F.lit(0)).alias("number"), F.col("ts").alias("received_at"))


def route(events: DataFrame) -> DataFrame:
    """Events with ``status`` (ACCEPTED, INVALID or IGNORED) and ``pr_key``: invalid without installation, owner, name or number."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    invalid = (F.col("installation") == 0) | blank("owner") | blank("name") | (F.col("number") == 0)
    status = F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "IGNORED").when(invalid, "INVALID").otherwise("ACCEPTED")
    return events.withColumn("status", status).withColumn("pr_key", F.concat("owner", F.lit("/"), "name", F.lit("#"), F.col("number").cast("string")))


def latest(events: DataFrame, order: tuple[str, ...] = ("received_at", "event_id")) -> DataFrame:
    """The newest event of each change; one pass of partial aggregation, so a busy change costs no more."""
    whole = F.struct(*(c for c in events.columns if c != "pr_key"))
    return events.groupBy("pr_key").agg(F.max_by(whole, F.struct(*order)).alias("e")).select("pr_key", "e.*")


def start_stream(raw: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 hour"):
    """Runs ``handle`` on each batch's newest accepted events; deliveries that come again within ``late`` count once.

    With an idempotent handler (a plan store that skips known ids) the effect is exactly once.
    """
    fresh = raw.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["delivery"])
    routed = route(parse_payload(fresh)).where("status = 'ACCEPTED'")
    return routed.writeStream.foreachBatch(lambda batch, epoch: handle(latest(batch, ("received_at", "delivery")), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
