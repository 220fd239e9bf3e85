"""Journals: state machines, replay, hash chains, leases, idempotent intents, authorities and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Legal transitions (fixed values); the last four states of the second list are terminal.
TRANSITIONS = (
    ("PREPARED", "FILE_COMMITTED"), ("PREPARED", "FAILED"), ("FILE_COMMITTED", "INDEX_COMMITTED"), ("FILE_COMMITTED", "FAILED"), ("FILE_COMMITTED", "ROLLED_BACK"),
    ("INDEX_COMMITTED", "VERIFY_PENDING"), ("INDEX_COMMITTED", "DONE"), ("INDEX_COMMITTED", "FAILED"), ("VERIFY_PENDING", "DONE"), ("VERIFY_PENDING", "FAILED"),
)
STATES = ("PREPARED", "FILE_COMMITTED", "INDEX_COMMITTED", "VERIFY_PENDING", "DONE", "FAILED", "ROLLED_BACK")
TERMINAL = ("DONE", "FAILED", "ROLLED_BACK")
GENESIS = "GENESIS"


def transitions(events: DataFrame) -> DataFrame:
    """Each event (tx_id, sequence, to_state) with its predecessor's state and whether the step is legal; a first event must be PREPARED."""
    before = F.lag("to_state").over(Window.partitionBy("tx_id").orderBy("sequence"))
    out = events.withColumn("from_state", before)
    step = F.concat_ws(">", "from_state", "to_state").isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
    return out.withColumn("legal", F.when(F.col("from_state").isNull(), F.col("to_state") == "PREPARED").otherwise(step)).select("tx_id", "sequence", "from_state", "to_state", "legal")


def replay(events: DataFrame) -> DataFrame:
    """Each transaction's last state, when it began, and whether a state is unknown."""
    return events.groupBy("tx_id").agg(F.max_by("to_state", "sequence").alias("state"), F.min("at").alias("created_at"), F.bool_or(~F.col("to_state").isin(*STATES)).alias("corrupt"))


def incomplete(events: DataFrame) -> DataFrame:
    """Transactions that haven't ended, none of them corrupt."""
    return replay(events).where(~F.col("state").isin(*TERMINAL) & ~F.col("corrupt"))


def latest_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each key's first row in the order given, which must have no ties left."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__place = 1").drop("__place")


def batch_status(asked: DataFrame, states: DataFrame) -> DataFrame:
    """One row: how many of the asked ids are done, failed, open or missing; ids that are asked twice count twice."""
    met = asked.join(states.select("tx_id", "state"), "tx_id", "left")
    done, failed, missing = F.count_if(F.col("state") == "DONE"), F.count_if(F.col("state").isin("FAILED", "ROLLED_BACK")), F.count_if(F.col("state").isNull())
    n = F.count("*")
    return met.agg(n.alias("asked"), done.alias("done"), failed.alias("failed"), missing.alias("missing"), (n - done - failed - missing).alias("open"), (done == n).alias("all_done"), (failed > 0).alias("any_failed"))


def link(payload: Column, previous: Column) -> Column:
    """The hash of a ledger's entry."""
    return F.sha2(F.concat_ws("|", payload, previous), 256)


def verify_chain(ledger: DataFrame, key: str = "chain") -> DataFrame:
    """(chain, first_break, reason): the first entry whose previous hash isn't the one before's (or GENESIS), else whose own hash doesn't fit. Null without a break. All entries are checked at once."""
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(key).orderBy("seq")), F.lit(GENESIS))
    reason = F.when(~F.col("prev_hash").eqNullSafe(before), "link").when(~F.col("event_hash").eqNullSafe(link(F.col("payload"), F.col("prev_hash"))), "hash")
    told = ledger.withColumn("reason", reason)
    broken = F.struct("seq", "reason")
    return told.groupBy(key).agg(F.min(F.when(F.col("reason").isNotNull(), broken)).alias("b")).select(key, F.col("b.seq").alias("first_break"), F.col("b.reason").alias("reason"))


def append_chain(events: DataFrame, key: str = "chain") -> DataFrame:
    """The ledger of each chain's events (seq, payload). Hashing is serial by its nature, so each chain is folded over its ordered payloads in one expression."""
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("seq", "payload"))),
        F.struct(F.lit(GENESIS).alias("last"), F.array().cast("array<struct<seq: bigint, prev_hash: string, event_hash: string, payload: string>>").alias("rows")),
        lambda a, x: F.struct(
            link(x["payload"], a["last"]).alias("last"),
            F.concat(a["rows"], F.array(F.struct(x["seq"].cast("bigint").alias("seq"), a["last"].alias("prev_hash"), link(x["payload"], a["last"]).alias("event_hash"), x["payload"].alias("payload")))).alias("rows"),
        ),
        lambda a: a["rows"],
    )
    return events.groupBy(key).agg(fold.alias("rows")).select(key, F.explode("rows").alias("r")).select(key, "r.*")


def catalog_digest(files: DataFrame, key: str) -> DataFrame:
    """A digest of path, NUL, hash, newline for each file, ordered by path."""
    rows = F.array_sort(F.collect_list(F.struct("path", "hash")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["path"], F.lit("\0"), x["hash"], F.lit("\n"))), "")
    return files.groupBy(key).agg(F.sha2(text, 256).alias("digest"))


def tagged_digest(tag: str, text: Column) -> Column:
    """A digest under a tag."""
    return F.concat(F.lit(f"{tag}:"), F.sha2(F.concat(F.lit(tag + "\0"), text), 256))


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """An outbox (dedupe_key, status, attempts) after new requests: unknown keys are queued; done and failed ones are queued again; others stay."""
    asked = new.select("dedupe_key").distinct().withColumn("asked", F.lit(True))
    both = jobs.join(asked, "dedupe_key", "full")
    again = F.col("asked") & (F.col("status").isNull() | F.col("status").isin("done", "failed"))
    return both.select("dedupe_key", F.when(again, "queued").otherwise(F.col("status")).alias("status"), F.when(F.col("status").isNull(), 0).when(again, F.col("attempts") + 1).otherwise(F.col("attempts")).cast("long").alias("attempts"))


def expire_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued or running jobs without a lease, or with one that is over, fail."""
    stale = F.col("status").isin("queued", "running") & (F.col("lease_until").isNull() | (F.col("lease_until") < now))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def supersede(intents: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Of the intents of a key the newest is active; each other is superseded by the next one."""
    after = F.lead("intent_id").over(Window.partitionBy(key).orderBy("intent_id"))
    return intents.withColumn("superseded_by", after).withColumn("status", F.when(after.isNull(), "active").otherwise("superseded"))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that doesn't hold; ``ok`` if all do. Null counts as not holding."""
    out = F.lit("ok")
    for name, holds in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(name)
    return out


def decide(reviews: DataFrame, decisions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The outcome of each decision (review_id, diff_digest): not_found, already_decided, expired, digest_mismatch or decided."""
    r = reviews.select("review_id", "status", "created_at", F.col("diff_digest").alias("wanted"))
    outcome = (
        F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "pending", "already_decided")
        .when(F.col("created_at") < now - F.expr(f"interval {hours} hours"), "expired").when(F.col("diff_digest") != F.col("wanted"), "digest_mismatch").otherwise("decided")
    )
    return decisions.join(r, "review_id", "left").select("review_id", outcome.alias("outcome"))


def note_staleness(refs: DataFrame, current: DataFrame) -> DataFrame:
    """Each note's reference: fresh, stale (its hash changed) or gone."""
    met = refs.join(current.select("path", F.col("hash").alias("now")), "path", "left")
    return met.select("note_id", "path", F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("hash"), "stale").otherwise("fresh").alias("state"))


def notes_for(refs: DataFrame, notes: DataFrame, top: int = 5) -> DataFrame:
    """Each path's newest notes."""
    w = Window.partitionBy("path").orderBy(F.desc("updated_at"), "note_id")
    return refs.join(notes, "note_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("path", "place", "note_id")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The message authentication code of a text as lower-case hexadecimal digits (RFC 2104), without leaving the JVM."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def signed(rows: DataFrame, key: bytes, fields: list[str]) -> DataFrame:
    """``rows`` with a signature over their fields, joined by U+0001; a null field counts as empty."""
    return rows.withColumn("signature", hmac_sha256(key, F.concat_ws("\u0001", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])))


def signature_holds(key: bytes, fields: list[str]) -> Column:
    """The row's signature is that of its fields."""
    return F.col("signature").eqNullSafe(hmac_sha256(key, F.concat_ws("\u0001", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])))


def note_integrity(notes: DataFrame, key: bytes, suspicious: Column) -> DataFrame:
    """Notes (topic, text, mac) with integrity (ok, mismatch, or unverified without a mac), and quarantined where the text looks like an injection."""
    mac = hmac_sha256(key, F.concat_ws("\u0001", "topic", F.coalesce("text", F.lit(""))))
    return notes.withColumn("integrity", F.when(F.col("mac").isNull(), "unverified").when(F.col("mac") == mac, "ok").otherwise("mismatch")).withColumn("quarantined", F.coalesce(suspicious, F.lit(False)))


def snapshot_id(components: DataFrame) -> DataFrame:
    """(snapshot, id, freshness) of component digests (snapshot, name, digest, current): the digest of all digests by name.

    A snapshot is fresh if each component is as it is now, drifted if one differs, unknown if one has no current digest. Components are a short list.
    """
    parts = F.array_sort(F.collect_list(F.struct("name", "digest")))
    joined = F.array_join(F.transform(parts, lambda x: F.concat_ws("=", x["name"], x["digest"])), ";")
    state = F.when(F.bool_or(F.col("current").isNull()), "unknown").when(F.bool_or(F.col("current") != F.col("digest")), "drifted").otherwise("fresh")
    return components.groupBy("snapshot").agg(F.sha2(joined, 256).alias("id"), state.alias("freshness"))
