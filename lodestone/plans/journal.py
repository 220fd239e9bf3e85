"""Journal queries. A transaction is a user's day of events; states follow from the events' kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safety import injections
from ..operators import journal as J
from ..projections import rel
from ..registry import query

TX = """tx AS (SELECT user_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS tx_id, event_id AS sequence, ts AS happened,
    CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) = 1 AND event_id % 10 > 0 THEN 'PREPARED' WHEN event_type = 'click' THEN 'FILE_COMMITTED' WHEN event_type = 'view' THEN 'INDEX_COMMITTED' WHEN event_type = 'purchase' THEN 'DONE' WHEN event_type = 'signup' THEN 'VERIFY_PENDING' WHEN value > 60 THEN 'LOST' ELSE 'FAILED' END AS to_state FROM events)"""


def tx(spark, sf):
    return rel(spark, sf, "events").selectExpr(
        "user_id || '@' || cast(cast(ts as date) as string) as tx_id", "event_id as sequence", "ts as at",
        "case when row_number() over (partition by user_id, cast(ts as date) order by event_id) = 1 and event_id % 10 > 0 then 'PREPARED' when event_type = 'click' then 'FILE_COMMITTED' when event_type = 'view' then 'INDEX_COMMITTED' when event_type = 'purchase' then 'DONE' when event_type = 'signup' then 'VERIFY_PENDING' when value > 60 then 'LOST' else 'FAILED' end as to_state",
    )


LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in J.TRANSITIONS)
REPLAY = f"""{TX}, states AS (SELECT tx_id, arg_max(to_state, sequence) AS state, min(happened) AS created_at, bool_or(to_state NOT IN {J.STATES}) AS corrupt FROM tx GROUP BY tx_id)"""


@query("t01_transitions", f"""
    WITH {TX}, f AS (SELECT tx_id, sequence, lag(to_state) OVER (PARTITION BY tx_id ORDER BY sequence) AS from_state, to_state FROM tx)
    SELECT *, CASE WHEN from_state IS NULL THEN to_state = 'PREPARED' ELSE (from_state, to_state) IN ({LEGAL}) END AS legal FROM f""")
def t01_transitions(spark, sf):
    return J.transitions(tx(spark, sf))


@query("t02_replay", f"WITH {REPLAY} SELECT tx_id, state, corrupt FROM states")
def t02_replay(spark, sf):
    return J.replay(tx(spark, sf)).select("tx_id", "state", "corrupt")


@query("t03_incomplete", f"WITH {REPLAY} SELECT tx_id, state FROM states WHERE state NOT IN {J.TERMINAL} AND NOT corrupt")
def t03_incomplete(spark, sf):
    return J.incomplete(tx(spark, sf)).select("tx_id", "state")


@query("t04_latest_per_path", """
    WITH p AS (SELECT event_type || '/' || user_id AS path, event_id AS tx, ts FROM events) SELECT path, arg_max(tx, tx) AS tx FROM p GROUP BY path""")
def t04_latest_per_path(spark, sf):
    p = rel(spark, sf, "events").select(F.concat_ws("/", "event_type", "user_id").alias("path"), F.col("event_id").alias("tx"), "ts")
    return J.latest_per(p, "path", [F.desc("tx")]).select("path", "tx")


@query("t05_batch_status", f"""
    WITH {REPLAY}, asked AS (SELECT tx_id FROM tx UNION ALL SELECT 'x' || n_nationkey FROM nation), m AS (SELECT a.tx_id, state FROM asked a LEFT JOIN states s ON a.tx_id = s.tx_id),
    c AS (SELECT count(*) AS asked, count(*) FILTER (state = 'DONE') AS done, count(*) FILTER (state IN ('FAILED', 'ROLLED_BACK')) AS failed, count(*) FILTER (state IS NULL) AS missing FROM m)
    SELECT *, asked - done - failed - missing AS open, done = asked AS all_done, failed > 0 AS any_failed FROM c""")
def t05_batch_status(spark, sf):
    t = tx(spark, sf)
    asked = t.select("tx_id").unionAll(rel(spark, sf, "nation").select(F.concat(F.lit("x"), "n_nationkey")))
    return J.batch_status(asked, J.replay(t))


LEDGER = """l AS (SELECT user_id AS chain, event_id AS seq, props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    ledger AS (SELECT chain, seq, payload, n, 'GENESIS' AS prev_hash, sha256(payload || '|GENESIS') AS event_hash FROM l WHERE n = 1
        UNION ALL SELECT l.chain, l.seq, l.payload, l.n, p.event_hash, sha256(l.payload || '|' || p.event_hash) FROM ledger p JOIN l ON l.chain = p.chain AND l.n = p.n + 1)"""


def ledger(spark, sf):
    return J.append_chain(rel(spark, sf, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.col("props").alias("payload")))


@query("t06_ledger", f"WITH RECURSIVE {LEDGER} SELECT chain, seq, prev_hash, event_hash FROM ledger")
def t06_ledger(spark, sf):
    return ledger(spark, sf).drop("payload")


@query("t07_chain_verification", f"""
    WITH RECURSIVE {LEDGER}, bad AS (SELECT chain, seq, prev_hash, event_hash, CASE WHEN chain % 5 = 1 AND n = 3 THEN payload || 'x' ELSE payload END AS payload FROM ledger WHERE NOT (chain % 5 = 2 AND n = 2)),
    c AS (SELECT chain, seq, CASE WHEN prev_hash <> coalesce(lag(event_hash) OVER (PARTITION BY chain ORDER BY seq), 'GENESIS') THEN 'link' WHEN event_hash <> sha256(payload || '|' || prev_hash) THEN 'hash' END AS reason FROM bad)
    SELECT chain, min(seq) FILTER (reason IS NOT NULL) AS first_break, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason FROM c GROUP BY chain""")
def t07_chain_verification(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("chain").orderBy("seq"))
    rows = ledger(spark, sf).withColumn("n", n)
    bad = rows.where("not (chain % 5 = 2 and n = 2)").withColumn("payload", F.when((F.col("chain") % 5 == 1) & (F.col("n") == 3), F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    return J.verify_chain(bad)


@query("t08_evidence_digest", "SELECT event_id, 'ev:' || sha256('ev' || chr(0) || props) AS digest FROM events")
def t08_evidence_digest(spark, sf):
    return rel(spark, sf, "events").select("event_id", J.tagged_digest("ev", F.col("props")).alias("digest"))


@query("t09_catalog_digest", """
    WITH f AS (SELECT source, lang || '/' || doc_id AS path, md5(coalesce(text, '')) AS hash FROM documents)
    SELECT source, sha256(string_agg(path || chr(0) || hash || chr(10), '' ORDER BY path)) AS digest FROM f GROUP BY source""")
def t09_catalog_digest(spark, sf):
    f = rel(spark, sf, "documents").select("source", F.concat_ws("/", "lang", "doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    return J.catalog_digest(f, "source")


JOBS = """jobs AS (SELECT o_orderkey AS dedupe_key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, 1 AS attempts, CASE WHEN o_totalprice > 1000 THEN o_orderdate END AS lease_until FROM orders)"""


def jobs(spark, sf):
    return rel(spark, sf, "orders").selectExpr("o_orderkey as dedupe_key", "case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status", "1L as attempts", "case when o_totalprice > 1000 then o_orderdate end as lease_until")


@query("t11_outbox", f"""
    WITH {JOBS}, asked AS (SELECT DISTINCT l_orderkey + 40 AS dedupe_key FROM lineitem), b AS (SELECT dedupe_key, status, attempts, a.dedupe_key IS NOT NULL AS asked FROM jobs FULL JOIN asked a USING (dedupe_key))
    SELECT dedupe_key, CASE WHEN asked AND (status IS NULL OR status IN ('done', 'failed')) THEN 'queued' ELSE status END AS status, CASE WHEN status IS NULL THEN 0 WHEN asked AND status IN ('done', 'failed') THEN attempts + 1 ELSE attempts END AS attempts FROM b""".replace("a.dedupe_key IS NOT NULL AS asked FROM jobs FULL JOIN asked a USING (dedupe_key)", "coalesce(hit, false) AS asked FROM jobs FULL JOIN (SELECT *, true AS hit FROM asked) a USING (dedupe_key)"))
def t11_outbox(spark, sf):
    new = rel(spark, sf, "lineitem").select((F.col("l_orderkey") + 40).alias("dedupe_key"))
    return J.enqueue(jobs(spark, sf), new)


@query("t12_leases", f"WITH {JOBS} SELECT dedupe_key, CASE WHEN status IN ('queued', 'running') AND (lease_until IS NULL OR lease_until < TIMESTAMP '1997-01-01') THEN 'failed' ELSE status END AS status FROM jobs")
def t12_leases(spark, sf):
    return J.expire_leases(jobs(spark, sf), F.lit("1997-01-01").cast("timestamp")).select("dedupe_key", "status")


@query("t13_supersede", "SELECT event_id AS intent_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS superseded_by, CASE WHEN lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) IS NULL THEN 'active' ELSE 'superseded' END AS status FROM events")
def t13_supersede(spark, sf):
    e = rel(spark, sf, "events").select(F.col("event_id").alias("intent_id"), F.concat_ws(":", "user_id", "event_type").alias("idempotency_key"))
    return J.supersede(e).drop("idempotency_key")


@query("t14_authority", "SELECT event_id, CASE WHEN NOT value > 1 THEN 'signature' WHEN NOT ts > TIMESTAMP '2024-01-02' THEN 'expiry' WHEN NOT coalesce(event_type <> 'error', false) THEN 'intent' WHEN NOT user_id % 3 > 0 THEN 'scope' ELSE 'ok' END AS verdict FROM events")
def t14_authority(spark, sf):
    checks = [("signature", F.col("value") > 1), ("expiry", F.col("ts") > F.lit("2024-01-02").cast("timestamp")), ("intent", F.col("event_type") != "error"), ("scope", F.col("user_id") % 3 > 0)]
    return rel(spark, sf, "events").select("event_id", J.first_failure(checks).alias("verdict"))


@query("t15_reviews", """
    WITH d AS (SELECT event_id AS review_id, props AS diff_digest FROM events UNION ALL SELECT event_id + 1000000, props FROM events WHERE event_type = 'error'),
    r AS (SELECT event_id AS review_id, CASE WHEN event_type = 'click' THEN 'approved' ELSE 'pending' END AS status, ts AS created_at, CASE WHEN value > 30 THEN 'other' ELSE props END AS wanted FROM events)
    SELECT d.review_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 'pending' THEN 'already_decided' WHEN created_at < TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR THEN 'expired' WHEN diff_digest <> wanted THEN 'digest_mismatch' ELSE 'decided' END AS outcome FROM d LEFT JOIN r ON d.review_id = r.review_id""")
def t15_reviews(spark, sf):
    e = rel(spark, sf, "events")
    d = e.select(F.col("event_id").alias("review_id"), F.col("props").alias("diff_digest")).unionAll(e.where("event_type = 'error'").select(F.col("event_id") + 1000000, "props"))
    r = e.select(F.col("event_id").alias("review_id"), F.when(F.col("event_type") == "click", "approved").otherwise("pending").alias("status"), F.col("ts").alias("created_at"), F.when(F.col("value") > 30, "other").otherwise(F.col("props")).alias("diff_digest"))
    return J.decide(r, d, F.lit("2024-01-10").cast("timestamp"))


REFS = """refs AS (SELECT conv_id * 100 + turn AS note_id, conv_id * 13 AS path, md5(CASE WHEN role = 'user' THEN coalesce(d.text, '') ELSE 'old' END) AS hash FROM conversations LEFT JOIN documents d ON doc_id = conv_id * 13)"""


def refs(spark, sf):
    c, d = rel(spark, sf, "conversations").alias("c"), rel(spark, sf, "documents").alias("d")
    return c.join(d, F.col("d.doc_id") == F.col("c.conv_id") * 13, "left").select((F.col("conv_id") * 100 + F.col("turn")).alias("note_id"), (F.col("conv_id") * 13).alias("path"), F.md5(F.when(F.col("role") == "user", F.coalesce("d.text", F.lit(""))).otherwise("old")).alias("hash"))


@query("t16_latest_notes", "SELECT conv_id AS topic, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def t16_latest_notes(spark, sf):
    c = rel(spark, sf, "conversations").select(F.col("conv_id").alias("topic"), "turn", "role")
    return J.latest_per(c, "topic", [F.desc("turn"), F.asc("role")])


@query("t17_note_staleness", f"""
    WITH {REFS}, cur AS (SELECT doc_id, md5(coalesce(text, '')) AS now FROM documents) SELECT note_id, path, CASE WHEN now IS NULL THEN 'gone' WHEN now <> hash THEN 'stale' ELSE 'fresh' END AS state FROM refs LEFT JOIN cur ON doc_id = path""")
def t17_note_staleness(spark, sf):
    cur = rel(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    return J.note_staleness(refs(spark, sf), cur)


@query("t18_notes_for_path", f"""
    WITH {REFS}, n AS (SELECT conv_id * 100 + turn AS note_id, length(text) AS updated_at FROM conversations), r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC, note_id) AS place, note_id FROM refs JOIN n USING (note_id)) SELECT * FROM r WHERE place <= 5""")
def t18_notes_for_path(spark, sf):
    n = rel(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("note_id"), F.length("text").alias("updated_at"))
    return J.notes_for(refs(spark, sf), n)


_KEY = b"a key of the tests"
_PADS = {name: bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for name, pad in (("inner", 0x36), ("outer", 0x5C))}


def _mac(message: str) -> str:
    return f"sha256(unhex('{_PADS['outer']}') || unhex(sha256(unhex('{_PADS['inner']}') || encode({message}))))"


@query("t14_signatures", f"SELECT event_id, {_mac("user_id || chr(1) || event_type")} AS signature, event_id % 5 <> 0 AS holds FROM events")
def t14_signatures(spark, sf):
    """A fifth of the rows is changed after it was signed."""
    e = rel(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("kind"))
    s = J.signed(e, _KEY, ["user", "kind"])
    return s.withColumn("kind", F.when(F.col("event_id") % 5 == 0, F.concat("kind", F.lit("!"))).otherwise(F.col("kind"))).withColumn("holds", J.signature_holds(_KEY, ["user", "kind"])).select("event_id", "signature", "holds")


@query("t16_note_integrity", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unverified' WHEN 1 THEN 'mismatch' ELSE 'ok' END AS integrity, regexp_matches(coalesce(text, ''), '(?i)ignore\\s+(all\\s+)?previous\\s+instructions') AS quarantined FROM documents")
def t16_note_integrity(spark, sf):
    d = rel(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("topic"), "text")
    mac = J.hmac_sha256(_KEY, F.concat_ws("\u0001", "topic", F.coalesce("text", F.lit(""))))
    d = d.withColumn("mac", F.when(F.col("doc_id") % 3 == 1, F.reverse(mac)).when(F.col("doc_id") % 3 == 2, mac))
    return J.note_integrity(d, _KEY, F.array_contains(injections(F.coalesce("text", F.lit(""))), "IGNORE_PRIOR_INSTRUCTIONS")).select("doc_id", "integrity", "quarantined")


@query("t10_snapshots", """
    WITH c AS (SELECT l_orderkey AS snapshot, 'c' || l_linenumber AS name, md5(l_suppkey::VARCHAR) AS digest, CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN NULL WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN md5('other') ELSE md5(l_suppkey::VARCHAR) END AS current FROM lineitem)
    SELECT snapshot, sha256(string_agg(name || '=' || digest, ';' ORDER BY name, digest)) AS id, CASE WHEN bool_or(current IS NULL) THEN 'unknown' WHEN bool_or(current <> digest) THEN 'drifted' ELSE 'fresh' END AS freshness FROM c GROUP BY snapshot""")
def t10_snapshots(spark, sf):
    d = F.md5(F.col("l_suppkey").cast("string"))
    current = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 3), F.lit(None)).when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 2), F.md5(F.lit("other"))).otherwise(d)
    return J.snapshot_id(rel(spark, sf, "lineitem").select(F.col("l_orderkey").alias("snapshot"), F.concat(F.lit("c"), "l_linenumber").alias("name"), d.alias("digest"), current.alias("current")))
