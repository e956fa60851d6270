"""Queries on sessions: face scores, decisions, life cycle and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.functions import text
from passplane.operators import catalog, consolidate, decision, sessions
from passplane.plans.derived import AS_OF, CAPTURES, CATALOG, CODES, FACES, captures, type_of
from passplane.sources.tables import table

EXPIRY = "date_format(o_orderdate + interval 3 years, 'yyyy-MM-dd')"
NUMBER = "lpad(concat('', o_custkey), 8, '0')"
#: The back's number: as many wrong characters as the order's number modulo 5.
WRONG = "concat(substr(number, 1, cast(8 - o_orderkey % 5 as int)), repeat('X', cast(o_orderkey % 5 as int)))"


def q_worst_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face scores and the session's score."""
    return decision.face_scores(captures(spark, sf_dir)).select("session_id", "front", "back", "score")


def q_veto_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by whether any face has a veto."""
    return decision.face_scores(captures(spark, sf_dir)).select("session_id", "veto")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(EXPIRY).alias("expiry"), F.expr(NUMBER).alias("number"), type_of("o_custkey").alias("document_type"))
    orders = orders.withColumn("back_number", F.expr(WRONG)).withColumn("document_number", F.when(F.col("o_orderkey") % 11 != 0, F.col("number")))
    rows = decision.face_scores(captures(spark, sf_dir)).join(orders, F.col("session_id") == F.col("o_orderkey"))
    rows = catalog.with_type(rows)
    valid = decision.not_expired(F.col("expiry"), F.to_date(F.lit(AS_OF)))
    match = F.when(F.col("front").isNotNull() & F.col("back").isNotNull(), decision.faces_match(F.col("number"), F.col("back_number")))
    rows = rows.withColumn("expired", F.col("expires") & ~valid).withColumn("mismatch", ~match).withColumn("photo_suspect", F.col("o_orderkey") % 97 == 0)
    return decision.decide(rows)


def q_session_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and reasons of every session."""
    return _decided(spark, sf_dir).select("session_id", "document_type", "score", "outcome", F.array_join("reasons", ",").alias("reasons"))


def q_decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by outcome and reasons."""
    rows = _decided(spark, sf_dir).groupBy("outcome", F.array_join("reasons", ",").alias("reasons"))
    return rows.agg(F.count("*").alias("sessions"), F.min("score").alias("least_score"))


_DECIDED = f"""WITH {FACES}, {CATALOG}, base AS (SELECT f.*, o_orderkey, c.code AS document_type, expires, lpad(concat('', o_custkey), 8, '0') AS number,
strftime(o_orderdate + INTERVAL 3 YEAR, '%Y-%m-%d') AS expiry FROM faces f JOIN orders ON session_id = o_orderkey JOIN catalog c ON place = o_custkey % 14),
flags AS (SELECT *, expires AND expiry < '{AS_OF}' AS expired, front IS NOT NULL AND back IS NOT NULL AND
levenshtein(number, concat(substr(number, 1, (8 - o_orderkey % 5)::INT), repeat('X', (o_orderkey % 5)::INT))) > 2 AS mismatch FROM base),
decided AS (SELECT *, CASE WHEN veto THEN 'AUTHENTICITY_VETO' WHEN expired THEN 'DOCUMENT_EXPIRED' ELSE concat_ws(',',
CASE WHEN o_orderkey % 97 = 0 THEN 'PHOTO_SUBSTITUTION_SUSPECT' END, CASE WHEN mismatch THEN 'FRONT_BACK_MISMATCH' END,
CASE WHEN score IS NULL THEN 'AUTHENTICITY_UNAVAILABLE' WHEN score < 0.70 THEN 'LOW_AUTHENTICITY_SCORE' END,
CASE WHEN o_orderkey % 11 = 0 THEN 'DOCUMENT_NUMBER_NOT_READ' END) END AS reasons FROM flags),
outcomes AS (SELECT *, CASE WHEN veto OR expired THEN 'REJECTED' WHEN reasons <> '' THEN 'REVIEW' ELSE 'APPROVED' END AS outcome FROM decided)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = (F.floor("value").cast("bigint") % 100).cast("double") / 100
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("field"), F.col("props").alias("value"), confidence.alias("confidence"), F.col("event_id").alias("ord"))


def q_best_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident value of each field, the first of equals."""
    return consolidate.best_values(_fields(spark, sf_dir), ["session_id", "field"], ["ord"]).select("session_id", "field", "ord", "value", "confidence")


_NAMES = ["apellidos", "nombre", "nombres", "fechaVencimiento", "fechaValidez", "rh"]


def q_field_rename_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields under their contract names, the best of each; names that meet in one are merged."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("ord") % 6 + 1).cast("int"))
    rows = _fields(spark, sf_dir).withColumn("field", name).withColumn("value", F.when(F.col("ord") % 17 == 0, " ").otherwise(F.col("value")))
    return consolidate.contract_fields(rows, ["session_id"], ["ord"]).select("session_id", "field", "ord", "confidence")


def q_cross_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between a name and a damaged copy, and whether both pass as one."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("concat(substr(c_name, 1, cast(length(c_name) - c_custkey % 4 as int)), repeat('X', cast(c_custkey % 4 as int)))").alias("other"))
    a, b = F.col("c_name"), F.col("other")
    return rows.select("c_custkey", decision.edits(a, b).alias("distance"), decision.faces_match(a, b).alias("passed"))


def q_expiry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document is still valid; null where the expiry is no date."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"case when o_orderkey % 13 = 0 then '1998-13-45' else {EXPIRY} end").alias("expiry"))
    return rows.select("o_orderkey", "expiry", decision.not_expired(F.col("expiry"), F.to_date(F.lit(AS_OF))).alias("valid"))


_AT = "1998-06-01 00:30:00"


def q_session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a reader sees them half an hour after creation and later."""
    at = F.to_timestamp_ntz(F.lit(_AT))
    rows = table(spark, sf_dir, "orders").withColumn("expires_at", sessions.deadline(F.col("o_orderdate")))
    status = F.when(F.col("o_orderkey") % 3 == 0, "COMPLETED").otherwise("IN_PROGRESS")
    return rows.select("o_orderkey", F.date_format("expires_at", "yyyy-MM-dd HH:mm").alias("expires_at"), sessions.is_expired(F.col("expires_at"), at).alias("expired"), sessions.lazily_expired(status, F.col("expires_at"), at).alias("status"))


def q_session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and missing sides of every order's session."""
    sides = captures(spark, sf_dir).groupBy("session_id").agg(F.collect_set("side").alias("captured"))
    orders = catalog.with_type(table(spark, sf_dir, "orders").select("o_orderkey", type_of("o_custkey").alias("document_type")))
    rows = orders.join(sides, F.col("o_orderkey") == F.col("session_id"), "left").withColumn("captured", F.coalesce("captured", F.array().cast("array<string>")))
    return rows.select("o_orderkey", "document_type", sessions.status(F.col("sides"), F.col("captured")).alias("status"), F.array_join(sessions.missing_sides(F.col("sides"), F.col("captured")), ",").alias("missing"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_linenumber") <= 3, "FRONT").otherwise("BACK")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), side.alias("side"), "l_linenumber", "l_partkey", "l_suppkey")


def q_first_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture of each side that stays without and with replacement."""
    keys, order = ["session_id", "side"], ["l_linenumber", "l_partkey", "l_suppkey"]
    first, last = (sessions.kept_capture(_attempts(spark, sf_dir), keys, order, replace=r) for r in (False, True))
    last = last.select(*keys, F.col("l_partkey").alias("last_part"), F.col("l_linenumber").alias("last_line"))
    return first.select(*keys, F.col("l_partkey").alias("first_part"), F.col("l_linenumber").alias("first_line"), "attempts").join(last, keys)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", type_of("c_custkey", 16).alias("document_type"))


def q_catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by type with the catalog's columns."""
    rows = catalog.with_type(_requests(spark, sf_dir))
    return rows.groupBy("document_type", "country", F.array_join("sides", ",").alias("sides"), "has_mrz", "mrz_format", "supports_nfc", "expires").agg(F.count("*").alias("requests"))


def q_unsupported_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose type is not in the catalog."""
    return catalog.unsupported(_requests(spark, sf_dir)).select("c_custkey", "document_type")


def q_side_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose side their type does not have."""
    rows = captures(spark, sf_dir).withColumn("document_type", type_of("session_id"))
    rows = catalog.with_type(rows).where(~sessions.allowed_side(F.col("sides"), F.col("side")))
    return rows.select("session_id", "side", "document_type")


def q_geo_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with requests."""
    rows = _requests(spark, sf_dir).withColumn("document_type", F.when(F.col("c_custkey") % 9 != 0, F.col("document_type")).otherwise(" "))
    errors = sessions.request_errors(F.col("document_type"), F.col("c_acctbal") / 100, F.col("c_acctbal") / 50, F.expr("repeat(c_name, cast(c_custkey % 40 as int))"))
    return rows.select("c_custkey", F.array_join(errors, ",").alias("errors"))


def q_country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by country, with the country's codes in order."""
    own = catalog.with_type(_requests(spark, sf_dir)).groupBy("country").agg(F.count("*").alias("requests"))
    return own.join(F.broadcast(catalog.by_country(spark)), "country").select("country", "requests", F.array_join("codes", ",").alias("codes"))


def q_image_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a capture's image is kept, and a digest of its keys."""
    return captures(spark, sf_dir).select("session_id", "side", sessions.image_path("images", F.col("session_id").cast("string"), F.col("side")).alias("path"), F.sha2(F.concat_ws("|", "session_id", "side"), 256).alias("sha256"))


def q_capture_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of urgent orders' sessions."""
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("session_id"))
    return sessions.lookup(captures(spark, sf_dir), wanted, ["session_id"]).select("session_id", "side", "authenticity_score")


def q_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and digests of uploaded content; pages stand for images, every seventh without content."""
    page = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.col("html")).cast("binary")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("session_id"), F.when(F.col("page_id") % 2 == 0, "FRONT").otherwise("BACK").alias("side"), page.alias("content"))
    return sessions.uploaded(rows, "content", "images")


def q_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two passes over a picture joined; every third second pass is blank."""
    second = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.substring("text", 1, 40))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.both_passes(F.col("text"), second).cast("binary")).alias("digest"))


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after an update of every third, by key and version."""
    old = table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).alias("version"), F.col("c_mktsegment").alias("segment"))
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit(1).alias("version"), F.lit("UPDATED").alias("segment"))
    return sessions.upsert(old, new, ["c_custkey"], "version")


QUERIES = {f.__name__: f for f in (q_worst_face, q_veto_any, q_session_decision, q_decision_summary, q_best_field, q_field_rename_merge, q_cross_levenshtein, q_expiry_check, q_session_ttl, q_session_status, q_first_or_replace, q_catalog_join, q_unsupported_type, q_side_allowed, q_geo_validation, q_country_codes, q_image_path, q_capture_lookup, q_upload, q_two_passes, q_upsert)}

_FIELDS = "fields AS (SELECT user_id AS session_id, event_type AS field, props AS value, (floor(value)::BIGINT % 100)::DOUBLE / 100 AS confidence, event_id AS ord FROM events)"
_RENAMED = "CASE ord % 6 WHEN 0 THEN 'lastNames' WHEN 1 THEN 'firstNames' WHEN 2 THEN 'firstNames' WHEN 5 THEN 'rh' ELSE 'expiryDate' END"
_TYPE = "CASE " + " ".join(f"WHEN {{key}} % {{n}} = {k} THEN '{c}'" for k, c in enumerate(CODES)) + " ELSE 'UNKNOWN_TYPE' END"
_REQUESTS = f"requests AS (SELECT c_custkey, c_name, c_acctbal, {_TYPE.format(key='c_custkey', n=16)} AS document_type FROM customer)"

SQL = {
    "q_worst_face": f"WITH {FACES} SELECT session_id, front, back, score FROM faces",
    "q_veto_any": f"WITH {FACES} SELECT session_id, veto FROM faces",
    "q_session_decision": f"{_DECIDED} SELECT session_id, document_type, score, outcome, reasons FROM outcomes",
    "q_decision_summary": f"{_DECIDED} SELECT outcome, reasons, count(*) AS sessions, min(score) AS least_score FROM outcomes GROUP BY 1, 2",
    "q_best_field": f"WITH {_FIELDS} SELECT session_id, field, ord, value, confidence FROM fields QUALIFY row_number() OVER (PARTITION BY session_id, field ORDER BY confidence DESC, ord) = 1",
    "q_field_rename_merge": f"WITH {_FIELDS} SELECT session_id, {_RENAMED} AS field, ord, confidence FROM fields WHERE ord % 17 <> 0 AND trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY session_id, {_RENAMED} ORDER BY confidence DESC, ord) = 1",
    "q_cross_levenshtein": "WITH n AS (SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9 ]', '', 'g') AS a, regexp_replace(upper(concat(substr(c_name, 1, (length(c_name) - c_custkey % 4)::INT), repeat('X', (c_custkey % 4)::INT))), '[^A-Z0-9 ]', '', 'g') AS b FROM customer) SELECT c_custkey, levenshtein(a, b)::INT AS distance, levenshtein(a, b) <= 2 AS passed FROM n",
    "q_expiry_check": f"SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '1998-13-45' ELSE strftime(o_orderdate + INTERVAL 3 YEAR, '%Y-%m-%d') END AS expiry, CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate + INTERVAL 3 YEAR, '%Y-%m-%d') >= '{AS_OF}' END AS valid FROM orders",
    "q_session_ttl": f"WITH s AS (SELECT o_orderkey, o_orderdate + INTERVAL 30 MINUTE AS e FROM orders) SELECT o_orderkey, strftime(e, '%Y-%m-%d %H:%M') AS expires_at, TIMESTAMP '{_AT}' > e AS expired, CASE WHEN o_orderkey % 3 = 0 THEN 'COMPLETED' WHEN TIMESTAMP '{_AT}' > e THEN 'EXPIRED' ELSE 'IN_PROGRESS' END AS status FROM s",
    "q_session_status": f"WITH {CAPTURES}, {CATALOG}, own AS (SELECT session_id, bool_or(side = 'FRONT') AS f, bool_or(side = 'BACK') AS b FROM captures GROUP BY 1), j AS (SELECT o_orderkey, code AS document_type, sides LIKE '%BACK%' AS two, coalesce(f, false) AS f, coalesce(b, false) AS b FROM orders JOIN catalog ON place = o_custkey % 14 LEFT JOIN own ON session_id = o_orderkey) SELECT o_orderkey, document_type, CASE WHEN NOT f AND NOT b THEN 'CREATED' WHEN f AND (b OR NOT two) THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status, concat_ws(',', CASE WHEN NOT f THEN 'FRONT' END, CASE WHEN two AND NOT b THEN 'BACK' END) AS missing FROM j",
    "q_first_or_replace": "WITH a AS (SELECT l_orderkey AS session_id, CASE WHEN l_linenumber <= 3 THEN 'FRONT' ELSE 'BACK' END AS side, l_linenumber, l_partkey, l_suppkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, side ORDER BY l_linenumber, l_partkey, l_suppkey) AS up, row_number() OVER (PARTITION BY session_id, side ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS down FROM a) SELECT session_id, side, max(CASE WHEN up = 1 THEN l_partkey END) AS first_part, max(CASE WHEN up = 1 THEN l_linenumber END) AS first_line, count(*) AS attempts, max(CASE WHEN down = 1 THEN l_partkey END) AS last_part, max(CASE WHEN down = 1 THEN l_linenumber END) AS last_line FROM r GROUP BY 1, 2",
    "q_catalog_join": f"WITH {_REQUESTS}, {CATALOG} SELECT document_type, country, sides, has_mrz, mrz_format, supports_nfc, expires, count(*) AS requests FROM requests JOIN catalog ON code = document_type GROUP BY ALL",
    "q_unsupported_type": f"WITH {_REQUESTS} SELECT c_custkey, document_type FROM requests WHERE document_type = 'UNKNOWN_TYPE'",
    "q_side_allowed": f"WITH {CAPTURES}, {CATALOG} SELECT session_id, side, code AS document_type FROM captures JOIN catalog ON place = session_id % 14 WHERE NOT contains(sides, side)",
    "q_geo_validation": f"WITH {_REQUESTS} SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 9 = 0 THEN 'documentType' END, CASE WHEN abs(c_acctbal / 100) > 90 THEN 'geolocation.lat' END, CASE WHEN abs(c_acctbal / 50) > 180 THEN 'geolocation.lng' END, CASE WHEN length(c_name) * (c_custkey % 40) > 512 THEN 'userAgent' END) AS errors FROM requests",
    "q_country_codes": f"WITH {_REQUESTS}, {CATALOG}, l AS (SELECT country, string_agg(code, ',' ORDER BY code) AS codes FROM catalog GROUP BY 1) SELECT country, count(*) AS requests, codes FROM requests JOIN catalog ON code = document_type JOIN l USING (country) GROUP BY country, codes",
    "q_image_path": f"WITH {CAPTURES} SELECT session_id, side, concat('images/', session_id, '/', side, '.jpg') AS path, sha256(concat(session_id, '|', side)) AS sha256 FROM captures",
    "q_capture_lookup": f"WITH {CAPTURES} SELECT session_id, side, authenticity_score FROM captures WHERE session_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "q_upload": "SELECT page_id AS session_id, CASE WHEN page_id % 2 = 0 THEN 'FRONT' ELSE 'BACK' END AS side, concat('images/', page_id, '/', CASE WHEN page_id % 2 = 0 THEN 'FRONT' ELSE 'BACK' END, '.jpg') AS image_path, sha256(html) AS image_sha256 FROM pages WHERE page_id % 7 <> 0 AND length(html) > 0",
    "q_two_passes": "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 OR trim(substr(text, 1, 40)) = '' THEN text ELSE concat(text, chr(10), substr(text, 1, 40)) END) AS digest FROM documents",
    "q_upsert": "SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)::INT AS version, CASE WHEN c_custkey % 3 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS segment FROM customer",
}
