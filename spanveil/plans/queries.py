"""The registered queries of the scan, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.actions import register_action, register_python_action
from ..functions.fixed import DEFAULT_POLICY_ENTITIES, PATTERNS
from ..functions.text import chunk_by_paragraph
from ..operators.analytics import by_type, density, evaluate, gaps
from ..operators.layers import register_detector, register_ner_model
from ..operators.scan import reapply, redacted, scan, violations
from ..operators.sensitivity import is_sensitive
from ..sources.backends import use_backend
from ..sources.dry_run import DryRunBackend
from ..sources.tables import guard_requests, json_leaves, spread
from ..streaming.scan import run_to, scan_stream, stream_files
from .planted import PLANTED, K, Planted
from .policy import Policy

Query = Callable[[SparkSession, str], DataFrame]
SALT = "pepper"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def only(*entities: str, action: str = "redact") -> Policy:
    return Policy(salt=SALT).with_entities(entities, action=action, layers=["regex"])


def everything(action: str = "hash") -> Policy:
    return only(*PATTERNS, action=action)


def planted(spark: SparkSession, sf_dir: str, p: Planted) -> DataFrame:
    return table(spark, sf_dir, "customer").select(K, F.expr(p.text).alias("text"))


def found(df: DataFrame, policy: Policy, key: str) -> DataFrame:
    return violations(scan(df, policy), key).select(key, "entity_type", "original", "start", "end")


def _planted_query(p: Planted) -> Query:
    return lambda spark, d: found(planted(spark, d, p), only(p.entity), K)


# over the documents


def pii_all_documents(spark: SparkSession, d: str) -> DataFrame:
    """All pattern layers, hashed: the headline of the benchmark."""
    s = scan(documents(spark, d), everything())
    return s.select("doc_id", "scan.sanitized_text", "scan.is_clean", F.size("scan.violations").alias("violations"))


def pii_spans_email(spark: SparkSession, d: str) -> DataFrame:
    return found(documents(spark, d), only("EMAIL"), "doc_id")


def pii_spans_ipv4(spark: SparkSession, d: str) -> DataFrame:
    return found(documents(spark, d), only("IP_ADDRESS"), "doc_id")


def pii_values_card(spark: SparkSession, d: str) -> DataFrame:
    return found(documents(spark, d), only("CREDIT_CARD"), "doc_id").filter("length(original) = 16").select("doc_id", "original")


def pii_values_tc_id(spark: SparkSession, d: str) -> DataFrame:
    return found(documents(spark, d), only("TC_ID"), "doc_id").select("doc_id", "original")


def pii_density_by_lang_source(spark: SparkSession, d: str) -> DataFrame:
    return density(scan(documents(spark, d), only("EMAIL", "IP_ADDRESS")), "lang", "source")


def pii_rollup_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return by_type(violations(scan(documents(spark, d), only("EMAIL", "IP_ADDRESS")), "lang"), "lang", rollup=True)


def pii_gaps(spark: SparkSession, d: str) -> DataFrame:
    return gaps(violations(scan(documents(spark, d), only("IP_ADDRESS")), "doc_id"), "doc_id").select("doc_id", "start", "number", F.coalesce("gap", F.lit(-1)).alias("gap"))


def pii_docs_vs_labels(spark: SparkSession, d: str) -> DataFrame:
    s = scan(documents(spark, d), only("EMAIL")).select("doc_id", (~F.col("scan.is_clean")).alias("has_email"))
    return s.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "has_email").agg(F.count(F.lit(1)).alias("documents"))


def redacted_view(spark: SparkSession, d: str) -> DataFrame:
    s = redacted(scan(documents(spark, d), only("EMAIL")))
    return s.select("doc_id", "scan.sanitized_text", "scan.is_clean")


def pages_scan(spark: SparkSession, d: str) -> DataFrame:
    return found(spread(table(spark, d, "pages").select("page_id", F.col("html").alias("text"))), only("EMAIL"), "page_id")


def conversations_scan(spark: SparkSession, d: str) -> DataFrame:
    s = scan(spread(table(spark, d, "conversations")), only("EMAIL"))
    return s.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.col("scan.is_clean").cast("long")).alias("clean"))


def stream_scan_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same spans as pii_spans_email, from a stream of files."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spanveil-")
    base = f"{root.rstrip('/')}/spanveil-{uuid.uuid4().hex}"
    stream = stream_files(spark, f"{d}/documents.parquet", table(spark, d, "documents").schema)
    s = violations(scan_stream(stream.select("doc_id", "text"), only("EMAIL")), "doc_id")
    run_to(s.select("doc_id", "entity_type", "original", "start", "end"), f"{base}-out", f"{base}-state")
    return spark.read.schema("doc_id long, entity_type string, original string, start int, end int").parquet(f"{base}-out")


# actions


def _action_query(name: str, action: str) -> Query:
    return lambda spark, d: scan(planted(spark, d, PLANTED[name]), only(PLANTED[name].entity, action=action)).select(K, "scan.sanitized_text")


def _sanitised(name: str, replacement: str) -> str:
    p = PLANTED[name]
    return f"SELECT {K}, concat({p.before}, {replacement}, {p.after}) AS sanitized_text FROM customer"


def reapply_mask(spark: SparkSession, d: str) -> DataFrame:
    s = scan(planted(spark, d, PLANTED["ssn"]), only("SSN", action="hash"))
    return reapply(s, "mask").select(K, "scan.sanitized_text")


def reapply_subset(spark: SparkSession, d: str) -> DataFrame:
    """Only the e-mails are redacted again; the rest stays as it was in the original."""
    text = f"concat('mail ', {PLANTED['email'].value}, ' ssn ', {PLANTED['ssn'].value})"
    s = scan(table(spark, d, "customer").select(K, F.expr(text).alias("text")), only("EMAIL", "SSN", action="hash"))
    return reapply(s, "redact", ["EMAIL"]).select(K, "scan.sanitized_text")


# filters and span sets


def allowlist(spark: SparkSession, d: str) -> DataFrame:
    policy = only("EMAIL").with_allowed("user7@mail.example.com", "user8@mail.example.com")
    return found(planted(spark, d, PLANTED["email"]), policy, K)


def denylist_value(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(K, F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("text"))
    return found(names, Policy().with_denied(value="BUILDING", entity="SEGMENT"), K)


def denylist_pattern(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(K, F.col("c_name").alias("text"))
    return found(names, Policy().with_denied(pattern=r"#0*[1-9]\d*5$", entity="FIVE"), K)


def custom_pattern(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(K, F.col("c_name").alias("text"))
    return found(names, Policy().with_custom_pattern("CUSTOMER_NO", r"(?<=#)\d+", "redact"), K)


OVERLAP = Planted("CUSTOM", PLANTED["email"].before, PLANTED["email"].value)


def overlap_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A denied value inside an e-mail address is surer than the address and takes its place."""
    return found(planted(spark, d, PLANTED["email"]), only("EMAIL").with_denied(value="@mail.example"), K)


def overlap_length(spark: SparkSession, d: str) -> DataFrame:
    """Of equally sure spans the longer one stays: a labelled ZIP over the Turkish postal code inside."""
    text = table(spark, d, "customer").select(K, F.expr(f"concat('zip code: ', lpad(cast({K} % 80000 + 1000 as string), 5, '0'))").alias("text"))
    return found(text, only("US_ZIP_CODE", "POSTAL_CODE"), K)


def iban_run(spark: SparkSession, d: str) -> DataFrame:
    """A run without separators that splits exactly into valid numbers; one with a letter too many has none."""
    run = f"concat('TR330006100519786457841326', 'DE89370400440532013000', case when {K} % 2 = 1 then 'X' else '' end)"
    return found(table(spark, d, "customer").select(K, F.expr(f"concat('pay ', {run})").alias("text")), only("IBAN"), K)


def tie_order(spark: SparkSession, d: str) -> DataFrame:
    """Of equally sure, long and early spans the layer that comes first stays: patterns, then own patterns in their order."""
    text = table(spark, d, "customer").select(K, F.expr(f"concat('10.0.0.', cast({K} % 200 as string), ' id-', cast({K} as string))").alias("text"))
    policy = only("IP_ADDRESS").with_custom_pattern("NUMBERS", r"\d+\.\d+\.\d+\.\d+").with_custom_pattern("FIRST", r"id-\d+").with_custom_pattern("SECOND", r"id-\d+")
    return found(text, policy, K)


def own_action(spark: SparkSession, d: str) -> DataFrame:
    """Actions of one's own, as an expression and in Python."""
    register_action("upper", lambda s, c: F.upper(s["text"]))
    register_python_action("reversed", lambda kind, text, c: text[::-1])
    text = table(spark, d, "customer").select(K, F.expr(f"concat('mail user', cast({K} as string), '@mail.example.com ssn 123-45-6789')").alias("text"))
    policy = only("EMAIL", action="upper").with_entity("SSN", "reversed", ["regex"])
    return scan(text, policy).select(K, "scan.sanitized_text")


def failing_layer(spark: SparkSession, d: str) -> DataFrame:
    """A detector that fails on every third row gives a warning there; the other layers' findings stay."""
    register_detector("fails-on-thirds", _fails_on_thirds)
    text = table(spark, d, "customer").select(K, F.expr(f"concat(cast({K} % 3 as string), ' a@b.com')").alias("text"))
    s = scan(text, only("EMAIL").with_detector("fails-on-thirds"))
    return s.select(K, F.size("scan.violations").alias("violations"), F.concat_ws("|", "scan.warnings").alias("warnings"))


def _fails_on_thirds(text: str) -> list[tuple[str, int, int, float]]:
    if text.startswith("0"):
        raise ValueError("a multiple of three")
    return [("REST", 0, 1, 0.9)]


def propagation(spark: SparkSession, d: str) -> DataFrame:
    """A model names a person once; every other mention that no letter touches is found too."""
    use_backend("ollama", lambda: DryRunBackend())
    register_ner_model("first-mention", _first_mention)
    text = table(spark, d, "customer").select(K, F.expr(f"concat('Zoe Quill wrote. Zoe Quills did not; Zoe Quill ', cast({K} as string))").alias("text"))
    use_backend("ollama", None)
    policy = Policy().with_entity("PERSON", "redact", ["ner"]).with_ner("first-mention").with_propagation()
    return found(text, policy, K)


def _first_mention():
    def model(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        return [[("PER", t.find("Zoe Quill"), t.find("Zoe Quill") + 9)] if "Zoe Quill" in t else [] for t in texts]

    return model


def ner_filters(spark: SparkSession, d: str) -> DataFrame:
    """What a model names is dropped if it is all job titles, or no person's name."""
    register_ner_model("everything-is-a-person", _everything_is_a_person)
    text = table(spark, d, "customer").select(K, F.expr(f"case {K} % 4 when 0 then 'Senior Backend Engineer' when 1 then 'Zoe Quill' when 2 then 'Main Street' else 'No:42 x' end").alias("text"))
    return found(text, Policy().with_entity("PERSON", "redact", ["ner"]).with_ner("everything-is-a-person"), K)


def _everything_is_a_person():
    return lambda texts: [[("PERSON", 0, len(t))] for t in texts]


def confusable_fold(spark: SparkSession, d: str) -> DataFrame:
    """A Cyrillic letter in an address and full-width digits in a number hide nothing; the original is reported."""
    text = table(spark, d, "customer").select(K, F.expr(f"concat('us\\u0435r', cast({K} as string), '@m\\u0430il.example.com and 123-45-678\\uFF19')").alias("text"))
    return found(text, only("EMAIL", "SSN"), K)


def size_guard(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    s = scan(documents(spark, d), replace(only("EMAIL"), max_text_bytes=5_000))
    return s.select("doc_id", F.col("scan.scan_error"), (F.col("scan.sanitized_text") == F.col("text")).alias("kept"))


def pr_eval(spark: SparkSession, d: str) -> DataFrame:
    """Every third row's number is broken, so it must not be found; the gold table has it nevertheless."""
    p = PLANTED["tc_id"]
    rows = table(spark, d, "customer").select(K, F.expr(p.value).alias("value"))
    text = rows.select(K, F.expr(f"concat('id ', case when {K} % 3 = 0 then concat(substr(value, 1, 10), cast((cast(substr(value, 11, 1) as int) + 1) % 10 as string)) else value end)").alias("text"))
    gold = rows.select(K, F.lit("TC_ID").alias("entity_type"), "value")
    got = found(text, only("TC_ID"), K).select(K, "entity_type", F.col("original").alias("value"))
    return evaluate(gold, got, K)


# model layers


def _with_stub(**settings: object) -> Policy:
    use_backend("ollama", lambda: DryRunBackend({"Zoe Quill": "PERSON", "Pw-secret": "CUSTOM_SECRET"}))
    return Policy().with_llm(**settings)


def llm_stub(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "customer").select(K, F.expr(f"concat('Order ', cast({K} as string), ' is for Zoe Quill, code Pw-secret')").alias("text"))
    return found(text, _with_stub(), K)


def llm_adjudication(spark: SparkSession, d: str) -> DataFrame:
    """A pattern's finding is kept whatever the model says; the other model's finding that it doesn't repeat goes."""
    register_ner_model("first-word", lambda: lambda texts: [[("ORG", 0, 4)] for t in texts])
    text = table(spark, d, "customer").select(K, F.expr(f"concat('Acme wrote to Zoe Quill at ', {PLANTED['email'].value})").alias("text"))
    policy = _with_stub(adjudicate=True).with_entities({"EMAIL": "hash", "ORG": "redact"}, layers=["regex", "ner"]).with_ner("first-word")
    return found(text, policy, K)


def sensitivity_stub(spark: SparkSession, d: str) -> DataFrame:
    return is_sensitive(documents(spark, d), _with_stub()).select("doc_id", "is_sensitive")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs joined up to 800 characters; a chunk's text is where it says."""
    kind = "array<struct<text:string,start:int>>"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": c, "start": a} for c, a in chunk_by_paragraph(t, 800)] for t in texts])

    rows = documents(spark, d).select("doc_id", "text", F.posexplode(cut("text")).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.col("c.start").alias("start"), F.length("c.text").alias("length"), (F.substring("text", F.col("c.start") + 1, F.length("c.text")) == F.col("c.text")).alias("in_place"))


def json_leaf_scan(spark: SparkSession, d: str) -> DataFrame:
    """Texts inside JSON documents are scanned one by one; keys are no texts."""
    body = f"concat('{{\"a@b.example.com\": {{\"mail\": \"', {PLANTED['email'].value}, '\"}}, \"n\": [1, \"x\"]}}')"
    leaves = json_leaves(table(spark, d, "customer").select(K, F.expr(body).alias("body")), K, "body")
    return violations(scan(leaves, only("EMAIL")), K, "path").select(K, "path", "original", "start")


def guard_requests_block(spark: SparkSession, d: str) -> DataFrame:
    body = f"concat('{{\"note\": \"', case when {K} % 2 = 0 then {PLANTED['email'].value} else 'nothing' end, '\", \"n\": [1, \"x\"]}}')"
    return guard_requests(table(spark, d, "customer").select(K, F.expr(body).alias("body")), only("EMAIL"), K, "body")


def policy_entities(spark: SparkSession, d: str) -> DataFrame:
    """What the built-in policy looks for, and what it does."""
    rows = [F.struct(F.lit(k).alias("entity_type"), F.lit(a).alias("action")) for k, a in Policy.load("default").entity_policy().items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def queries() -> dict[str, Query]:
    found_: dict[str, Query] = {
        "pii_all_documents": pii_all_documents, "pii_spans_email": pii_spans_email, "pii_spans_ipv4": pii_spans_ipv4, "pii_values_card": pii_values_card,
        "pii_values_tc_id": pii_values_tc_id, "pii_density_by_lang_source": pii_density_by_lang_source, "pii_rollup_by_lang": pii_rollup_by_lang, "pii_gaps": pii_gaps,
        "pii_docs_vs_labels": pii_docs_vs_labels, "redacted_view": redacted_view, "pages_scan": pages_scan, "conversations_scan": conversations_scan,
        "stream_scan_documents": stream_scan_documents, "reapply_mask": reapply_mask, "reapply_subset": reapply_subset, "allowlist": allowlist,
        "denylist_value": denylist_value, "denylist_pattern": denylist_pattern, "custom_pattern": custom_pattern, "overlap_resolution": overlap_resolution,
        "overlap_length": overlap_length, "propagation": propagation, "ner_filters": ner_filters, "confusable_fold": confusable_fold, "size_guard": size_guard,
        "pr_eval": pr_eval, "llm_stub": llm_stub, "llm_adjudication": llm_adjudication, "sensitivity_stub": sensitivity_stub, "chunks": chunks,
        "iban_run": iban_run, "tie_order": tie_order, "own_action": own_action, "failing_layer": failing_layer,
        "json_leaf_scan": json_leaf_scan, "guard_requests_block": guard_requests_block, "policy_entities": policy_entities,
    }
    found_ |= {f"pii_{n}_planted": _planted_query(p) for n, p in PLANTED.items()}
    found_ |= {f"action_{a}_{n}": _action_query(n, a) for a, n in ACTION_CASES}
    return found_


ACTION_CASES = [("warn", "email"), ("hash", "email"), ("redact", "email"), *[("mask", n) for n in ("credit_card", "email", "phone", "ssn", "iban", "tc_id", "nin", "uuid")]]

# SQL

EMAIL_RE2 = r"[\pL\pN_.%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,}"
IPV4_RE2 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"


def spans_sql(entity: str, pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text", more: str = "") -> str:
    """Matches and their places, from the matches and the pieces between them."""
    return f"""
WITH m AS (SELECT {key}{more}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {source}),
e AS (SELECT {key}{more}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m),
p AS (SELECT {key}{more}, ms[i] AS original,
  cast(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS int) AS start FROM e)
SELECT {key}{more}, '{entity}' AS entity_type, original, start, cast(start + length(original) AS int) AS "end" FROM p"""


EMAIL_SQL, IPV4_SQL = spans_sql("EMAIL", EMAIL_RE2), spans_sql("IP_ADDRESS", IPV4_RE2)
BOTH_SQL = f"(SELECT * FROM ({spans_sql('EMAIL', EMAIL_RE2, more=', lang, source')}) UNION ALL SELECT * FROM ({spans_sql('IP_ADDRESS', IPV4_RE2, more=', lang, source')}))"
NON_DIGITS = r"regexp_replace(text, '(\D)', '\1\1', 'g')"


def mask_sql(name: str) -> str:
    v = PLANTED[name].value
    n = f"length({v})"
    return {
        "credit_card": f"concat(repeat('*', 12), right({v}, 4))",
        "email": f"concat('u', repeat('*', cast(length(cast({K} as string)) + 3 as int)), '@mail.example.com')",
        "phone": f"concat(repeat('*', {n} - 4), right({v}, 4))",
        "ssn": f"concat('***-**-', right({v}, 4))",
        "iban": f"concat('DE', repeat('*', {n} - 6), right({v}, 4))",
        "tc_id": f"concat('********', right({v}, 3))",
        "nin": f"concat('******', right({v}, 3))",
        "uuid": f"concat(left({v}, 2), repeat('*', 32), right({v}, 2))",
    }[name]


def oracle_sql() -> dict[str, str]:
    email = PLANTED["email"]
    out = {f"pii_{n}_planted": p.expected() for n, p in PLANTED.items()}
    out |= {f"action_mask_{n}": _sanitised(n, mask_sql(n)) for a, n in ACTION_CASES if a == "mask"}
    out |= {
        "action_warn_email": _sanitised("email", email.value),
        "action_hash_email": _sanitised("email", f"concat('[EMAIL:', substr(sha256(concat('{SALT}', {email.value})), 1, 16), ']')"),
        "action_redact_email": _sanitised("email", "'[EMAIL]'"),
        "reapply_mask": _sanitised("ssn", mask_sql("ssn")),
        "reapply_subset": f"SELECT {K}, concat('mail [EMAIL] ssn ', {PLANTED['ssn'].value}) AS sanitized_text FROM customer",
        "pii_spans_email": EMAIL_SQL,
        "stream_scan_documents": EMAIL_SQL,
        "pii_spans_ipv4": IPV4_SQL,
        "pages_scan": spans_sql("EMAIL", EMAIL_RE2, "pages", "page_id", "html"),
        "pii_values_card": f"""
WITH v AS (SELECT doc_id, unnest(regexp_extract_all({NON_DIGITS}, '(?:^|\\D)((?:4[0-9]{{15}}|5[1-5][0-9]{{14}}|6(?:011|5[0-9]{{2}})[0-9]{{12}}))(?:\\D|$)', 1)) AS original FROM documents),
s AS (SELECT doc_id, original, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN
  CASE WHEN cast(original[i] AS int) > 4 THEN 2 * cast(original[i] AS int) - 9 ELSE 2 * cast(original[i] AS int) END ELSE cast(original[i] AS int) END)) AS total FROM v)
SELECT doc_id, original FROM s WHERE total % 10 = 0""",
        "pii_values_tc_id": f"""
WITH v AS (SELECT doc_id, unnest(regexp_extract_all({NON_DIGITS}, '(?:^|\\D)([1-9][0-9]{{10}})(?:\\D|$)', 1)) AS original FROM documents),
d AS (SELECT doc_id, original, list_transform(range(1, 12), lambda i: cast(original[i] AS int)) AS d FROM v)
SELECT doc_id, original FROM d WHERE (7 * (d[1] + d[3] + d[5] + d[7] + d[9]) - (d[2] + d[4] + d[6] + d[8]) + 100) % 10 = d[10]
  AND list_sum(d[1:10]) % 10 = d[11]""",
        "pii_density_by_lang_source": f"""
WITH v AS (SELECT doc_id, count(*) AS n FROM {BOTH_SQL} GROUP BY doc_id),
g AS (SELECT lang, source, count(*) AS documents, cast(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS bigint) AS with_findings, cast(sum(coalesce(n, 0)) AS bigint) AS violations,
  cast(sum(length(text)) AS bigint) AS characters FROM documents LEFT JOIN v USING (doc_id) GROUP BY lang, source)
SELECT *, round(violations * 1e6 / greatest(characters, 1), 6) AS per_million FROM g""",
        "pii_rollup_by_lang": f"SELECT lang, entity_type, count(*) AS violations, count(DISTINCT original) AS distinct_values FROM {BOTH_SQL} GROUP BY ROLLUP (lang, entity_type)",
        "pii_gaps": f"""SELECT doc_id, start, cast(row_number() OVER w AS int) AS number, cast(coalesce(start - lag("end") OVER w, -1) AS int) AS gap FROM ({IPV4_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY start)""",
        "pii_docs_vs_labels": f"""
WITH v AS (SELECT DISTINCT doc_id FROM ({EMAIL_SQL}))
SELECT quality, v.doc_id IS NOT NULL AS has_email, count(*) AS documents FROM documents d JOIN labels USING (doc_id) LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY ALL""",
        "redacted_view": f"""
SELECT doc_id, regexp_replace(text, '{EMAIL_RE2}', '[EMAIL]', 'g') AS sanitized_text, NOT regexp_matches(text, '{EMAIL_RE2}') AS is_clean FROM documents""",
        "conversations_scan": f"SELECT role, count(*) AS turns, count(*) FILTER (NOT regexp_matches(text, '{EMAIL_RE2}')) AS clean FROM conversations GROUP BY role",
        "allowlist": email.expected() + f" WHERE {K} NOT IN (7, 8)",
        "denylist_value": f"""
SELECT {K}, 'SEGMENT' AS entity_type, 'BUILDING' AS original, cast(length(c_name) + 4 AS int) AS start, cast(length(c_name) + 12 AS int) AS "end" FROM customer WHERE c_mktsegment = 'BUILDING'""",
        "denylist_pattern": f"""
SELECT {K}, 'FIVE' AS entity_type, regexp_extract(c_name, '#0*[1-9][0-9]*5$') AS original, cast(length(regexp_extract(c_name, '^[^#]*')) AS int) AS start, cast(length(c_name) AS int) AS "end"
FROM customer WHERE regexp_matches(c_name, '#0*[1-9][0-9]*5$')""",
        "custom_pattern": f"""
SELECT {K}, 'CUSTOMER_NO' AS entity_type, regexp_extract(c_name, '#([0-9]+)', 1) AS original, cast(instr(c_name, '#') AS int) AS start, cast(length(c_name) AS int) AS "end" FROM customer""",
        "overlap_resolution": f"""
SELECT {K}, 'CUSTOM' AS entity_type, '@mail.example' AS original, cast(instr({email.text}, '@') - 1 AS int) AS start, cast(instr({email.text}, '@') + 12 AS int) AS "end" FROM customer""",
        "overlap_length": f"""
SELECT {K}, 'US_ZIP_CODE' AS entity_type, concat('zip code: ', lpad(cast({K} % 80000 + 1000 as string), 5, '0')) AS original, 0 AS start, 15 AS "end" FROM customer""",
        "iban_run": f"""
SELECT {K}, 'IBAN' AS entity_type, 'TR330006100519786457841326' AS original, 4 AS start, 30 AS "end" FROM customer WHERE {K} % 2 = 0
UNION ALL SELECT {K}, 'IBAN', 'DE89370400440532013000', 30, 52 FROM customer WHERE {K} % 2 = 0""",
        "tie_order": f"""
WITH t AS (SELECT {K}, concat('10.0.0.', cast({K} % 200 AS string)) AS ip, concat('id-', cast({K} AS string)) AS id FROM customer)
SELECT {K}, 'IP_ADDRESS' AS entity_type, ip AS original, 0 AS start, cast(length(ip) AS int) AS "end" FROM t
UNION ALL SELECT {K}, 'FIRST', id, cast(length(ip) + 1 AS int), cast(length(ip) + 1 + length(id) AS int) FROM t""",
        "own_action": f"""SELECT {K}, concat('mail ', upper(concat('user', cast({K} AS string), '@mail.example.com')), ' ssn 9876-54-321') AS sanitized_text FROM customer""",
        "failing_layer": f"""
SELECT {K}, CASE WHEN {K} % 3 = 0 THEN 1 ELSE 2 END AS violations, CASE WHEN {K} % 3 = 0 THEN 'fails-on-thirds did not run: a multiple of three' ELSE '' END AS warnings FROM customer""",
        "propagation": f"""
SELECT {K}, 'PERSON' AS entity_type, 'Zoe Quill' AS original, start, start + 9 AS "end" FROM customer, (VALUES (cast(0 AS int)), (cast(37 AS int))) v(start)""",
        "ner_filters": f"""SELECT {K}, 'PERSON' AS entity_type, 'Zoe Quill' AS original, 0 AS start, 9 AS "end" FROM customer WHERE {K} % 4 = 1""",
        "confusable_fold": f"""
WITH t AS (SELECT {K}, concat('us', chr(1077), 'r', cast({K} as string), '@m', chr(1072), 'il.example.com') AS mail FROM customer)
SELECT {K}, 'EMAIL' AS entity_type, mail AS original, 0 AS start, cast(length(mail) AS int) AS "end" FROM t
UNION ALL SELECT {K}, 'SSN', concat('123-45-678', chr(65305)), cast(length(mail) + 5 AS int), cast(length(mail) + 16 AS int) FROM t""",
        "size_guard": """
SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN concat('ValueError: Input text is too large: ', format('{:,}', strlen(text)), ' bytes (maximum: 5,000 bytes). Split the text into smaller chunks.') END AS scan_error,
  strlen(text) > 5000 OR NOT regexp_matches(text, '""" + EMAIL_RE2 + """') AS kept FROM documents""",
        "pr_eval": f"""
WITH c AS (SELECT count(*) FILTER ({K} % 3 != 0) AS tp, count(*) FILTER ({K} % 3 = 0) AS fn FROM customer), r AS (SELECT cast(tp AS bigint) AS tp, cast(0 AS bigint) AS fp, cast(fn AS bigint) AS fn, tp / (tp + fn) AS recall FROM c)
SELECT e AS entity_type, tp, fp, fn, cast(1 AS double) AS precision, recall, 2 * cast(1 AS double) * recall / (1 + recall) AS f1 FROM r, (VALUES ('TC_ID'), ('MICRO')) v(e)""",
        "llm_stub": f"""
WITH t AS (SELECT {K}, cast(length(cast({K} as string)) + 14 AS int) AS a FROM customer)
SELECT {K}, 'PERSON' AS entity_type, 'Zoe Quill' AS original, a AS start, a + 9 AS "end" FROM t
UNION ALL SELECT {K}, 'CUSTOM_SECRET', 'Pw-secret', a + 16, a + 25 FROM t""",
        "llm_adjudication": f"""
SELECT {K}, 'PERSON' AS entity_type, 'Zoe Quill' AS original, 14 AS start, 23 AS "end" FROM customer
UNION ALL SELECT {K}, 'EMAIL', {email.value}, 27, cast(27 + length({email.value}) AS int) FROM customer""",
        "sensitivity_stub": "SELECT doc_id, contains(text, '@') AS is_sensitive FROM documents",
        "json_leaf_scan": f"SELECT {K}, '$.a@b.example.com.mail' AS path, {email.value} AS original, 0 AS start FROM customer",
        "policy_entities": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}')" for k, (on, a) in sorted(DEFAULT_POLICY_ENTITIES.items()) if on) + ") v(entity_type, action)",
        "guard_requests_block": f"SELECT {K}, cast(CASE WHEN {K} % 2 = 0 THEN 422 ELSE 200 END AS int) AS status, cast(CASE WHEN {K} % 2 = 0 THEN 1 ELSE 0 END AS bigint) AS violations FROM customer",
    }
    return out

