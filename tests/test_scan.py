"""The scan end to end."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spanveil.errors import ModelError, PolicyError
from spanveil.functions import actions
from spanveil.functions.fixed import PATTERNS
from spanveil.operators.layers import register_detector, register_ner_model
from spanveil.operators.scan import filter_has_entity, reapply, redacted, scan, violations
from spanveil.operators.sensitivity import is_sensitive
from spanveil.plans.policy import Policy
from spanveil.sources.backends import use_backend
from spanveil.sources.dry_run import DryRunBackend


def one(spark, text, policy):
    return scan(spark.createDataFrame([(text,)], "text string"), policy).first().scan


def types(result):
    return [v.entity_type for v in result.violations]


def everything(action="redact"):
    return Policy(salt="s").with_entities(list(PATTERNS), action, ["regex"])


def test_nothing_is_found_without_a_policy(spark):
    r = one(spark, "a@b.com 4111111111111111", Policy())
    assert r.is_clean and r.sanitized_text == r.original_text and r.violations == [] and r.warnings == [] and r.scan_error is None


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    got = [r.scan for r in scan(df, everything()).collect()]
    assert got[0] is None and got[1].is_clean and got[1].sanitized_text == ""


def test_customer_text(spark):
    text = "Ali (a@b.com, +44 20 7946 0958) paid with 4111 1111 1111 1111 from 10.0.0.1; IBAN TR330006100519786457841326"
    r = one(spark, text, everything())
    assert types(r) == ["EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS", "IBAN"]
    assert r.sanitized_text == "Ali ([EMAIL], [PHONE]) paid with [CREDIT_CARD] from [IP_ADDRESS]; IBAN [IBAN]"
    assert all(text[v.start : v.end] == v.original for v in r.violations)


def test_a_password_in_an_address_is_no_mail(spark):
    text = "postgresql://admin:Sup3r@db.prod.internal:5432/x"
    assert [(v.entity_type, v.original) for v in one(spark, text, everything()).violations] == [("CUSTOM_SECRET", "Sup3r")]
    # the mail is suppressed even where secrets aren't asked for
    assert one(spark, text, Policy().with_entity("EMAIL", "warn", ["regex"])).is_clean


def test_folding_can_be_turned_off(spark):
    text = "ali@tеst.com"
    assert one(spark, text, everything()).violations[0].original == text
    assert one(spark, text, replace(everything(), fold=False)).is_clean


def test_actions(spark):
    text = "mail a@b.com"
    values = {a: one(spark, text, Policy(salt="x").with_entity("EMAIL", a, ["regex"])).sanitized_text for a in ("warn", "hash", "redact", "mask")}
    import hashlib

    digest = hashlib.sha256(b"xa@b.com").hexdigest()[:16]
    assert values == {"warn": text, "hash": f"mail [EMAIL:{digest}]", "redact": "mail [EMAIL]", "mask": "mail a*@b.com"}


def test_own_actions(spark):
    actions.register_action("shout", lambda s, c: F.upper(s["text"]))
    actions.register_python_action("backwards", lambda kind, text, c: text[::-1])
    assert one(spark, "a@b.com", Policy().with_entity("EMAIL", "shout", ["regex"])).sanitized_text == "A@B.COM"
    assert one(spark, "x a@b.com", Policy().with_entity("EMAIL", "backwards", ["regex"])).sanitized_text == "x moc.b@a"
    with pytest.raises(PolicyError):
        Policy().with_entity("EMAIL", "unknown")


def test_reapply_and_redacted(spark):
    df = spark.createDataFrame([("a@b.com 123-45-6789",)], "text string")
    s = scan(df, everything("hash"))
    assert reapply(s, "mask").first().scan.sanitized_text == "a*@b.com ***-**-6789"
    assert reapply(s, "redact", ["SSN"]).first().scan.sanitized_text == "a@b.com [SSN]"
    assert "original" not in redacted(s).select("scan.violations").schema.simpleString()
    assert "original_text" not in redacted(s).select("scan.*").columns


def test_size_guard_counts_bytes(spark):
    r = one(spark, "é" * 6 + " a@b.com", replace(everything(), max_text_bytes=15))
    assert r.scan_error == "ValueError: Input text is too large: 20 bytes (maximum: 15 bytes). Split the text into smaller chunks." and r.is_clean


def test_allowed_after_overlap(spark):
    policy = everything().with_denied("b.com").with_allowed("b.com")
    assert one(spark, "a@b.com", policy).is_clean  # the allowed winner has already beaten the mail


def test_custom_and_denied_patterns(spark):
    policy = Policy().with_custom_pattern("EMPLOYEE", r"EMP-\d+", "redact").with_denied(pattern=r"(?i)tiger", entity="CODE")
    r = one(spark, "EMP-17 saw Tiger", policy)
    assert r.sanitized_text == "[EMPLOYEE] saw Tiger" and types(r) == ["EMPLOYEE", "CODE"] and r.violations[1].confidence == 1.0


def test_a_failing_model_is_a_warning(spark):
    def load():
        raise ModelError("no such model")

    register_ner_model("missing", load)
    r = one(spark, "Zoe", Policy().with_entity("PERSON", "hash", ["ner"]).with_ner("missing"))
    assert r.warnings == ["NERDetector did not run: no such model"] and r.is_clean


def test_the_gate_fails_closed(spark):
    df = spark.createDataFrame([("hello",)], "text string")
    use_backend("ollama", lambda: DryRunBackend(failing="down"))
    with pytest.raises(Exception, match="down"):
        is_sensitive(df, Policy().with_llm()).collect()
    assert one(spark, "hello", Policy().with_llm()).warnings == ["LLMDetector did not run: down"]
    use_backend("ollama", lambda: DryRunBackend())
    got = is_sensitive(spark.createDataFrame([("a@b",), ("plain",), ("  ",), (None,)], "text string"), Policy().with_llm()).collect()
    assert [r.is_sensitive for r in got] == [True, False, False, False]
    use_backend("ollama", None)
    with pytest.raises(PolicyError):
        is_sensitive(df, Policy())


def test_other_columns_are_kept_and_may_clash(spark):
    df = spark.createDataFrame([("a@b.com", 1, "x", "y")], "text string, `a.b` int, start string, violations string")
    r = scan(df, everything()).first()
    assert r["a.b"] == 1 and r["start"] == "x" and r["violations"] == "y"


def test_salt_is_not_shown(spark):
    s = scan(spark.createDataFrame([("a@b.com",)], "text string"), Policy(salt="vErYsEcReT").with_entity("EMAIL", "hash", ["regex"]))
    assert "vErYsEcReT" not in s._jdf.queryExecution().toString()
    assert "vErYsEcReT" not in repr(Policy(salt="vErYsEcReT"))


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = scan(spark.range(3).select(F.col("id").cast("string").alias("text")), everything())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_filter_by_type(spark):
    df = spark.createDataFrame([("a@b.com",), ("none",)], "text string")
    assert filter_has_entity(df, "EMAIL", everything()).count() == 1
    assert violations(scan(df, everything()), "text").count() == 1


#: Texts of 500 KB: near misses, and dense lists of what is found.
ADVERSARIAL = {
    "dots": "a." * 250_000, "digits": "1" * 500_000, "plates": "TR33 " * 100_000, "no domain": "a" * 499_999 + "@", "uri": "x://" + "y" * 499_996, "mails": "a@b.com " * 62_500,
    "ibans": "TR330006100519786457841326 " * 18_500, "passwords": "x://a:b@c.de " * 38_000, "plates back to back": "34 ABC 123 " * 45_000, "folded": "а@b.com " * 62_500,
}


@pytest.mark.parametrize("name", ADVERSARIAL)
def test_adversarial_texts_take_linear_time(spark, name):
    import time

    one(spark, "warm-up a@b.com", everything())
    began = time.time()
    r = one(spark, ADVERSARIAL[name], everything())
    assert time.time() - began < 40, f"{name}: {len(r.violations)} violations"


def test_a_pattern_of_ones_own_has_a_limit_of_time(spark):
    policy = Policy().with_custom_pattern("SLOW", r"(x|x)*$", "redact").with_entity("EMAIL", "redact", ["regex"])
    r = one(spark, "a@b.com " + "x" * 200 + "!", policy)
    assert types(r) == ["EMAIL"] and r.warnings == ["patterns that took over 2 s were skipped: SLOW"]


def test_reapply_with_an_action_in_python(spark):
    actions.register_python_action("backwards", lambda kind, text, c: text[::-1])
    s = scan(spark.createDataFrame([("x a@b.com 123-45-6789",), (None,)], "text string"), everything("hash"))
    got = reapply(s, "backwards").collect()
    assert got[0].scan.sanitized_text == "x moc.b@a 9876-54-321" and got[1].scan is None


def test_names_of_the_scan_never_clash(spark, tmp_path):
    from spanveil.operators.scan import free_prefix
    from spanveil.sources.tables import write_safe

    old = ["_text", "_original", "_folded", "_spans", "_violations", "_kept", "_digit", "_warnings", "_too_large", "_python", "_custom", "_denied", "_candidates", "_llm"]
    own = ["original", "too_large", "text", "folded", "digit", "same", "pieces", "spans", "warnings", "kept", "violations", "parts", "first", "python", "custom", "denied", "s_uri", "m_EMAIL"]
    columns = old + [f"{x}{c}" for x in ("_scan_", "__scan_", "_SCAN_") for c in own if x != "_SCAN_" or c == "kept"]
    columns = list({c.lower(): c for c in columns}.values())
    assert free_prefix(columns) == "___scan_"
    df = spark.createDataFrame([("a@b.com", *[f"v{k}" for k in range(len(columns))])], "text string, " + ", ".join(f"`{c}` string" for c in columns))
    policy = everything().with_custom_pattern("C", "zzz+", "redact").with_denied(pattern="yyy+")
    s = scan(df, policy)
    row = s.first()
    assert s.columns == [*df.columns, "scan"] and [row[c] for c in columns] == [f"v{k}" for k in range(len(columns))]
    again = reapply(s, "mask").first()
    assert [again[c] for c in columns] == [f"v{k}" for k in range(len(columns))] and again.scan.sanitized_text == "a*@b.com"
    write_safe(s, str(tmp_path / "safe"), "json")
    written = "".join(p.read_text() for p in (tmp_path / "safe").glob("*.json"))
    assert "a@b.com" not in written and "v0" in written
