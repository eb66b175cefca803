"""The scan: a table with a text column becomes the same table with a struct of what was found in each text.

Patterns, checks, overlaps and actions are Catalyst expressions; Python runs in Arrow batches only for the layers that ask for
it (custom and denied patterns in Python's dialect, named-entity models, language models, Python actions).  A scan shuffles nothing.

A null text gives a null result.  A text over the size limit keeps its text and gets a scan_error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import actions as act
from ..functions import spans as sp
from ..functions.fixed import ADJUDICATION_KEEPS, PATTERNS
from ..functions.patterns import GATES, JAVA, JAVA_URI
from ..plans.policy import Policy
from .layers import detector_spans, llm_spans, ner_spans, python_pattern_spans

RESULT = f"struct<original_text:string,sanitized_text:string,is_clean:boolean,scan_error:string,warnings:array<string>,violations:{act.VIOLATIONS}>"


def hide_salt(df: DataFrame, policy: Policy) -> None:
    """Keeps the salt out of printed plans."""
    if policy.salt:
        import re

        spark = df.sparkSession
        old = spark.conf.get("spark.sql.redaction.string.regex", None)
        mine = re.escape(policy.salt)
        if not old or mine not in old:
            spark.conf.set("spark.sql.redaction.string.regex", f"{old}|{mine}" if old else mine)


def free_prefix(columns: list[str]) -> str:
    """A beginning that none of the caller's columns has, for the names of the scan's own."""
    prefix = "_scan_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def _original(p: str, match: str) -> str:
    """What the text holds where a match in the folded text is."""
    return f"if({p}same, {match}.value, {sp.part(f'{p}text', f'{p}pieces', f'{match}.start', f'length({match}.value)')})"


def _plain_spans(places: str, p: str, entity: str, seq: int) -> str:
    made = sp.span(f"'{entity}'", _original(p, "m"), "m.start", "m.start + length(m.value)", sp.confidence_of(entity), seq)
    return f"transform({places}, m -> {made})"


def _iban_spans(places: str, p: str, seq: int) -> str:
    """Valid IBANs, and the parts of valid runs of them."""
    whole = "array(named_struct('start', 0, 'end', length(m.value)))"
    run = f"if(contains(m.value, ' '), cast(array() AS {sp.PLACES}), {sp.iban_run('m.value')})"
    text = sp.part(f"{p}text", f"{p}pieces", "m.start + r.start", "r.end - r.start")
    text = f"if({p}same, substring(m.value, r.start + 1, r.end - r.start), {text})"
    made = sp.span("'IBAN'", text, "m.start + r.start", "m.start + r.end", sp.confidence_of("IBAN"), seq)
    return f"flatten(transform({places}, m -> transform(if({sp.iban('m.value')}, {whole}, {run}), r -> {made})))"


def _but_passwords(places: str, passwords: str) -> str:
    """Places that don't start where a password does."""
    both = f"concat(transform({places}, m -> named_struct('start', m.start, 'mail', 1, 'm', m)), transform({passwords}, s -> named_struct('start', s.start, 'mail', 0, 'm', NULL)))"
    kept = lambda b: f"filter({b}, (x, i) -> x.mail = 1 AND NOT (i > 0 AND {b}[i - 1].mail = 0 AND {b}[i - 1].start = x.start))"
    return f"transform({sp.bound(f'sort_array({both})', kept)}, x -> x.m)"


def _builtin(df: DataFrame, policy: Policy, p: str) -> tuple[DataFrame, list[str]]:
    """Adds a column of spans for each pattern layer in play; returns their names in the order that breaks ties."""
    wanted = [e for e in PATTERNS if policy.entities.get(e, (False, ""))[0]]
    if not wanted:
        return df, []
    text, folded, names = f"{p}text", f"{p}folded", {"folded": f"{p}folded", "digit": f"{p}digit"}
    df = df.withColumn(folded, sp.fold(F.col(text)) if policy.fold else F.col(text))
    df = df.selectExpr(
        "*", rf"{folded} RLIKE r'\p{{Nd}}' AS {p}digit", f"{text} = {folded} AS {p}same", f"if({text} = {folded}, NULL, {sp.pieces_of(text)}) AS {p}pieces",
    )
    uri = bool({"EMAIL", "CUSTOM_SECRET"} & set(wanted))
    matches = []
    for e in wanted:
        all_of = f"regexp_extract_all({folded}, {sp.literal(JAVA[e])}, 0)"
        matches.append((f"if({GATES[e].format(**names)}, {all_of}, cast(array() AS array<string>))" if e in GATES else all_of) + f" AS {p}m_{e}")
    if uri:
        for name, group in (("m", 0), ("w", 1)):
            matches.append(f"if(contains({folded}, '://'), regexp_extract_all({folded}, {sp.literal(JAVA_URI)}, {group}), cast(array() AS array<string>)) AS {p}{name}_uri")
    df = df.selectExpr("*", *matches)

    # the second pass over a text only where the first found something
    def places(name: str, pattern: str) -> str:
        return sp.located(f"{p}m_{name}", f"split({folded}, {sp.literal(pattern)}, -1)")

    order = []
    if uri:
        word = {"start": "u.m.start + length(u.m.value) - 1 - length(u.w)", "end": "u.m.start + length(u.m.value) - 1"}
        secret = f"if({p}same, u.w, {sp.part(text, f'{p}pieces', word['start'], 'length(u.w)')})"
        made = sp.span("'CUSTOM_SECRET'", secret, word["start"], word["end"], sp.confidence_of("CUSTOM_SECRET"), 0)
        zipped = f"zip_with({places('uri', JAVA_URI)}, {p}w_uri, (m, w) -> named_struct('m', m, 'w', w))"
        df = df.selectExpr("*", f"if(size({p}m_uri) > 0, transform({zipped}, u -> {made}), {sp.no_spans()}) AS {p}s_uri")
        if "CUSTOM_SECRET" in wanted:
            order.append(f"{p}s_uri")
    out = []
    for k, e in enumerate(wanted, 1):
        at = places(e, JAVA[e])
        if e == "CREDIT_CARD":
            at = f"filter({at}, m -> {sp.luhn('m.value')})"
        elif e == "TC_ID":
            at = f"filter({at}, m -> {sp.tc_id('m.value')})"
        elif e == "EMAIL":
            at = f"if(size({p}m_uri) = 0, {at}, {_but_passwords(at, f'{p}s_uri')})"
        made = _iban_spans(at, p, k) if e == "IBAN" else _plain_spans(at, p, e, k)
        out.append(f"if(size({p}m_{e}) > 0, {made}, {sp.no_spans()}) AS {p}s_{e}")
        order.append(f"{p}s_{e}")
    return df.selectExpr("*", *out), order


def raw_spans(df: DataFrame, policy: Policy, p: str) -> DataFrame:
    """Adds the columns spans (all layers, unresolved) and warnings to a table with text (null where nothing is to be scanned); p begins their names."""
    df, columns = _builtin(df, policy, p)
    warnings = []
    text, seq = F.col(f"{p}text"), len(PATTERNS) + 1
    if policy.custom_patterns:
        from_python = python_pattern_spans([(n, c["pattern"], sp.confidence_of(n)) for n, c in policy.custom_patterns.items()], seq)
        df = df.withColumn(f"{p}custom", from_python(text))
        columns.append(f"{p}custom.spans")
        warnings.append(f"{p}custom.warning")
    seq += len(policy.custom_patterns)
    for k, model in enumerate(policy.ner_models):
        wanted = {e for e, (on, _) in policy.entities.items() if on}
        df = df.withColumn(f"{p}ner{k}", ner_spans(model, wanted, seq + k)(text))
        columns.append(f"{p}ner{k}.spans")
        warnings.append(f"{p}ner{k}.warning")
    seq += len(policy.ner_models)
    for k, name in enumerate(policy.detectors):
        df = df.withColumn(f"{p}own{k}", detector_spans(name, seq + k)(text))
        columns.append(f"{p}own{k}.spans")
        warnings.append(f"{p}own{k}.warning")
    seq += len(policy.detectors)
    if policy.llm.enabled:
        candidates = f"concat({', '.join(columns)})" if columns else sp.no_spans()
        df = df.selectExpr("*", f"if({p}text IS NOT NULL, {candidates}, NULL) AS {p}candidates").withColumn(f"{p}llm", llm_spans(policy.llm, seq)(text, F.col(f"{p}candidates")))
        columns = [f"filter({p}candidates, s -> s.confidence >= {ADJUDICATION_KEEPS})" if policy.llm.adjudicate else f"{p}candidates", f"{p}llm.spans"]
        warnings.append(f"{p}llm.warning")
    seq += 1
    denied = [e for e in policy.denylist if "pattern" in e]
    if denied:
        df = df.withColumn(f"{p}denied", python_pattern_spans([(e.get("entity_type", "CUSTOM"), e["pattern"], 1.0) for e in denied], seq)(text))
        columns.append(f"{p}denied.spans")
        warnings.append(f"{p}denied.warning")
    for k, e in enumerate(policy.denylist):
        if "pattern" not in e and e["value"]:
            columns.append(sp.value_spans(f"{p}text", e["value"], e.get("entity_type", "CUSTOM"), seq + 1 + k))
    every = f"concat({', '.join(columns)})" if columns else sp.no_spans()
    told = f"filter(array({', '.join(warnings)}), w -> w IS NOT NULL)" if warnings else "cast(array() AS array<string>)"
    # the place in the list breaks ties
    numbered = f"transform({every}, (s, i) -> {sp.span('s.entity_type', 's.text', 's.start', 's.end', 's.confidence', 'i')})"
    return df.selectExpr("*", f"{numbered} AS {p}spans", f"{told} AS {p}warnings")


def _result(p: str, original: str, error: str, warnings: str) -> str:
    """The struct of a scan, from the column violations."""
    return (
        f"cast(named_struct('original_text', {original}, 'sanitized_text', {act.sanitised(original, f'{p}violations', f'{p}parts')}, 'is_clean', size({p}violations) = 0, "
        f"'scan_error', {error}, 'warnings', {warnings}, 'violations', {p}violations) AS {RESULT})"
    )


def scan(df: DataFrame, policy: Policy, text_col: str = "text", out_col: str = "scan") -> DataFrame:
    """Adds a struct of RESULT's kind to every row; a column that has this name already is replaced. All others are returned as they were."""
    hide_salt(df, policy)
    columns, p = [c for c in df.columns if c.lower() != out_col.lower()], free_prefix(df.columns)
    work = df.withColumn(f"{p}original", F.col(text_col).cast("string"))
    work = work.selectExpr("*", f"octet_length({p}original) > {policy.max_text_bytes} AS {p}too_large", f"if(octet_length({p}original) > {policy.max_text_bytes}, NULL, {p}original) AS {p}text")
    work = raw_spans(work, policy, p)
    kept = sp.allowed_removed(sp.resolve(f"{p}spans"), list(policy.allowlist))
    if policy.propagate:
        work = work.selectExpr("*", f"{kept} AS {p}first")
        kept = sp.propagate(f"{p}first", f"{p}text", policy.propagate_min_length)
    work = work.selectExpr("*", f"coalesce({kept}, {sp.no_spans()}) AS {p}kept")
    chosen = policy.actions()
    python = act.python_replacements(chosen, act.ActionContext(policy.salt))
    if python is not None:
        work = work.withColumn(f"{p}python", python(F.expr(f"{p}kept.entity_type"), F.expr(f"{p}kept.text")))
    work = work.withColumn(f"{p}violations", act.with_actions(F.col(f"{p}kept"), chosen, policy.salt, F.col(f"{p}python") if python is not None else None))
    work = work.selectExpr("*", f"{act.parts_of(f'{p}original', f'{p}violations')} AS {p}parts")
    size = f"format_number(octet_length({p}original), 0)"
    error = f"if({p}too_large, concat('ValueError: Input text is too large: ', {size}, ' bytes (maximum: {policy.max_text_bytes:,} bytes). Split the text into smaller chunks.'), NULL)"
    result = _result(p, f"{p}original", error, f"coalesce({p}warnings, cast(array() AS array<string>))")
    # a generator, or a filter on the result would be pushed below it and evaluate the whole scan once more
    made = F.explode(F.array(F.expr(f"if({p}original IS NOT NULL, {result}, NULL)"))).alias(out_col)
    return work.select(*[F.col(quoted_name(c)) for c in columns], made)


def quoted_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def violations(scanned: DataFrame, *keep: str, scan_col: str = "scan") -> DataFrame:
    """A row for each violation, with the columns to keep."""
    # the outer form, or Catalyst would infer a filter on the array and evaluate the whole scan in it once more
    rows = scanned.select(*keep, F.explode_outer(f"{scan_col}.violations").alias("v")).filter("v IS NOT NULL")
    return rows.select(*keep, "v.entity_type", "v.original", "v.start", "v.end", "v.action", "v.replacement", "v.confidence")


def redacted(scanned: DataFrame, scan_col: str = "scan") -> DataFrame:
    """Replaces the result by what is safe to store: no original text and no original values."""
    s = F.col(scan_col)
    safe = F.transform(s["violations"], lambda v: F.struct(v["entity_type"].alias("entity_type"), v["start"].alias("start"), v["end"].alias("end"), v["action"].alias("action"), v["replacement"].alias("replacement"), v["confidence"].alias("confidence")))
    return scanned.withColumn(scan_col, F.when(s.isNotNull(), F.struct(s["sanitized_text"].alias("sanitized_text"), s["is_clean"].alias("is_clean"), s["scan_error"].alias("scan_error"), s["warnings"].alias("warnings"), safe.alias("violations"))))


def reapply(scanned: DataFrame, action: str, entities: list[str] | None = None, salt: str = "", scan_col: str = "scan") -> DataFrame:
    """Another action on what was found, without looking again. With entities, only those types are kept; the text of the others
    stays as it was in the original."""
    act.check_action(action, "reapply")
    hide_salt(scanned, Policy(salt=salt))
    p, s = free_prefix(scanned.columns), quoted_name(scan_col)
    chosen = f"{s}.violations"
    if entities is not None:
        chosen = f"filter({chosen}, v -> array_contains(cast(array({', '.join(sp.literal(e) for e in entities)}) AS array<string>), v.entity_type))"
    as_spans = f"transform({chosen}, v -> {sp.span('v.entity_type', 'v.original', 'v.start', 'v.end', 'v.confidence', 0)})"
    work = scanned.selectExpr("*", f"{as_spans} AS {p}kept")
    python = act.every_python_replacement(action, act.ActionContext(salt))
    if python is not None:
        work = work.withColumn(f"{p}python", python(F.expr(f"{p}kept.entity_type"), F.expr(f"{p}kept.text")))
    work = work.withColumn(f"{p}violations", act.every_action(F.col(f"{p}kept"), action, salt, F.col(f"{p}python") if python is not None else None))
    work = work.selectExpr("*", f"{act.parts_of(f'{s}.original_text', f'{p}violations')} AS {p}parts")
    result = _result(p, f"{s}.original_text", f"{s}.scan_error", f"{s}.warnings")
    columns = [F.expr(f"if({s} IS NOT NULL, {result}, NULL)").alias(c) if c.lower() == scan_col.lower() else F.col(quoted_name(c)) for c in scanned.columns]
    return work.select(*columns)


def filter_has_entity(df: DataFrame, entity: str, policy: Policy, text_col: str = "text", scan_col: str = "scan") -> DataFrame:
    """Scans, and keeps rows with a violation of that type; the pattern's literal is pushed down to the table's scan."""
    # nothing is folded to @, but look-alikes may be to the letters of others
    literal = {"EMAIL": "@"}.get(entity) or (None if policy.fold else {"JWT": "eyJ"}.get(entity))
    only_patterns = not (policy.ner_models or policy.detectors or policy.llm.enabled or policy.custom_patterns or policy.denylist)
    if literal and only_patterns:
        df = df.filter(F.contains(F.col(text_col), F.lit(literal)))
    return scan(df, policy, text_col, scan_col).filter(F.exists(f"{scan_col}.violations", lambda v: v["entity_type"] == entity))
