"""From Python's regular expressions to Java's, with the same matches.

Java's Unicode classes differ from Python's: word characters are letters and numbers here, a word
edge is written out as such, four separators more are white space, and classes under
ignored case also hold the two letters whose lower case is plain i and k.
"""

from __future__ import annotations

import re

from .fixed import PATTERNS, URI_CREDENTIAL

WORD = r"\p{L}\p{N}_"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
SPACE = r"\s\x1c-\x1f"


def _class(body: str, ignore_case: bool) -> str:
    """A character class without its brackets."""
    both = r"\s" in body and r"\S" in body
    out = body if both else body.replace(r"\w", WORD).replace(r"\s", SPACE)
    if not both and r"\S" in body:
        raise ValueError(f"not translated: [{body}]")
    out = out.replace("[", r"\[").replace("&&", r"&\&")
    if ignore_case and not body.startswith("^"):
        plain = re.compile(f"[{body}]")
        out += "".join(extra for letters, extra in (("iI", "İ"), ("kK", "K")) if any(plain.match(c) for c in letters))
    return out


def to_java(pattern: str, ignore_case: bool = False) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append({r"\b": EDGE, r"\w": f"[{WORD}]", r"\W": f"[^{WORD}]", r"\s": f"[{SPACE}]", r"\S": f"[^{SPACE}]"}.get(two, two))
            i += 2
        elif c == "[":
            end = i + 1 + (pattern[i + 1] == "^")
            end += pattern[end] == "]"
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out.append(f"[{_class(pattern[i + 1 : end], ignore_case)}]")
            i = end + 1
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        else:
            out.append(c)
            i += 1
    return ("(?Ui)" if ignore_case else "(?U)") + "".join(out)


JAVA = {entity: to_java(p, ignore) for entity, (p, ignore) in PATTERNS.items()}
JAVA_URI = to_java(*URI_CREDENTIAL)


def _holds(*words: str) -> str:
    """A condition on the folded text, in SQL."""
    return " OR ".join(f"contains({{folded}}, '{w}')" for w in words)


#: What a text must hold to match at all; cheap searches that spare most texts the pattern. {folded}: the folded text; {digit}: whether any
#: decimal digit is there.
GATES: dict[str, str] = {
    "EMAIL": _holds("@"),
    # a word of each alternative; the alternative of English streets also needs a digit
    "ADDRESS": _holds(
        "Mahallesi", "Mah.", "Caddesi", "Cad.", "Soka", "Sok.", "Bulvarı", "Blv.", "Apartmanı", "Apt.", "Sitesi", "Rue", "Allée", "Allee", "Impasse", "Promenade", "Place", "Calle",
        "Avenida", "Plaza", "Paseo", "Carrera", "Viale", "Piazza", "Corso", "Vicolo", "Largo", "straat", "weg", "laan", "plein", "gracht", "kade", "dijk", "strasse", "straße", "gasse",
        "platz", "ring", "allee", "damm", "ufer", "chaussee",
    )
    + " OR {digit}",
    "UUID": _holds("-"),
    "MAC_ADDRESS": _holds(":", "-"),
    "IPv6": _holds("::", ":"),
    "JWT": _holds("eyJ"),
    "CUSTOM_SECRET": _holds(
        "PRIVATE KEY-----", "hooks.slack.com", "sk-", "k_live_", "k_test_", "ghp_", "ghs_", "gho_", "glpat-", "AKIA", "AIza", "ya29.", "xoxb-", "xoxp-", "SG.", "SK", "AC", "npm_"
    ),
} | dict.fromkeys(
    ["CREDIT_CARD", "PHONE", "IBAN", "IP_ADDRESS", "TC_ID", "POSTAL_CODE", "UK_POSTAL_CODE", "US_ZIP_CODE", "EU_NATIONAL_ID", "PASSPORT", "CODICE_FISCALE", "DATE_OF_BIRTH",
     "FINANCIAL_AMOUNT", "VAT_NUMBER", "SSN", "NIN", "VEHICLE_PLATE"], "{digit}",
)
