"""What language models are asked."""

from __future__ import annotations

MEANINGS = {
    "CREDIT_CARD": "number of a payment card", "EMAIL": "e-mail address", "PHONE": "telephone number", "PERSON": "name of a person, at least first and last name",
    "ORG": "name of an organisation", "ADDRESS": "postal address or part of one", "IBAN": "international bank account number", "TC_ID": "Turkish identity number of 11 digits",
    "IP_ADDRESS": "IPv4 address", "IPv6": "IPv6 address", "UUID": "universally unique identifier", "SSN": "US social security number", "MAC_ADDRESS": "hardware address",
    "JWT": "signed web token", "POSTAL_CODE": "Turkish postal code", "NIN": "British national insurance number", "CUSTOM_SECRET": "password, key or other credential",
    "PASSPORT": "passport number", "EU_NATIONAL_ID": "national identity number of an EU state", "UK_POSTAL_CODE": "British postcode", "US_ZIP_CODE": "US ZIP code",
    "CODICE_FISCALE": "Italian tax code", "VAT_NUMBER": "value-added tax number", "DATE_OF_BIRTH": "date of birth", "FINANCIAL_AMOUNT": "sum of money",
    "SPECIAL_CATEGORY": "health, religion, ethnic origin, political opinion, union membership, sexual orientation, genetic or biometric data of a person",
}


def findings_prompt(text: str, wanted: set[str], candidates: list[tuple[str, str]] | None = None) -> list[dict[str, str]]:
    kinds = "\n".join(f"- {k}: {MEANINGS.get(k, 'as its name says')}" for k in sorted(wanted))
    task = f'List the sensitive values in the text as a JSON array of {{"type": ..., "text": ...}}, each text copied exactly. Types:\n{kinds}\nAnswer with the array alone; [] if there are none.'
    if candidates:
        task += "\nOther tools suggest these; repeat those that are right, correct wrong types, leave out wrong ones:\n" + "\n".join(f"- {k}: {v}" for k, v in dict.fromkeys(candidates))
    return [{"role": "system", "content": task}, {"role": "user", "content": text}]


# The same question in the languages that a gate may be set to.
QUESTIONS = {
    "en": "Does this text hold personal, confidential or otherwise sensitive information, in whatever language? Answer only true or false.",
    "de": "Enthält dieser Text personenbezogene, vertrauliche oder sonst schutzwürdige Angaben? Antworte nur mit true oder false.",
    "fr": "Ce texte contient-il des informations personnelles, confidentielles ou sensibles ? Réponds seulement par true ou false.",
    "tr": "Bu metin kişisel, gizli veya hassas bilgi içeriyor mu? Yalnızca true ya da false yaz.",
}


def sensitivity_prompt(text: str, language: str | None = None) -> list[dict[str, str]]:
    return [{"role": "system", "content": QUESTIONS.get((language or "en").lower()[:2], QUESTIONS["en"])}, {"role": "user", "content": text}]
