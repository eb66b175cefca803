import pytest

from spanveil.errors import ModelError, PolicyError, UnsupportedLanguageError
from spanveil.functions.fixed import ALL_ENTITIES, ENTITIES
from spanveil.functions.text import chunk_by_paragraph, like_a_person, locate_findings, only_stopwords, parse_findings, parse_sensitivity
from spanveil.plans.policy import Policy, backtracks, entity_group, supported_entities
from spanveil.sources.backends import Backend, check_address
from spanveil.sources.catalog import ModelManager, check_model_name, ner_model, supported_languages


def test_entities():
    p = Policy().with_entity("EMAIL").with_entities({"SSN": "mask", "IBAN": None, "PERSON": {"action": "redact", "layers": ["ner"]}})
    assert p.entity_policy() == {"EMAIL": "hash", "SSN": "mask", "IBAN": "hash", "PERSON": "redact"} | {}
    assert p.with_action("SSN", "warn").action_of("SSN") == "warn"
    gone = p.without_entity("SSN")
    assert "SSN" not in gone.enabled_entities() and gone.action_of("SSN") == "mask" and "SSN" in p.enabled_entities()
    assert Policy().with_entity(ALL_ENTITIES, "redact").enabled_entities() == sorted(set(ENTITIES) - {"SPECIAL_CATEGORY"})
    for bad in (lambda: p.with_action("JWT", "hash"), lambda: p.with_entities("EMAIL"), lambda: p.with_entity("EMAIL", "hash", ["sea"]), lambda: p.with_entity(3)):
        with pytest.raises(PolicyError):
            bad()


def test_model_layer_has_entities_of_its_own():
    p = Policy().with_llm()
    assert len(p.enabled_entities()) == 22 and "ORG" not in p.enabled_entities()
    with pytest.raises(PolicyError):
        Policy().with_llm(backend="cloud")
    with pytest.raises(PolicyError):
        Policy().with_llm(timeout=0)


def test_groups_and_layers():
    assert entity_group("us") == {"EMAIL", "PHONE", "CREDIT_CARD", "IBAN", "SSN", "US_ZIP_CODE", "PASSPORT"}
    assert len(supported_entities("regex")) == 24 and supported_entities("ner") == ["ADDRESS", "ORG", "PERSON"] and len(supported_entities()) == 27
    with pytest.raises(PolicyError):
        supported_entities("sea")
    with pytest.raises(PolicyError):
        entity_group("moon")


def test_files(tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("salt: file\nentities: {EMAIL: {enabled: true, action: mask}}\nallowlist: [x]\ndenylist: [{value: y}]\nllm_detector: {entities: {ORG: {enabled: true}}}\n", encoding="utf-8")
    p = Policy.load(f)
    assert p.salt == "file" and p.entity_policy() == {"EMAIL": "mask"} and p.allowlist == ("x",) and p.llm.entities["ORG"] == (True, "warn") and p.llm.entities["IBAN"] == (True, "hash")
    assert Policy.load(f, salt="given").salt == "given"
    assert "EMAIL" in Policy.load("default").enabled_entities()
    with pytest.raises(FileNotFoundError):
        Policy.load(tmp_path / "none.yaml")


@pytest.mark.parametrize(
    "given",
    [
        {"entities": {"EMAIL": {"action": "shred"}}}, {"entities": {"EMAIL": "warn"}}, {"entities": ["EMAIL"]}, {"allowlist": "x"}, {"allowlist": [1]}, {"denylist": {"value": "x"}}, {"denylist": [{}]},
        {"denylist": [{"pattern": "("}]}, {"denylist": [{"value": 3}]}, {"custom_patterns": {"X": {}}}, {"custom_patterns": {"X": {"pattern": "("}}}, {"custom_patterns": {"X": {"pattern": "(a+)+$"}}},
        {"use_ner": True}, {"llm_detector": {"backend": "cloud"}}, {"llm_detector": {"timeout": -1}},
    ],
)
def test_bad_policies(given):
    with pytest.raises(PolicyError):
        Policy.of(given)


def test_backtracking():
    assert backtracks("(a+)+$") and backtracks(r"(\d+)+$") and backtracks("(b+)+$") and not backtracks(r"EMP-\d+") and not backtracks(r"(?:a\d+)+x")


def test_chunks():
    assert chunk_by_paragraph("short", 100) == [("short", 0)]
    text = "aaaa\n\nbbbb\ncccc\n" + "d" * 30
    assert chunk_by_paragraph(text, 12) == [("aaaa\n\nbbbb", 0), ("cccc", 11), ("d" * 30, 16)]
    assert chunk_by_paragraph("\n" * 20, 5) == [("\n" * 20, 0)]


def test_replies():
    assert parse_findings('Sure:\n```json\n[{"type": "EMAIL", "text": "a]b"}, 3]\n```') == [{"type": "EMAIL", "text": "a]b"}]
    assert parse_findings("none") == [] and parse_findings("[1, 2") == []
    found = locate_findings("Zoe Quill, Zoe Quill 123-45-678", [{"type": "person ", "text": "Zoe Quill"}, {"type": "PERSON", "text": "Zoe"}, {"type": "SSN", "text": "123-45-678"}, {"type": "ORG", "text": "Zoe Quill"}], {"PERSON", "SSN", "ORG"})
    assert found == [("PERSON", "Zoe Quill", 0, 9), ("PERSON", "Zoe Quill", 11, 20)]
    assert [parse_sensitivity(r) for r in ("true", "False.", "Hayır", "well, yes", "maybe", "")] == [True, False, False, True, True, True]


def test_person_filters():
    assert only_stopwords("Senior Backend Engineer") and only_stopwords("...") and not only_stopwords("Zoe Engineer")
    assert like_a_person("Zoe Quill") and not any(map(like_a_person, ("TC", "No:42", "Moda Caddesi", "adresine veya")))


def test_addresses():
    assert check_address("http://localhost:1/", False) == "http://localhost:1" and check_address("https://x.org", False)
    for url, allow in (("http://x.org", False), ("ftp://x", True)):
        with pytest.raises(PolicyError):
            check_address(url, allow)
    assert check_address("http://x.org", True)


def test_catalogue():
    assert supported_languages() == ["de", "en", "es", "fr", "it", "nl", "pt", "tr"]
    assert ner_model("en", "lg").name == "en_core_web_lg" and ner_model("pt", "md").name == "pt_core_news_sm" and ner_model("tr").name == "tr_core_news_md" and ner_model("tr", "trf").name == "tr_core_news_md"
    assert Policy().with_ner_language("en", "de", "en").ner_models == ("en_core_web_sm", "de_core_news_sm")
    with pytest.raises(UnsupportedLanguageError):
        ner_model("xx")
    with pytest.raises(ModelError):
        check_model_name("en; rm -rf /")


class Shelf(Backend):
    def __init__(self):
        self.models = ["a"]

    def list_models(self):
        return self.models

    def pull_model(self, model):
        yield {"status": "half", "percent": 50.0}
        self.models.append(model)


def test_model_manager():
    seen = []
    assert ModelManager(Shelf()).ensure("a") and not ModelManager(Shelf()).ensure("b")
    assert ModelManager(Shelf(), agree=lambda m: True).ensure("b", seen.append) and seen[0]["percent"] == 50.0
    assert ModelManager.known()[0] == "llama3.1:8b" and set(ModelManager.known(2.5)) == {"llama3.2:3b", "phi3:mini", "meta-llama/Llama-3.2-1B-Instruct"}


def test_exports():
    import spanveil

    assert all(getattr(spanveil, name) is not None for name in spanveil.__all__)
    with pytest.raises(AttributeError):
        spanveil.nothing  # noqa: B018
