"""The policy: which entity types are looked for, by which layers, and what is done to what is found.

A policy never changes; each method returns a new one.  Nothing is read but the file that is named.
"""

from __future__ import annotations

import logging
import re
import subprocess
import sys
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..errors import PolicyError
from ..functions import fixed
from ..functions.actions import check_action

log = logging.getLogger(__name__)

#: Keys that a policy file may have.
KEYS = (
    "salt", "spacy_model", "spacy_models", "spacy_auto_download", "use_ner", "scan_batch_workers", "max_text_bytes", "custom_patterns", "llm_detector", "entities", "allowlist",
    "denylist", "propagate_matches", "propagate_min_length", "normalize_confusables",
)
Setting = tuple[bool, str]


@dataclass(frozen=True)
class ModelLayer:
    """The language-model layer. entities: what it is asked for, each with an action."""

    enabled: bool = False
    backend: str = "ollama"
    model: str = "llama3.2"
    base_url: str = "http://localhost:11434"
    api_key: str = field(default="", repr=False)
    timeout: float = 60
    cache_ttl: float = 0
    adjudicate: bool = False
    allow_http: bool = False
    language: str | None = None
    chunk_chars: int = fixed.LLM_CHUNK_CHARS
    entities: Mapping[str, Setting] = field(default_factory=lambda: dict(fixed.LLM_DEFAULT_ENTITIES))


@dataclass(frozen=True)
class Policy:
    """By default nothing is looked for.  The salt is never shown."""

    entities: Mapping[str, Setting] = field(default_factory=dict)
    salt: str = field(default="", repr=False)
    max_text_bytes: int = fixed.MAX_TEXT_BYTES
    batch_workers: int = fixed.BATCH_WORKERS
    custom_patterns: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    allowlist: tuple[str, ...] = ()
    denylist: tuple[Mapping[str, str], ...] = ()
    propagate: bool = False
    propagate_min_length: int = fixed.PROPAGATE_MIN_LENGTH
    fold: bool = True
    ner_models: tuple[str, ...] = ()
    detectors: tuple[str, ...] = ()
    llm: ModelLayer = field(default_factory=ModelLayer)

    # entities

    def _names(self, entity: str) -> list[str]:
        if not isinstance(entity, str):
            raise PolicyError(f"an entity type must be a text, not {type(entity).__name__}")
        return sorted(fixed.ENTITIES) if entity == fixed.ALL_ENTITIES else [entity]

    def _set(self, entity: str, enabled: bool, action: str, layers: Iterable[str] | None) -> Policy:
        check_action(action, f"entity {entity}")
        if entity not in fixed.ENTITIES and entity not in self.custom_patterns:
            log.warning("unknown entity type %r; known: %s", entity, sorted(fixed.ENTITIES))
        if layers is None:
            chosen = [k for k, known in fixed.LAYERS.items() if entity in known] or ["regex"]
        else:
            chosen = [layers] if isinstance(layers, str) else list(layers)
            if wrong := set(chosen) - set(fixed.LAYERS):
                raise PolicyError(f"unknown layers {sorted(wrong)}; known: {sorted(fixed.LAYERS)}")
        out = replace(self, entities={**self.entities, entity: (enabled and bool({"regex", "ner"} & set(chosen)), action)})
        if "llm" in chosen:
            out = replace(out, llm=replace(out.llm, entities={**out.llm.entities, entity: (enabled, action)}))
        return out

    def with_entity(self, entity: str, action: str | None = None, layers: Iterable[str] | None = None) -> Policy:
        """Looks for an entity type (ALL_ENTITIES: for every known one). Without an action its values are hashed."""
        if action is None:
            log.warning("no action given for %s: its values are hashed", entity)
        out = self
        for name in self._names(entity):
            out = out._set(name, True, action or "hash", layers)
        return out

    def with_entities(self, entities: Iterable[str] | Mapping[str, Any], action: str | None = None, layers: Iterable[str] | None = None) -> Policy:
        """From names, or from a mapping of names to an action, to {"action": ..., "layers": ...} or to None."""
        if isinstance(entities, str):
            raise PolicyError("with_entities takes several names; with_entity takes one")
        out = self
        for name in entities:
            own, where = action, layers
            if isinstance(entities, Mapping):
                spec = entities[name]
                if isinstance(spec, Mapping):
                    own, where = spec.get("action", action), spec.get("layers", layers)
                elif spec is not None:
                    own = spec
            out = out.with_entity(name, own, where)
        return out

    def without_entity(self, entity: str) -> Policy:
        """No longer looks for it; its action is remembered."""
        out = self
        for name in self._names(entity):
            if name in out.entities:
                out = replace(out, entities={**out.entities, name: (False, out.entities[name][1])})
            if name in out.llm.entities:
                out = replace(out, llm=replace(out.llm, entities={**out.llm.entities, name: (False, out.llm.entities[name][1])}))
        return out

    def without_entities(self, entities: Iterable[str]) -> Policy:
        if isinstance(entities, str):
            raise PolicyError("without_entities takes several names; without_entity takes one")
        out = self
        for name in entities:
            out = out.without_entity(name)
        return out

    def with_action(self, entity: str, action: str) -> Policy:
        """Changes the action of an entity type that is looked for."""
        check_action(action, f"entity {entity}")
        if entity not in self.enabled_entities():
            raise PolicyError(f"{entity} isn't looked for")
        out = self
        if entity in self.entities:
            out = replace(out, entities={**out.entities, entity: (out.entities[entity][0], action)})
        if entity in self.llm.entities:
            out = replace(out, llm=replace(out.llm, entities={**out.llm.entities, entity: (out.llm.entities[entity][0], action)}))
        return out

    def enabled_entities(self) -> list[str]:
        own = {k for k, (on, _) in self.entities.items() if on}
        return sorted(own | ({k for k, (on, _) in self.llm.entities.items() if on} if self.llm.enabled else set()))

    def action_of(self, entity: str) -> str | None:
        if entity in self.entities:
            return self.entities[entity][1]
        return self.llm.entities[entity][1] if self.llm.enabled and entity in self.llm.entities else None

    def entity_policy(self) -> dict[str, str | None]:
        return {k: self.action_of(k) for k in self.enabled_entities()}

    def actions(self) -> dict[str, str]:
        """The action of every type that may turn up."""
        out = {k: a for k, (_, a) in self.entities.items()}
        if self.llm.enabled:
            out = {k: a for k, (_, a) in self.llm.entities.items() if k not in out} | out
        return {k: c.get("action", "warn") for k, c in self.custom_patterns.items() if k not in out} | out

    # layers and lists

    def with_ner(self, *models: str) -> Policy:
        """Names of registered named-entity models, each once, in order."""
        if not models:
            raise PolicyError("name at least one model")
        return replace(self, ner_models=tuple(dict.fromkeys((*self.ner_models, *models))))

    def with_ner_language(self, *codes: str, size: str = "sm") -> Policy:
        """The catalogue's models of these languages (ISO 639-1)."""
        from ..sources.catalog import ner_model

        return self.with_ner(*[ner_model(c, size).name for c in codes])

    def with_detector(self, *names: str) -> Policy:
        """Detectors of one's own, registered with layers.register_detector."""
        return replace(self, detectors=tuple(dict.fromkeys((*self.detectors, *names))))

    def with_llm(self, **settings: Any) -> Policy:
        out = replace(self, llm=replace(self.llm, enabled=True, **settings))
        _check_llm(out.llm)
        return out

    def with_salt(self, salt: str) -> Policy:
        return replace(self, salt=salt)

    def with_allowed(self, *values: str) -> Policy:
        return replace(self, allowlist=tuple(dict.fromkeys((*self.allowlist, *_texts(values, "allowlist")))))

    def with_denied(self, value: str | None = None, pattern: str | None = None, entity: str = "CUSTOM") -> Policy:
        entry = {k: v for k, v in (("value", value), ("pattern", pattern)) if v is not None} | {"entity_type": entity}
        _check_denied(entry)
        return replace(self, denylist=(*self.denylist, entry))

    def with_custom_pattern(self, name: str, pattern: str, action: str = "warn") -> Policy:
        entry = {"pattern": pattern, "action": action}
        _check_custom(name, entry)
        return replace(self, custom_patterns={**self.custom_patterns, name: entry})

    def with_propagation(self, enabled: bool = True, min_length: int = fixed.PROPAGATE_MIN_LENGTH) -> Policy:
        return replace(self, propagate=enabled, propagate_min_length=min_length)

    # files

    @classmethod
    def load(cls, path: str | Path | None = None, salt: str = "") -> Policy:
        """From a YAML file over the defaults; the name "default" selects the built-in policy. A salt given here wins."""
        import yaml

        given: dict[str, Any] = {}
        if path is not None and str(path) == "default":
            given = {"entities": {k: {"enabled": on, "action": a} for k, (on, a) in fixed.DEFAULT_POLICY_ENTITIES.items()}}
        elif path is not None:
            place = Path(path)
            if not place.exists():
                raise FileNotFoundError(f"no policy file {place}")
            given = yaml.safe_load(place.read_text(encoding="utf-8")) or {}
        return cls.of(given, salt)

    @classmethod
    def of(cls, given: Mapping[str, Any], salt: str = "") -> Policy:
        """From the mapping that a policy file holds; it is checked."""
        if unknown := set(given) - set(KEYS):
            log.warning("unknown keys in the policy: %s; known: %s", sorted(unknown), sorted(KEYS))
        custom = given.get("custom_patterns") or {}
        for name, entry in custom.items():
            _check_custom(name, entry)
        allow = given.get("allowlist") or []
        if not isinstance(allow, list):
            raise PolicyError("the allowlist must be a list of texts")
        deny = given.get("denylist") or []
        if not isinstance(deny, list):
            raise PolicyError("the denylist must be a list of mappings")
        for entry in deny:
            _check_denied(entry)
        models = given.get("spacy_models") or ([given["spacy_model"]] if given.get("spacy_model") else [])
        if given.get("use_ner") and not models:
            raise PolicyError("use_ner needs a model")
        llm = dict(given.get("llm_detector") or {})
        asked = {**fixed.LLM_DEFAULT_ENTITIES, **_settings(llm.pop("entities", {}) or {}, "llm_detector.entities", fixed.LLM_DEFAULT_ENTITIES)}
        known = {f for f in ModelLayer.__dataclass_fields__ if f != "entities"}
        layer = ModelLayer(**{k: v for k, v in llm.items() if k in known}, entities=asked)
        _check_llm(layer)
        return cls(
            entities=_settings(given.get("entities") or {}, "entities"),
            salt=salt or given.get("salt") or "",
            max_text_bytes=given.get("max_text_bytes", fixed.MAX_TEXT_BYTES),
            batch_workers=given.get("scan_batch_workers", fixed.BATCH_WORKERS),
            custom_patterns=custom,
            allowlist=tuple(_texts(allow, "allowlist")),
            denylist=tuple(deny),
            propagate=bool(given.get("propagate_matches", False)),
            propagate_min_length=given.get("propagate_min_length", fixed.PROPAGATE_MIN_LENGTH),
            fold=bool(given.get("normalize_confusables", True)),
            ner_models=tuple(models) if given.get("use_ner") else (),
            llm=layer,
        )


def supported_entities(layer: str | None = None) -> list[str]:
    if layer is None:
        return sorted(fixed.ENTITIES)
    if layer not in fixed.LAYERS:
        raise PolicyError(f"unknown layer {layer!r}; known: {sorted(fixed.LAYERS)}")
    return sorted(fixed.LAYERS[layer])


def entity_group(name: str) -> frozenset[str]:
    """Types of one of the groups core, financial, turkish, european, uk, us, network, identity, all."""
    if name not in fixed.GROUPS:
        raise PolicyError(f"unknown group {name!r}; known: {sorted(fixed.GROUPS)}")
    return fixed.GROUPS[name]


def _settings(entries: Any, where: str, base: Mapping[str, Setting] | None = None) -> dict[str, Setting]:
    if not isinstance(entries, Mapping):
        raise PolicyError(f"{where} must be a mapping, not {type(entries).__name__}")
    out = {}
    for name, entry in entries.items():
        if not isinstance(entry, Mapping):
            raise PolicyError(f"{where}: {name} must be a mapping, not {type(entry).__name__}")
        on, action = (base or {}).get(name, (False, "warn"))
        if name not in fixed.ENTITIES:
            log.warning("unknown entity type %r in %s", name, where)
        out[name] = (bool(entry.get("enabled", on)), check_action(entry.get("action", action), f"{where}: {name}"))
    return out


def _texts(values: Iterable[Any], where: str) -> list[str]:
    out = list(values)
    for v in out:
        if not isinstance(v, str):
            raise PolicyError(f"each entry of the {where} must be a text, not {v!r}")
    return out


def _compiled(pattern: Any, where: str) -> re.Pattern:
    if not isinstance(pattern, str):
        raise PolicyError(f"{where}: the pattern must be a text")
    try:
        return re.compile(pattern)
    except re.error as e:
        raise PolicyError(f"{where}: {pattern!r} is no regular expression: {e}") from e


def _check_denied(entry: Any) -> None:
    if not isinstance(entry, Mapping) or not {"value", "pattern"} & set(entry):
        raise PolicyError(f"a denied entry needs a value or a pattern: {entry!r}")
    if "value" in entry and not isinstance(entry["value"], str):
        raise PolicyError(f"a denied value must be a text: {entry!r}")
    if "pattern" in entry:
        _compiled(entry["pattern"], "denylist")
        if backtracks(entry["pattern"]):
            raise PolicyError(f"denied pattern {entry['pattern']!r} may take exponential time; make it simpler")


def _check_custom(name: str, entry: Any) -> None:
    if not isinstance(entry, Mapping) or "pattern" not in entry:
        raise PolicyError(f"custom pattern {name!r} needs a pattern")
    _compiled(entry["pattern"], f"custom pattern {name!r}")
    check_action(entry.get("action", "warn"), f"custom pattern {name!r}")
    if backtracks(entry["pattern"]):
        raise PolicyError(f"custom pattern {name!r} may take exponential time; make it simpler")


def backtracks(pattern: str, seconds: float = 2.0) -> bool:
    """Whether a pattern nests unbounded repeats and then also fails to end on a hostile text: one sign that it names, or one of a usual class, again
    and again. It is tried in a process that can be stopped. What gets past this still has a limit of time for each text."""
    from re import _parser

    def unbounded(items: Any, inside: bool = False) -> bool:
        for op, arg in items:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = arg
                many = high is _parser.MAXREPEAT or high > 20
                if many and inside or unbounded(sub, inside or many):
                    return True
            elif name == "SUBPATTERN" and unbounded(arg[-1], inside) or name == "BRANCH" and any(unbounded(b, inside) for b in arg[1]):
                return True
            elif name in ("ASSERT", "ASSERT_NOT") and unbounded(arg[1], inside):
                return True
        return False

    if not unbounded(_parser.parse(pattern)):
        return False
    try:
        tried = "import re, sys; p = re.compile(sys.argv[1]); [p.search(c * 50 + end) for c in dict.fromkeys('a1 A_-.' + sys.argv[1]) for end in ('\\0', 'b', '')]"
        subprocess.run([sys.executable, "-c", tried, pattern], timeout=seconds, capture_output=True, check=False)
    except subprocess.TimeoutExpired:
        return True
    return False


def _check_llm(layer: ModelLayer) -> None:
    if layer.backend not in fixed.BACKENDS:
        raise PolicyError(f"unknown backend {layer.backend!r}; known: {sorted(fixed.BACKENDS)}")
    if not isinstance(layer.timeout, (int, float)) or layer.timeout <= 0:
        raise PolicyError(f"the timeout must be a positive number, not {layer.timeout!r}")
