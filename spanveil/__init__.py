"""A Spark engine that finds and anonymises sensitive data in text columns."""

from importlib import import_module

#: What users of the scan need, by the module it lives in; loaded when first asked for.
_PLACES = {
    "errors": ("SpanveilError", "PolicyError", "ModelError", "UnsupportedLanguageError"),
    "plans.policy": ("Policy", "ModelLayer", "entity_group", "supported_entities"),
    "functions.actions": ("ActionContext", "register_action", "register_python_action", "registered_actions"),
    "functions.fixed": ("ENTITIES", "ALL_ENTITIES", "ACTIONS", "BACKENDS"),
    "operators.scan": ("scan", "violations", "redacted", "reapply", "filter_has_entity"),
    "operators.sensitivity": ("is_sensitive",),
    "operators.layers": ("register_ner_model", "register_detector"),
    "operators.analytics": ("density", "by_type", "gaps", "evaluate"),
    "sources.tables": ("read_texts", "texts", "write_safe", "json_leaves", "guard_requests"),
    "sources.catalog": ("supported_languages", "ner_model", "ModelManager"),
    "streaming.scan": ("stream_files", "scan_stream", "findings_by_window"),
}
_WHERE = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
