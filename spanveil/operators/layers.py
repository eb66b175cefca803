"""Layers that run in Python: patterns in its dialect, named-entity models, language models.

Each is an Arrow function from texts to spans.  A layer that fails on a text gives no spans and a
warning; it never ends the task.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import functions as F

from ..errors import PolicyError
from ..functions.fixed import MODEL, NER_LABELS
from ..functions.spans import SPANS
from ..functions.text import chunk_by_paragraph, like_a_person, locate_findings, only_stopwords, parse_findings
from ..plans.policy import ModelLayer
from ..sources.backends import Backend, backend_of
from ..sources.catalog import check_model_name
from ..sources.prompts import findings_prompt

#: From texts to lists of (label, start, end).
NerModel = Callable[[list[str]], list[list[tuple[str, int, int]]]]
_ner: dict[str, Callable[[], NerModel]] = {}
_loaded: dict[str, NerModel] = {}

#: Seconds that a pattern of one's own may take for a text; texts that a named-entity model gets at once; calls of a language model under way in a task.
PATTERN_SECONDS, NER_BATCH, LLM_CALLS = 2.0, 64, 8
LAYER = f"struct<spans:{SPANS},warning:string>"


def register_ner_model(name: str, load: Callable[[], NerModel]) -> None:
    """load is called once in each Python worker; it may import what only the cluster's image has."""
    _ner[name] = load


def spacy_model(name: str) -> Callable[[], NerModel]:
    """A loader for an installed spaCy model."""

    check_model_name(name)

    def load() -> NerModel:
        import spacy

        nlp = spacy.load(name)
        return lambda texts: [[(e.label_, e.start_char, e.end_char) for e in d.ents] for d in nlp.pipe(texts)]

    return load


#: From a text to (entity type, start, end, confidence) of what it holds.
Detector = Callable[[str], list[tuple[str, int, int, float]]]
_detectors: dict[str, Detector] = {}
_answers: dict[str, tuple[float, list]] = {}


def register_detector(name: str, detect: Detector) -> None:
    """A detector of one's own; whatever it reports takes part in the resolution of overlaps."""
    _detectors[name] = detect


def detector_spans(name: str, seq: int):
    if name not in _detectors:
        raise PolicyError(f"unknown detector {name!r}; known: {sorted(_detectors)}")
    detect = _detectors[name]

    @F.pandas_udf(LAYER)
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                found = detect(t) if t is not None else []
                out.append(([{"entity_type": k, "text": t[a:b], "start": a, "end": b, "confidence": float(c), "seq": seq} for k, a, b, c in found], None))
            except Exception as e:  # noqa: BLE001
                out.append(([], f"{name} did not run: {e}"))
        return pd.DataFrame(out, columns=["spans", "warning"])

    return find.asNondeterministic()


def python_pattern_spans(entries: list[tuple[str, str, float]], seq: int, seconds: float = PATTERN_SECONDS):
    """entries: (entity type, pattern, confidence). A pattern that takes longer than so many seconds on a text finds nothing there, and the row gets a warning."""
    import regex

    compiled = [(e, regex.compile(p, regex.V0), c) for e, p, c in entries]

    @F.pandas_udf(LAYER)
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            spans, late = [], []
            for k, (e, p, c) in enumerate(compiled if t is not None else ()):
                try:
                    spans += [{"entity_type": e, "text": m.group(), "start": m.start(), "end": m.end(), "confidence": c, "seq": seq + k} for m in list(p.finditer(t, timeout=seconds))]
                except TimeoutError:
                    late.append(e)
            out.append((spans, f"patterns that took over {seconds:g} s were skipped: {', '.join(late)}" if late else None))
        return pd.DataFrame(out, columns=["spans", "warning"])

    return find


def ner_spans(model: str, wanted: set[str], seq: int):
    if model not in _ner:
        _ner[model] = spacy_model(model)
    load = _ner[model]

    def found(text: str, entities: list[tuple[str, int, int]]) -> list[dict]:
        rows = []
        for label, a, b in entities:
            kind, value = NER_LABELS.get(label), text[a:b]
            if kind in wanted and not only_stopwords(value) and (kind != "PERSON" or like_a_person(value)):
                rows.append({"entity_type": kind, "text": value, "start": a, "end": b, "confidence": MODEL, "seq": seq})
        return rows

    def asked(texts: list[str]) -> list[tuple[list[dict], str | None]]:
        """All texts at once; where the model fails on them, one by one."""
        try:
            if model not in _loaded:
                _loaded[model] = load()
            return [(found(t, entities), None) for t, entities in zip(texts, _loaded[model](texts), strict=True)]
        except Exception as e:  # noqa: BLE001  a layer's failure is told, not passed on
            if len(texts) == 1 or model not in _loaded:
                return [([], f"NERDetector did not run: {e}")] * len(texts)
            return [asked([t])[0] for t in texts]

    @F.pandas_udf(LAYER)
    def find(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple[list[dict], str | None]] = [([], None)] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        for at in range(0, len(full), NER_BATCH):
            some = full[at : at + NER_BATCH]
            for i, row in zip(some, asked([texts.iloc[i] for i in some]), strict=True):
                out[i] = row
        return pd.DataFrame(out, columns=["spans", "warning"])

    # a model is asked once for each text: the optimizer must not repeat the call
    return find.asNondeterministic()


def find_with_llm(backend: Backend, layer: ModelLayer, text: str, candidates: list[dict] | None, seen: dict[str, tuple[float, list]]) -> tuple[list[tuple], str | None]:
    """Spans of one text, and a warning if a chunk failed; the other chunks' findings are kept."""
    wanted = {k for k, (on, _) in layer.entities.items() if on}
    if not text.strip() or not wanted:
        return [], None
    given = candidates if layer.adjudicate else None
    parts = sorted((c["start"], c["end"], c["entity_type"]) for c in given or [])
    key = hashlib.md5(repr((layer.backend, layer.model, sorted(wanted), text, parts)).encode("utf-8", "replace"), usedforsecurity=False).hexdigest()
    if layer.cache_ttl and key in seen and seen[key][0] > time.time():
        return seen[key][1], None
    spans, warning = [], None
    for chunk, at in chunk_by_paragraph(text, layer.chunk_chars):
        inside = [(c["entity_type"], c["text"]) for c in given or [] if c["start"] >= at and c["end"] <= at + len(chunk)]
        try:
            reply = backend.complete(findings_prompt(chunk, wanted, inside if given is not None else None))
            spans += [(k, v, a + at, b + at) for k, v, a, b in locate_findings(chunk, parse_findings(reply), wanted)]
        except Exception as e:  # noqa: BLE001
            warning = f"LLMDetector did not run: {e}"
    if layer.cache_ttl and warning is None:
        if len(seen) > 10_000:
            seen.clear()
        seen[key] = (time.time() + layer.cache_ttl, spans)
    return spans, warning


def llm_spans(layer: ModelLayer, seq: int):
    if not isinstance(layer, ModelLayer):
        raise PolicyError("no language-model layer")
    make = backend_of(layer)

    @F.pandas_udf(LAYER)
    def find(texts: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        backend = make()

        def ask(row: tuple) -> tuple[list[dict], str | None]:
            t, c = row
            rows, warning = ([], None) if t is None else find_with_llm(backend, layer, t, None if c is None else list(c), _answers)
            return [{"entity_type": k, "text": v, "start": a, "end": b, "confidence": MODEL, "seq": seq} for k, v, a, b in rows], warning

        # the calls wait for a server, so several are under way at a time
        with ThreadPoolExecutor(LLM_CALLS) as pool:
            out = list(pool.map(ask, zip(texts, candidates, strict=True)))
        return pd.DataFrame(out, columns=["spans", "warning"])

    # a model is asked once for each text: the optimizer must not repeat the call
    return find.asNondeterministic()
