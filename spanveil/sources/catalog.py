"""Which models there are, and how one is chosen; fetching them is the cluster image's business."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import ModelError, UnsupportedLanguageError
from .backends import MODELS, RECOMMENDED_MODEL, Backend


@dataclass(frozen=True)
class NerModelInfo:
    name: str
    language: str
    size: str
    ram_mb: int

    @property
    def code(self) -> str:
        return self.name[:2]


# spaCy models. (name, language, MB of memory)
NER_MODELS = tuple(
    NerModelInfo(name, language, name.rsplit("_", 1)[1], ram)
    for name, language, ram in (
        ("en_core_web_sm", "English", 15), ("en_core_web_md", "English", 50), ("en_core_web_lg", "English", 750), ("en_core_web_trf", "English", 440),
        ("tr_core_news_md", "Turkish", 156), ("tr_core_news_lg", "Turkish", 560), ("tr_core_news_trf", "Turkish", 850),
        ("de_core_news_sm", "German", 15), ("de_core_news_md", "German", 50), ("de_core_news_lg", "German", 560), ("de_dep_news_trf", "German", 450),
        ("fr_core_news_sm", "French", 15), ("fr_core_news_md", "French", 50), ("fr_core_news_lg", "French", 560), ("fr_dep_news_trf", "French", 450),
        ("es_core_news_sm", "Spanish", 13), ("es_core_news_md", "Spanish", 50), ("es_core_news_lg", "Spanish", 560), ("es_dep_news_trf", "Spanish", 450),
        ("it_core_news_sm", "Italian", 13), ("it_core_news_md", "Italian", 50), ("it_core_news_lg", "Italian", 560),
        ("nl_core_news_sm", "Dutch", 13), ("nl_core_news_md", "Dutch", 50), ("nl_core_news_lg", "Dutch", 560),
        ("pt_core_news_sm", "Portuguese", 13), ("pt_core_news_lg", "Portuguese", 560),
    )
)
# A model that no current version loads, and the shape of model names.
INCOMPATIBLE = frozenset({"tr_core_news_trf"})
MODEL_NAME = re.compile(r"^[a-z]{2,3}_[a-z0-9]+(?:_[a-z0-9]+)*$")


def supported_languages() -> list[str]:
    return sorted({m.code for m in NER_MODELS})


def ner_model(code: str, size: str = "sm") -> NerModelInfo:
    """The language's model of that size, else its smallest that can be loaded."""
    able = [m for m in NER_MODELS if m.code == code.lower() and m.name not in INCOMPATIBLE]
    if not able:
        raise UnsupportedLanguageError(f"no model for {code!r}; known: {supported_languages()}")
    return next((m for m in able if m.size == size), able[0])


def check_model_name(name: str) -> str:
    if not MODEL_NAME.match(name):
        raise ModelError(f"{name!r} is no model's name")
    return name


@dataclass
class ModelManager:
    """Looks after the models behind a backend, from the driver. agree: asked before anything is fetched."""

    backend: Backend
    agree: Callable[[str], bool] = lambda model: False

    def list(self) -> list[str]:
        return self.backend.list_models()

    def ensure(self, model: str, tell: Callable[[dict], None] = lambda progress: None) -> bool:
        """Whether the model is there, fetched if need be and agreed to."""
        if self.backend.is_model_available(model):
            return True
        if not self.agree(model):
            return False
        for progress in self.backend.pull_model(model):
            tell(progress)
        return self.backend.is_model_available(model)

    @staticmethod
    def known(most_gb: float | None = None) -> list[str]:
        """Models that fit into so much memory, the recommended one first."""
        fit = [name for name, _, gb in MODELS if most_gb is None or gb <= most_gb]
        return sorted(fit, key=lambda n: n != RECOMMENDED_MODEL)
