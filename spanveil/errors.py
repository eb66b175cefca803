"""Exceptions."""


class SpanveilError(Exception):
    """Base of this package's exceptions."""


class PolicyError(SpanveilError, ValueError):
    """A policy that can't be carried out."""


class UnsupportedLanguageError(PolicyError):
    """No model is known for a language."""


class ModelError(SpanveilError, RuntimeError):
    """A model can't be loaded or reached."""
