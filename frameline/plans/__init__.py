"""Queries by area; importing the package fills the registry."""

from . import audio, landmarks, more, registry, scale, segments, words  # noqa: F401
