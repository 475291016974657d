"""Spark-native building and curation of training data: generate, async_generate, export, load_config."""

from .config import load_config
from .generation.engine import async_generate, generate
from .sinks import export

__all__ = ["async_generate", "export", "generate", "load_config"]
