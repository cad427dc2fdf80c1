"""Validated settings with defaults, and their YAML form."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field

from .schemas import STOPWORDS

log = logging.getLogger(__name__)
MODELS = ("bionlp", "craft", "bc5cdr")
#: Documents of the two named pipeline sizes.
PRESETS = {"quick": 100, "full": 20_000}


@dataclass(frozen=True)
class FilterConfig:
    docs_count_min: int = 2
    sent_count_min: int = 2
    stopwords_enabled: bool = True
    allowed_entity_type_pairs: tuple[tuple[str, str], ...] | None = None
    stopwords: frozenset[str] | None = None

    def __post_init__(self):
        if self.docs_count_min < 1 or self.sent_count_min < 1:
            raise ValueError("counts must be at least 1")

    @property
    def words(self) -> frozenset[str]:
        """The stopwords in force: the given ones in lower case, else the default list."""
        return STOPWORDS if self.stopwords is None else frozenset(w.lower() for w in self.stopwords)


@dataclass(frozen=True)
class LinkerConfig:
    enabled: bool = True
    core_model: str = "dictionary"
    confidence_threshold: float = 0.7
    #: Texts without an alias of their own take the concept of the most similar one from here on; None: equal names alone.
    least_similarity: float | None = None

    def __post_init__(self):
        if self.least_similarity is not None and not 0 < self.least_similarity <= 1:
            raise ValueError("least_similarity must be above 0 and at most 1")
        if not self.core_model.strip():
            raise ValueError("core_model must not be empty")
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must be from 0 to 1")


@dataclass(frozen=True)
class NerConfig:
    model_priorities: dict[str, int] = field(default_factory=lambda: {"bionlp": 3, "craft": 2, "bc5cdr": 1})
    linker: LinkerConfig = field(default_factory=lambda: LinkerConfig(least_similarity=0.7))

    def __post_init__(self):
        if not self.model_priorities:
            raise ValueError("model_priorities must not be empty")
        for model, p in self.model_priorities.items():
            if not isinstance(p, int) or isinstance(p, bool) or p < 1:
                raise ValueError(f"the priority of {model} must be a whole number from 1")
            if model not in MODELS:
                log.warning("unknown model %s", model)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class AgentConfig:
    min_evidence: int = 5
    max_results: int = 20
    max_doc_ids_per_result: int = 10
    max_history_messages: int = 10


def load_ner_config(path: str) -> NerConfig:
    """Settings from a YAML file; what is missing or invalid falls back to the defaults."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        linker = LinkerConfig(**(data.get("linker") or {}))
        return NerConfig(data.get("model_priorities") or NerConfig().model_priorities, linker)
    except (ImportError, OSError, TypeError, ValueError, AttributeError) as e:
        log.warning("default settings instead of %s: %s", path, e)
        return NerConfig()
    except Exception as e:  # yaml's own errors, whose class is unknown without it
        if type(e).__module__.startswith("yaml"):
            return NerConfig()
        raise
