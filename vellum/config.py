"""Settings of the engine: typed, frozen, read from the environment where set."""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class Settings:
    """Defaults of every stage; from_env() takes upper-case names from the environment, e.g. CHUNK_SIZE."""

    app_name: str = "vellum"
    languages: str = "en,hi"
    embedding_dimension: int = 384
    batch_size: int = 64
    index_type: str = "IVF"
    nlist: int = 100
    nprobe: int = 32
    chunk_size: int = 500
    chunk_overlap: int = 50
    top_k: int = 30
    relevance_threshold: float = 0.45
    min_retrieval_confidence: float = 0.38
    min_topic_score: float = 0.3
    min_chunks_required: int = 1
    min_context_chars: int = 100
    min_grounding_score: float = 0.65
    use_llm: bool = False
    llm_temperature: float = 0.3
    llm_max_tokens: int = 1000
    ocr_dpi: int = 300
    ocr_language: str = "eng"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {}
        for f in dataclasses.fields(cls):
            raw = env.get(f.name.upper())
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**found)

    @property
    def language_list(self) -> list[str]:
        """A comma-separated setting as a list of trimmed parts: the languages that questions may be asked in."""
        return [x.strip() for x in self.languages.split(",")]
