"""Engine configuration and its checks."""

from __future__ import annotations

from dataclasses import dataclass

RRF_K = 60
POOL_PER_ARM = 30
MAX_SEARCH_K = 50
SEARCH_BUDGET_CHARS = 136_000
DOCUMENT_BUDGET_CHARS = 280_000
MAX_CHARS = 1500
HARD_MAX_CHARS = 4000
MIN_CONTENT_CHARS = 24
CHARS_PER_TOKEN = 4
MAX_OUTLINE_LIMIT = 5000
CHUNK_POLICY = "heading-aware-1500-content-only-v7"


@dataclass(frozen=True)
class EngineConfig:
    """What a corpus declares. All lengths are code points.

    vector_floor: a number, None (never abstain), or "uncalibrated" (refuse to serve).
    """

    tenant: str = "default"
    audiences: tuple[str, ...] = ("public", "internal", "restricted")
    default_visibility: str = "public"
    text_search_config: str = "simple"
    embedding_model: str = "fake"
    embedding_dim: int = 1536
    vector_floor: float | None | str = None
    keyword_floor: float | None = None
    response_characters: int = 120_000

    def __post_init__(self) -> None:
        if not self.audiences or self.audiences[0] != "public" or len(set(self.audiences)) != len(self.audiences):
            raise ValueError("audiences begin with public and don't repeat")
        if self.default_visibility not in self.audiences:
            raise ValueError("default_visibility must be one of the audiences")
        if not 1 <= self.embedding_dim <= 2000:
            raise ValueError("embedding_dim is 1 to 2000")
        if isinstance(self.vector_floor, str) and self.vector_floor != "uncalibrated":
            raise ValueError("vector_floor is a number, None or 'uncalibrated'")

    def visible_tiers(self, viewer: str | None) -> list[str]:
        """The tiers a viewer may read: all up to its own; without a viewer the first."""
        if viewer is None:
            return [self.audiences[0]]
        if viewer not in self.audiences:
            raise ValueError(f"unknown audience {viewer!r}")
        return list(self.audiences[: self.audiences.index(viewer) + 1])
