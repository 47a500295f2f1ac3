"""Settings and their invariants."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    provider_key: str | None = None
    store_key: str | None = None
    api_key: str | None = None
    reranker: str | None = None  # None, "passthrough", "lexical" or "hosted"
    chunk_size: int = 500
    chunk_overlap: int = 150
    dense_k: int = 10
    sparse_k: int = 10
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    rrf_k: int = 60
    rerank_top_n: int = 5
    fused_budget: int = 8
    prune_margin: float = 0.5
    neighbour_window: int = 1
    context_tokens: int = 2000
    rate_limit_per_minute: int = 60
    max_upload_bytes: int = 20 * 1024 * 1024

    def __post_init__(self) -> None:
        wrong = []
        if not (0 <= self.dense_weight <= 1 and 0 <= self.sparse_weight <= 1 and abs(self.dense_weight + self.sparse_weight - 1) <= 1e-6):
            wrong.append("the weights must lie in 0 to 1 and add up to 1")
        if self.rerank_top_n > self.dense_k + self.sparse_k:
            wrong.append("rerank_top_n can't exceed what both searches give")
        if self.rerank_top_n > self.fused_budget:
            wrong.append("rerank_top_n can't exceed the fused budget")
        if self.chunk_overlap >= self.chunk_size:
            wrong.append("the overlap must be smaller than the chunk")
        if self.environment == "production" and not (self.provider_key and self.store_key and self.api_key):
            wrong.append("production needs all three keys")
        if self.reranker == "hosted" and not self.provider_key:
            wrong.append("a hosted reranker needs a key")
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def provider(self) -> str:
        """hosted if there is a key, else the deterministic one."""
        return "hosted" if self.provider_key else "deterministic"

    def shown(self) -> dict:
        """The settings without secrets."""
        return {k: ("***" if v and k.endswith("_key") else v) for k, v in asdict(self).items()}


def settings_from(values: dict) -> Settings:
    """Settings of a dict; unknown names are errors."""
    unknown = set(values) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return Settings(**values)
