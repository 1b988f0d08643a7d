"""Tunable limits shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # retrieval
    retrieval_limit: int = 5
    candidate_floor: int = 16
    max_query_variants: int = 10
    rewrite_enabled: bool = True
    step_back_enabled: bool = True
    hyde_enabled: bool = True
    # chunking
    parent_tokens: int = 1800
    child_tokens: int = 480
    child_overlap_tokens: int = 80
    snippet_chars: int = 1600
    # memory
    working_token_threshold: int = 1200
    compaction_ratio: float = 0.75
    episodic_limit: int = 4
    semantic_limit: int = 6
    # uploads
    upload_max_bytes: int = 100 * 1024 * 1024
    resumable_max_bytes: int = 1024 * 1024 * 1024
    upload_part_bytes: int = 8 * 1024 * 1024
    # routing
    live_tools_enabled: bool = True
    public_web_enabled: bool = True
    # physical: a table is broadcast only after a count proves it is below this
    broadcast_max_rows: int = 200_000
    # physical: postings of a token that one salt of a shuffled join holds
    salt_rows: int = 1_000_000
    # physical: query vectors that one task may hold as a matrix
    dense_block_rows: int = 4096

    @property
    def candidate_limit(self) -> int:
        return self.candidates_for(self.retrieval_limit)

    def candidates_for(self, limit: int) -> int:
        return max(self.candidate_floor, limit * 4)

    @property
    def compaction_share(self) -> float:
        return min(max(self.compaction_ratio, 0.05), 0.9)


DEFAULTS = Settings()
