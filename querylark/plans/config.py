"""Settings, from key = value text; checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    analyzer: str = "rule"
    retriever: str = "hybrid"
    embedding: str = "auto"
    k1: float = 1.2
    b: float = 0.75
    top_k: int = 10
    lexical_share: float = 0.7
    semantic_share: float = 0.3
    max_ranked_docs: int = 10
    max_evidence: int = 15
    chunks_per_doc: int = 8
    least_chunk: int = 10
    keyword_boost: float = 3.0
    own_type_boost: float = 10.0
    place_boost: float = 6.0
    preferred_boost: float = 1.0
    strict_chars: int = 200
    normal_chars: int = 400
    expanded_chars: int = 700
    high_confidence: float = 0.85
    low_confidence: float = 0.5
    compressed_confidence: float = 0.6
    compressed_agreement: float = 0.6
    coverage_share: float = 0.3
    volume_share: float = 0.2
    agreement_share: float = 0.3
    penalty_share: float = 0.2
    enough_evidence: float = 3.0
    signals_fail: float = 0.0
    signals_weak: float = 0.15
    fail_factor: float = 0.3
    weak_factor: float = 0.7
    support_coverage: float = 0.5
    profile_path: str = ""
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, allowed in (("analyzer", ("rule", "auto")), ("retriever", ("bm25", "hnsw", "hybrid")), ("embedding", ("bow", "auto"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} = {getattr(self, name)}: one of {', '.join(allowed)} is wanted")
        for name in ("k1", "b", "top_k", "max_ranked_docs", "max_evidence", "chunks_per_doc", "enough_evidence"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} has to be positive")
        for name in ("lexical_share", "semantic_share", "high_confidence", "low_confidence", "compressed_confidence", "compressed_agreement", "coverage_share", "volume_share", "agreement_share", "penalty_share", "support_coverage"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} has to be in 0..1")


#: Keys of settings files (fixed values).
KEYS = {
    "query.analyzer": "analyzer",
    "retrieval.retriever": "retriever",
    "embedding.method": "embedding",
    "bm25.k1": "k1",
    "bm25.b": "b",
    "bm25.top_k": "top_k",
    "retrieval.bm25_weight": "lexical_share",
    "retrieval.ann_weight": "semantic_share",
    "retrieval.max_ranked_docs": "max_ranked_docs",
    "retrieval.max_evidence": "max_evidence",
    "chunk.max_per_doc": "chunks_per_doc",
    "chunk.min_chunk_size": "least_chunk",
    "chunk.keyword_boost": "keyword_boost",
    "chunk.primary_type_boost": "own_type_boost",
    "chunk.secondary_type_boost": "place_boost",
    "chunk.fallback_type_boost": "preferred_boost",
    "scope.strict_max_chars": "strict_chars",
    "scope.normal_max_chars": "normal_chars",
    "scope.expanded_max_chars": "expanded_chars",
    "scope.high_confidence_threshold": "high_confidence",
    "scope.low_confidence_threshold": "low_confidence",
    "compression.min_confidence": "compressed_confidence",
    "compression.min_agreement": "compressed_agreement",
    "confidence.coverage_weight": "coverage_share",
    "confidence.volume_weight": "volume_share",
    "confidence.agreement_weight": "agreement_share",
    "confidence.penalty_weight": "penalty_share",
    "confidence.volume_divisor": "enough_evidence",
    "validator.signal_ratio_fail": "signals_fail",
    "validator.signal_ratio_weak": "signals_weak",
    "validator.fail_confidence_multiplier": "fail_factor",
    "validator.weak_confidence_multiplier": "weak_factor",
    "validator.support_coverage_threshold": "support_coverage",
    "profiling.output_file": "profile_path",
}


def parse(text: str) -> Config:
    """Settings of lines "key = value"; # begins a comment. Keys that aren't known are kept in `extra`."""
    kind = {f.name: {"int": int, "float": float}.get(str(f.type), str) for f in fields(Config)}
    known: dict[str, object] = {}
    extra: dict[str, str] = {}
    for line in text.splitlines():
        key, eq, value = (x.strip() for x in line.partition("#")[0].partition("="))
        if eq and key in KEYS:
            known[KEYS[key]] = kind[KEYS[key]](value)
        elif eq:
            extra[key] = value
    return Config(**known, extra=extra)


def sections(text: str) -> dict[str, list[str]]:
    """Word lists of text with [SECTION] lines and comma-separated entries."""
    out: dict[str, list[str]] = {}
    now = None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            now = out.setdefault(line[1:-1], [])
        elif line and not line.startswith("#") and now is not None:
            now += [w.strip() for w in line.split(",") if w.strip()]
    return out


def rules(text: str) -> list[tuple[str, str]]:
    """(left, right) of lines "left -> right"; other lines don't count."""
    pairs = (line.partition("#")[0].partition("->") for line in text.splitlines())
    return [(a.strip(), b.strip()) for a, arrow, b in pairs if arrow]
