"""Pipeline constants, in one frozen object that operators take as plain arguments."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Source names, their order, and their fusion weights.
SOURCE_WEIGHTS = {
    "qwen_recent": 0.0,
    "bm25_lastmusic": 1.0,
    "bm25_convo": 1.0,
    "qwen_neighbors": 0.0,
    "cfbpr_recent": 1.0,
    "als_session": 1.0,
    "text_retriever": 1.0,
    "struct_base": 1.0,
    "struct_large": 2.0,
    "clap_recent": 0.5,
}
SOURCE_ORDER = [
    "qwen_recent", "bm25_lastmusic", "bm25_convo", "qwen_neighbors", "cfbpr_recent",
    "als_session", "text_retriever", "struct_base", "struct_large", "clap_recent",
]
# The six live sources behind the rank/presence features, with their short codes.
LIVE_SOURCES = {
    "a": "qwen_recent",
    "b": "bm25_lastmusic",
    "c": "bm25_convo",
    "d": "qwen_neighbors",
    "f": "cfbpr_recent",
    "als": "als_session",
}
# Sources that enter the offline training pools.
POOL_SOURCES_8 = [
    "qwen_recent", "bm25_lastmusic", "bm25_convo", "qwen_neighbors",
    "cfbpr_recent", "als_session", "text_retriever", "struct_base",
]
POOL_SOURCES_9 = POOL_SOURCES_8 + ["struct_large"]


@dataclass(frozen=True)
class Settings:
    """Serving defaults; training variants override single fields."""

    # Fixed values.
    rrf_k: int = 20
    pool_k: int = 300
    top_k: int = 20
    route_low: float = 0.25
    route_high: float = 1.5
    blend_weight: float = 1.0
    recent_k: int = 3
    text_query_turns: int = 3
    history_turns: int = 3
    context_tracks: int = 5
    live_topk: int = 100
    bm25_topk: int = 100
    als_topk: int = 200
    als_decay: float = 0.8
    text_topk: int = 300
    folds: int = 5
    fold_seed: int = 0
    transfer_alpha: float = 0.25
    train_recent_k: int = 5
    train_topk: int = 200
    train_bm25_topk: int = 500
    batch_size: int = 32
    negatives_per_batch: int = 64
    pairs_per_session: int = 2
    sampled_pairs: int = 20_000
    # Lexical scoring (our own choice: Lucene-style BM25).
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    weights: dict = field(default_factory=lambda: dict(SOURCE_WEIGHTS))


DEFAULTS = Settings()

#: What the offline matrices are built with: longer look-back and lists, no audio.
TRAINING = replace(DEFAULTS, recent_k=DEFAULTS.train_recent_k, live_topk=DEFAULTS.train_topk, bm25_topk=DEFAULTS.train_bm25_topk,
                   weights={s: w for s, w in SOURCE_WEIGHTS.items() if s in POOL_SOURCES_9})
