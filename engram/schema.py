"""Vocabularies, ranking weights and defaults of the memory graph."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Entity categories.
CATEGORIES = ("world", "opinion", "experience", "observation", "summary")
#: Buckets of a retrieval result, in the order in which the token budget is spent.
BUCKETS = ("world", "opinion", "experience", "observation")
#: The largest k of a search, the deepest walk and the node cap of a walk.
MAX_K = 500
DEPTH_CEILING = 5
MAX_NODES = 100


@dataclass(frozen=True)
class Vocabulary:
    """Declared categories, relations and ordered task states. The defaults."""

    categories: tuple[str, ...] = CATEGORIES
    relations: tuple[str, ...] = ("related_to", "part_of", "causes", "contradicts", "supports", "blocked_by", "recovers_via", "next", "long-range")
    states: tuple[str, ...] = ("pending", "in_progress", "completed")
    task_categories: tuple[str, ...] = ("task",)
    blocking: str = "blocked_by"
    recovery: str = "recovers_via"
    done: str = "completed"


@dataclass(frozen=True)
class Weights:
    """Ranking weights; a zero takes the default, as a weight of zero cannot be expressed. The defaults."""

    vector: float = 0.7
    recency: float = 0.3
    depth: float = 0.05
    temporal: float = 0.0
    centrality: float = 0.05
    recency_hours: float = 720.0
    temporal_hours: float = 720.0

    def with_defaults(self) -> Weights:
        d = Weights()
        return replace(self, **{k: getattr(self, k) or getattr(d, k) for k in d.__dataclass_fields__})


#: Named ranking strategies.
STRATEGIES = {
    "default": Weights(),
    "freshness_first": Weights(0.3, 0.5, 0.05, 0.1, 0.05, 168.0, 168.0),
    "semantic_search": Weights(0.85, 0.05, 0.05, 0.02, 0.03, 1440.0, 1440.0),
    "graph_expansion": Weights(0.3, 0.1, 0.1, 0.05, 0.45, 720.0, 720.0),
}


@dataclass(frozen=True)
class Profile:
    """Retrieval settings by name."""

    weights: Weights = field(default_factory=Weights)
    max_depth: int = 2
    max_nodes: int = MAX_NODES
    k: int = 3


#: Retrieval profiles.
PROFILES = {
    **{name: Profile(w) for name, w in STRATEGIES.items()},
    "conversation_memory": Profile(Weights(0.5, 0.35, 0.05, 0.1, 0.0, 24.0, 24.0).with_defaults(), 1, 50, 5),
}
#: Trust by source type; anything else counts 0.5.
SOURCE_TRUST = {"user": 1.0, "observation": 0.9, "extraction": 0.7, "inference": 0.5, "external": 0.3}
