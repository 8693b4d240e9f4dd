"""Settings of an analysis. Unknown keys are refused instead of being carried along."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

# Bump when a change alters stored results; it is part of every run key.
RESULT_VERSION = 2


@dataclass(frozen=True)
class Config:
    # Fixed default values.
    cluster_method: str = "HDBSCAN"
    cluster_n_clusters: int = 5
    hierarchical_layers: int = 1
    hclust_umap_n_components: int = 2
    hclust_min_samples: int = 5
    hclust_min_cluster_size: int = 25
    dbscan_eps: float = 0.5
    gmm_n_components: int = 2
    method: str = "PCA"
    prereduce_method: str = "PCA"
    normalize: bool = True
    predicate_scope: str = "local"
    tsne_perplexity: float = 30.0
    tsne_learning_rate: float = 200.0
    tsne_random_state: int = 42
    umap_n_neighbors: int = 15
    umap_min_dist: float = 0.1
    umap_random_state: int = 42
    layout_epochs: int = 12
    mds_metric: bool = True
    mds_n_init: int = 2
    mds_max_iter: int = 100
    mds_random_state: int = 42

    @classmethod
    def of(cls, **overrides) -> "Config":
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(overrides) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**overrides)

    def run_key(self, dataset: str, columns: list[str]) -> str:
        text = json.dumps(
            {"version": RESULT_VERSION, "dataset": dataset, "columns": sorted(columns), "config": asdict(self)},
            sort_keys=True,
        )
        return hashlib.sha256(text.encode()).hexdigest()
