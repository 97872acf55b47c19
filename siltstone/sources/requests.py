"""Ingestion requests: what a user asks for, checked before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from siltstone.operators.store import valid_ref_name

METHODS = ("kmeans", "pca")
#: Where an archive is kept. Test settings of the clustering are for local ones.
ENVIRONMENTS = ("local", "local-overlay", "production")
#: Profile versions whose clusterings take no number of clusters from outside (fixed values of the format).
SELF_SIZED_PROFILES = ((0, 7, 0), (0, 8, 0))


@dataclass
class Request:
    """One run: where texts come from, how they are embedded, how the tree is built."""

    ref_name: str
    documents: str | None = None
    mailboxes: str | None = None
    dims: int = 384
    encoding: str = "f32le"
    block_bytes: int = 65_536
    method: str = "kmeans"
    clusters: int | None = None
    seed: int = 0
    stages: tuple[str, ...] = ("ingest", "cluster")
    environment: str = "local"
    profile_version: tuple[int, int, int] = (0, 6, 0)
    max_concurrency: int | None = None
    replay_batch_size: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def check(self) -> Request:
        self.ref_name = valid_ref_name(self.ref_name)
        problems = [
            ("ingest" in self.stages and not (self.documents or self.mailboxes), "no documents and no mailboxes to ingest"),
            (self.dims < 1, "dims must be at least 1"),
            (self.encoding not in ("f32le", "f16le"), "encoding must be f32le or f16le"),
            (self.block_bytes < 1, "block_bytes must be at least 1"),
            (self.method not in METHODS, f"method must be one of {METHODS}"),
            (self.clusters is not None and self.clusters < 1, "clusters must be at least 1"),
            (self.environment not in ENVIRONMENTS, f"environment must be one of {ENVIRONMENTS}"),
            (self.clusters is not None and self.environment == "production", "a number of clusters is for local environments"),
            (self.clusters is not None and self.profile_version in SELF_SIZED_PROFILES, f"profile {'.'.join(map(str, self.profile_version))} takes no number of clusters"),
            (self.max_concurrency is not None and self.max_concurrency < 1, "max_concurrency must be at least 1"),
            (self.replay_batch_size is not None and self.replay_batch_size < 1, "replay_batch_size must be at least 1"),
            (not self.stages or bool(set(self.stages) - {"ingest", "cluster"}), "stages are ingest and cluster"),
        ]
        for wrong, message in problems:
            if wrong:
                raise ValueError(message)
        return self

    def with_overrides(self, profile_version: tuple[int, int, int] | None = None, clusters: int | None = None) -> Request:
        """The request with what a caller sets on top of it; what is not given stays. The result is checked."""
        return replace(self, profile_version=profile_version or self.profile_version, clusters=self.clusters if clusters is None else clusters).check()

    def batch_size(self, cores: int) -> int:
        """Items of a replay batch: as asked for, else as many as are worked on at once."""
        return self.replay_batch_size or self.max_concurrency or cores

    def clustering(self) -> dict:
        """What the clustering of this request does, as failure reports state it."""
        halving = self.method == "pca"
        return {
            "profile_version": ".".join(map(str, self.profile_version)), "planning_algorithm_id": "directional-pca" if halving else "spherical-kmeans", "planning_direction": "divisive",
            "packing_strategy_id": None if halving else "greedy-pack", "cluster_count": self.clusters, "random_seed": None if halving else self.seed,
        }


def should_retry(attempt: int, most: int, status: int | None) -> bool:
    """Whether a failed embedding call is worth another attempt."""
    return attempt < most and status in (None, 429, 502, 503, 504)
