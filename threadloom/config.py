"""Configuration from YAML; every key is honoured by the component that it names."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml

#: Defaults of the analysis, by section.
DEFAULTS: dict[str, dict[str, Any]] = {
    "sentiment": {"transformer_batch_size": 32, "emotion_labels": ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]},
    "coherence": {"cosine_low_threshold": 0.25, "bertscore_low_threshold": 0.85, "cross_encoder_low_threshold": 0.50, "batch_size": 64, "pairing_strategy": "thread_root"},
    "conversation": {"signal": "roberta_compound", "secondary_signal": "vader_compound", "min_turns_dynamics": 3, "slope_threshold": 0.05, "volatility_threshold": 0.25, "changepoint_model": "rbf", "changepoint_penalty": 3},
    "topic_modeling": {"lda_num_topics": 8, "lda_passes": 10, "lda_no_below": 10, "lda_no_above": 0.5, "min_tokens": 7, "random_state": 42},
    "clustering": {
        "embedding_batch_size": 64, "random_state": 42, "hdbscan_min_cluster_size_tweets": 20, "hdbscan_min_samples_tweets": 3, "pca_variance_threshold": 0.80, "gmm_n_components": 4, "hdbscan_min_cluster_size_agents": 6, "hdbscan_min_samples_agents": 2,
        "cluster_features": ["mean_sent", "std_emo", "mtld", "pronoun_ratio", "mean_emoji_rate", "avg_reply_coherence", "has_parent"],
    },
    "echo_chamber": {
        "pro_stance_threshold": 0.3, "anti_stance_threshold": -0.3, "beta": 0.5, "embedding_batch_size": 32,
        "polarization_score_weights": {"variance": 0.4, "bimodality": 0.3, "inter_group_distance": 0.3},
        "echo_chamber_score_weights": {"polarization": 0.3, "homophily": 0.3, "diversity": 0.2, "separation": 0.2},
    },
}


class Config:
    """A mapping read from a YAML file, over the defaults."""

    def __init__(self, path: str | Path | None = None):
        self.path = Path(path) if path is not None else None
        own = self._read(self.path) if self.path is not None else {}
        self.data: dict[str, Any] = {k: dict(v) for k, v in DEFAULTS.items()}
        for key, value in own.items():
            if isinstance(value, dict) and isinstance(self.data.get(key), dict):
                self.data[key] |= value
            else:
                self.data[key] = value

    @staticmethod
    def _read(path: Path) -> dict[str, Any]:
        if not path.exists():
            raise FileNotFoundError(f"no configuration at {path}")
        try:
            got = yaml.safe_load(path.read_text(encoding="utf-8"))
        except yaml.YAMLError as error:
            raise ValueError(f"{path} is not valid YAML") from error
        if got is None:
            raise ValueError(f"{path} is empty")
        if not isinstance(got, dict):
            raise ValueError(f"{path} holds no mapping")
        return got

    def __getitem__(self, key: str) -> Any:
        return self.data[key]

    def get(self, key: str, default: Any = None) -> Any:
        return self.data.get(key, default)


def resolve_path(path: str | Path, root: str | Path) -> Path:
    """An absolute path as it is, another below the root."""
    path = Path(path)
    return path if path.is_absolute() else Path(root) / path
