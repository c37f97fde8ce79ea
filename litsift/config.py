"""Settings of a screening project, with presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

# Default model names by encoder.
MODEL_NAMES = {
    "bert": "bert-base-uncased",
    "scibert": "allenai/scibert_scivocab_uncased",
    "pubmedbert": "microsoft/BiomedNLP-PubMedBERT-base-uncased-abstract-fulltext",
    "modernbert": "answerdotai/ModernBERT-base",
    "sentence-transformer": "all-MiniLM-L6-v2",
    "bge-small": "BAAI/bge-small-en-v1.5",
}
FROZEN_ENCODERS = frozenset({"sentence-transformer", "bge-small"})


@dataclass(frozen=True)
class Config:
    """All settings; unknown names are an error, and an unknown encoder takes bert's model name."""

    random_seed: int = 42
    batch_size: int = 16
    eval_batch_size: int = 32
    epochs: int = 10
    learning_rate: float = 2e-5
    early_stopping_patience: int = 3
    dropout_rate: float = 0.2
    mlp_hidden_size: int = 64
    n_hidden_layers: int = 1
    max_length: int = 512
    gradient_clip_norm: float = 1.0
    warmup_steps: int = 0
    embedding_model: str = "bert"
    model_name: str | None = None
    pooling_strategy: str = "auto"
    uncertainty_low: float = 0.3
    uncertainty_high: float = 0.7
    n_folds: int = 5
    calibration_method: str = "temperature"
    al_query_strategy: str = "uncertainty"
    al_batch_size: int = 20
    al_initial_sample_pct: float = 0.1
    rare_threshold: int = 5
    pos_weight: str | float | None = "auto"
    safe_consecutive_irrelevant: int = 50
    safe_min_screened_pct: float = 0.5
    safe_random_sample_pct: float = 0.1
    safe_switch_model: bool = False

    def __post_init__(self) -> None:
        if self.model_name is None:
            object.__setattr__(self, "model_name", MODEL_NAMES.get(self.embedding_model, MODEL_NAMES["bert"]))

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


default_config = Config()
fast_config = Config(epochs=5, batch_size=32, embedding_model="sentence-transformer")
robust_config = Config(epochs=20, early_stopping_patience=5, dropout_rate=0.3, mlp_hidden_size=128)
hitl_config = replace(default_config)
domain_configs = {
    "science": Config(embedding_model="scibert"),
    "medicine": Config(embedding_model="pubmedbert"),
    "general": Config(embedding_model="bert"),
    "modernbert": Config(embedding_model="modernbert"),
}
