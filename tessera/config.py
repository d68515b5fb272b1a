"""Settings of the engine, as one frozen record with the defaults of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """What a corpus run can be told; every field can be overridden by name."""

    seq_len: int = 4096
    max_seq_len: int = 4096
    prompt_seq_len: int = 2048
    block_stride: int | None = None
    max_files: int = 2048
    batch_size: int = 8
    shuffle: float = 0.05
    vocab: int = 256
    seed: int = 0
    n_prompts: int = 8
    gen_tokens: int = 256
    min_acc: float = 0.0
    grammar_min: float = 0.5
    predictions: int = 1
    predict_set: str = "train"
    label_smoothing: float = 0.0
    ntsc: bool = False

    @property
    def stride(self) -> int:
        """The distance between windows: the window length where none is set."""
        return self.block_stride or self.seq_len

    def __post_init__(self) -> None:
        if self.seq_len < 1 or self.batch_size < 1 or self.vocab < 1:
            raise ValueError("seq_len, batch_size and vocab must be positive")
        if self.stride < 1:
            raise ValueError("block_stride must be positive")
