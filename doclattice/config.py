"""Thresholds and limits of the engine, in one frozen place.

The values are fixed: results match the documented behaviour only with them. Each may be overridden by
constructing another ``Settings``.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # layout
    line_tolerance: float = 3.0
    segment_gap: float = 10.0
    region_gap: float = 4.8
    region_shift: float = 28.0
    region_shift_share: float = 0.08
    full_width_share: float = 0.58
    # chunks and batches
    chunk_chars_fast: int = 2400
    chunk_chars_quality: int = 1200
    chunk_chars_llm: int = 6000
    overlay_items: int = 120
    overlay_chars: int = 12000
    overlay_llm_items: int = 4
    overlay_llm_chars: int = 2200
    tex_items: int = 8
    tex_chars: int = 5000
    token_batch: int = 8192
    token_input: int = 384
    # job control
    max_running: int = 4
    max_queued: int = 2
    max_nmt_running: int = 1
    job_ttl_seconds: int = 3600
    upload_mb: int = 300
    memory_budget_mb: int = 100 * 1024
    min_free_mb: int = 8 * 1024
    default_job_mb: int = 20 * 1024
    nmt_job_mb: int = 6 * 1024
    #: (billions of parameters up to, MB reserved)
    model_tiers: tuple[tuple[float, int], ...] = ((4, 8192), (10, 18432), (14, 24576), (22, 36864), (34, 49152))
    # request limits of the model service
    service_body_bytes: int = 5 * 1024 * 1024
    service_texts: int = 32
    service_chars: int = 300_000
    # archives
    archive_bytes: int = 1 << 30
    #: word of the markers that stand for protected fragments
    marker: str = "DOCLATTICE"
    batch_limits: tuple[tuple[str, str, int, int], ...] = field(
        default=(
            # engine, mode, items, characters
            ("nmt", "fast", 12, 200000),
            ("nmt", "page", 12, 200000),
            ("nmt", "quality", 8, 100000),
            ("llm", "page", 1, 6000),
            ("llm-reasoning", "page", 1, 6000),
            ("llm-reasoning", "fast", 32, 10000),
            ("llm", "fast", 48, 14000),
            ("copy", "fast", 24, 8000),
            ("llm-reasoning", "quality", 24, 6000),
            ("llm", "quality", 24, 7000),
            ("copy", "quality", 16, 4800),
            ("copy", "page", 16, 4800),
        )
    )


DEFAULT = Settings()

#: Engines by the name in requests.
ENGINES = {"copy": "copy", "nmt": "nmt", "ollama": "llm"}


def batch_limits(engine: str, mode: str, settings: Settings = DEFAULT) -> tuple[int, int]:
    """(items, characters) for an engine and a mode; an unknown mode counts as quality."""
    table = {(e, m): (i, c) for e, m, i, c in settings.batch_limits}
    return table.get((engine, mode)) or table[engine, "quality"]

# Models by engine, the first of each being its default.
MODELS = {
    "nmt": ["nllb-200-distilled-600m"],
    "ollama": [
        "qwen2.5:3b-instruct",
        "qwen2.5:3b",
        "gemma3:4b",
        "qwen3:4b",
        "qwen2.5:7b-instruct",
        "qwen2.5:7b",
        "qwen3:8b",
        "deepseek-r1:7b",
        "llama3.1:8b",
        "gemma2:9b",
        "gpt-oss:20b",
        "qwen3:30b",
        "gemma3:27b",
        "deepseek-r1:32b",
    ],
}
