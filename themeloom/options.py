"""Settings of an analysis run, passed as plain arguments."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Defaults that decide results.
BATCH_SIZE = 25
MAX_THEMES_PER_TEXT = 3
MIN_TEXT_LENGTH = 5
FINAL_THEME_COUNT = 10
MAPPING_CHUNK_SIZE = 20
KNOWN_THEMES = 20
MAX_EXAMPLES = 30
MAX_QUOTES = 5
ANALYSIS_WORDS = 1000
MIN_CONFIDENCE = 0.6
HIGH_CONFIDENCE = 0.8
SIMILARITY_THRESHOLD = 0.85
CACHE_DAYS = 7
MAX_BATCH_TOKENS = 4000
TARGET_BATCH_TOKENS = 3000
BASE_PROMPT_TOKENS = 500
OVERHEAD_PER_ENTRY = 50
USD_PER_1K_TOKENS = 0.01
USD_PER_1K_INPUT = 0.005
USD_PER_1K_OUTPUT = 0.015
NA_THEME = "NA"
FAILED_SUMMARY = "Error: Analysis failed"
UNCATEGORIZED = "Uncategorized"

# Ours: how many themes one consolidation request lists; longer lists are consolidated in rounds.
THEMES_PER_CONSOLIDATION = 500


@dataclass(frozen=True)
class Call:
    """How the model is called for one kind of request; None leaves it to the callable."""

    kind: str
    temperature: float | None = None
    max_tokens: int | None = None
    deployment: str | None = None


# Temperature and longest reply, in tokens, by kind of request.
CALLS = {
    "batch": Call("batch", 0.5, 20_000),
    "writeup": Call("writeup", 0.5, 2 * ANALYSIS_WORDS),
    "quotes": Call("quotes", 0.5, 20_000),
    "verdict": Call("verdict", 0.5, 200),
    "mapping": Call("mapping", 0.2, 1_000),
    "consolidation": Call("consolidation", 0.3, 1_000),
}


@dataclass(frozen=True)
class Options:
    """Options of :func:`themeloom.plans.analysis.analyze`."""

    text_column: str = "text"
    row_id: str = "row_id"
    question: str = ""
    min_text_length: int = MIN_TEXT_LENGTH
    drop_duplicates: bool = True
    batch_size: int = BATCH_SIZE
    max_themes_per_text: int = MAX_THEMES_PER_TEXT
    case_mode: str = "running"
    similarity_threshold: float = SIMILARITY_THRESHOLD
    consolidate: bool = True
    final_theme_count: int = FINAL_THEME_COUNT
    mapping_chunk_size: int = MAPPING_CHUNK_SIZE
    themes_per_consolidation: int = THEMES_PER_CONSOLIDATION
    cache_days: int = CACHE_DAYS
    count_cached_calls: bool = True
    model_tasks: int | None = None
    # Where replies are kept as they come: below the run's stages (True), nowhere (False), or in a folder for later
    # runs, which holds the replies of one model.
    journal: str | bool = True
    calls: Mapping[str, Call] = field(default_factory=lambda: dict(CALLS))

    def __post_init__(self) -> None:
        if self.themes_per_consolidation <= self.final_theme_count:
            raise ValueError("themes_per_consolidation must exceed final_theme_count, or rounds do not end")
