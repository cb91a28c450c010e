"""Configuration: nested JSON, merged over defaults; values become literals in column expressions."""

from __future__ import annotations

import copy
import json
import os
import shutil
from pathlib import Path
from typing import Any

Config = dict[str, Any]

#: Defaults of every stage.
DEFAULTS: Config = {
    "output_directory": "transcripts",
    "audio_processing": {"enable": False, "target_loudness_lufs": -6.0},
    "recogniser": {"beam_size": 5, "best_of": 5, "patience": 2.0, "compression_ratio_threshold": 3.0, "logprob_threshold": -1.5, "no_speech_threshold": 0.2, "language": "ja", "initial_prompt": None, "condition_on_previous_text": False},
    "segment_merging": {"enable": True, "incomplete_markers": ["て", "で", "と", "が", "けど", "ども", "たり"], "max_merge_gap": 0.5},
    "segment_splitting": {"enable": True, "max_line_length": 30, "primary_breaks": ["。", "？", "！", "?", "!"], "secondary_breaks": ["、", "わ", "ね", "よ"], "enable_llm": False, "enable_revalidate": False},
    "hallucination_filter": {
        "phrase_filter": {"enable": False, "patterns": [], "phrases": [], "regex_patterns": [], "enable_revalidate": False},
        "consecutive_duplicates": {"enable": False, "min_occurrences": 4},
        "timing_validation": {"enable": False, "max_chars_per_second": 20, "enable_revalidate": False},
    },
    "timing_realignment": {
        "enable": False,
        "method": "time_based",
        "min_gap": 0.1,
        "batch_size": 10,
        "text_search": {"expansion": 10.0, "expansion_attempts": 4, "similarity": 0.85, "adjustment_threshold": 0.3},
        "time_based": {"expansion": 3.0, "expansion_attempts": 5, "similarity": 0.6},
    },
    "text_polishing": {"enable": False, "batch_size": 10},
    "final_cleanup": {
        "enable": True,
        "stammer_filter": {
            "enable": True,
            "word_repetition": {"max_pattern_length": 15, "min_repetitions": 5, "condensed_display_count": 3},
            "vocalization_replacement": {
                "enable": False,
                "vocalization_options": ["あ", "ん", "うん", "はぁ", "ふぅ"],
                "short_duration_threshold": 2.0,
                "medium_duration_threshold": 5.0,
                "short_repeat_count": 1,
                "medium_repeat_count": 2,
                "long_repeat_count": 3,
            },
        },
        "global_word_filter": {"enable": False, "min_occurrences": 12},
        "cluster_filter": {"enable": False, "time_window_seconds": 60, "min_occurrences": 6},
    },
    "llm": {"provider": "none", "max_tokens": 1024, "temperature": 0.0, "timeout": 45},
}


def deep_merge(base: Config, over: Config) -> Config:
    """A new config: dicts merge, anything else in ``over`` replaces what ``base`` has."""
    out = dict(base)
    for key, value in over.items():
        held = out.get(key)
        out[key] = deep_merge(held, value) if isinstance(held, dict) and isinstance(value, dict) else copy.deepcopy(value)
    return out


def with_own_names(config: Config) -> Config:
    """``config`` with a block ``whisper``, the recogniser's other name in configuration files, as ``recogniser``."""
    rest = {k: v for k, v in config.items() if k != "whisper"}
    return deep_merge({"recogniser": config["whisper"]}, rest) if isinstance(config.get("whisper"), dict) else rest


def load_config(path: str | None = None, local: str | None = None) -> Config:
    """Defaults, then the file at ``path``, then that at ``local`` (if it exists), then the key in the environment.

    Raises FileNotFoundError or ValueError for a missing or malformed file.
    """
    config = copy.deepcopy(DEFAULTS)
    for name, needed in ((path, True), (local, False)):
        if not name or (not needed and not Path(name).exists()):
            continue
        try:
            config = deep_merge(config, with_own_names(json.loads(Path(name).read_text(encoding="utf-8"))))
        except json.JSONDecodeError as error:
            raise ValueError(f"{name} is not valid JSON: {error}") from error
    if key := os.environ.get("ANTHROPIC_API_KEY"):
        config = deep_merge(config, {"llm": {"anthropic": {"api_key": key}}})
    return config


def stage_llm(config: Config, stage: str) -> Config:
    """The model settings of a stage: the common ones with the stage's ``llm_provider`` and ``llm_timeout``."""
    own = config.get(stage, {})
    more = {to: own[name] for name, to in (("llm_provider", "provider"), ("llm_timeout", "timeout")) if name in own}
    return deep_merge(config.get("llm", {}), more)


def validate_llm_requirements(config: Config) -> bool:
    """Whether what the enabled model features need is there: for a local server, its binary or a base URL."""
    uses = [s for s, on in (("segment_splitting", config["segment_splitting"].get("enable_llm")), ("text_polishing", config["text_polishing"].get("enable"))) if on]
    for stage in uses:
        llm = stage_llm(config, stage)
        if llm.get("provider") == "ollama" and not llm.get("ollama", {}).get("base_url") and not shutil.which("ollama"):
            return False
    return True
