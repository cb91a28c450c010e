"""The stages in their order, as one lazy plan; a disabled stage adds no node."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cuewise.config import DEFAULTS, Config, deep_merge, stage_llm, with_own_names
from cuewise.operators import align, cleanup, filters, merge, polish, split
from cuewise.operators.cues import vtt_cues
from cuewise.operators.models import RecogniserFactory, TextModelFactory, text_model
from cuewise.plans.counters import Counters, unwatched
from cuewise.schema import as_segments
from cuewise.sources.details import set_aside


@dataclass
class Pipeline:
    """Segments to cleaned, realigned and polished segments, media item by media item.

    ``truth`` feeds a recogniser that reads a table of words; ``model`` overrides the provider of the config. ``counters`` observes
    each step. ``details`` is a folder for the questions and answers of a text model that were no good; the plan then
    is cut behind each stage that asks one, so that it asks once.
    """

    config: Config = field(default_factory=dict)
    recogniser: RecogniserFactory | None = None
    truth: DataFrame | None = None
    model: TextModelFactory | None = None
    counters: Counters | None = None
    details: str | None = None

    def __post_init__(self) -> None:
        self.config = deep_merge(DEFAULTS, with_own_names(self.config))

    def describe(self) -> list[tuple[str, bool]]:
        """The stages and whether each is on."""
        c = self.config
        return [
            ("merge incomplete segments", bool(c["segment_merging"].get("enable"))),
            ("split long segments", bool(c["segment_splitting"].get("enable"))),
            ("filter invented text", True),
            ("realign timing", bool(c["timing_realignment"].get("enable")) and self.recogniser is not None),
            ("polish texts", bool(c["text_polishing"].get("enable"))),
            ("final cleanup", bool(c["final_cleanup"].get("enable", True))),
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        return self._transformed(df)

    def _transformed(self, df: DataFrame, keep_words: bool = True) -> DataFrame:
        on, watch = dict(self.describe()), self.counters.watch if self.counters else unwatched
        out = watch("input", as_segments(df))
        if on["merge incomplete segments"]:
            out = watch("merge", self._merged(out))
        out = watch("split", self._split(out, keep_words) if on["split long segments"] else split.bypass_split(out))
        out = filters.filter_invented(out, self.config["hallucination_filter"], self.recogniser, self.truth, watch)
        if on["realign timing"]:
            out = watch("realign", align.realign_timing(out, self.config["timing_realignment"], self.recogniser, self.truth))
        if on["polish texts"]:
            out = watch("polish", self._polished(out))
        return cleanup.final_cleanup(out, self.config["final_cleanup"], watch) if on["final cleanup"] else out

    def cues(self, df: DataFrame) -> DataFrame:
        """Cues only ask whether a segment has words; where no stage behind the splitter reads any, they are cut down to that there."""
        own, on = self.config["segment_splitting"], dict(self.describe())
        read = self.recogniser is not None or self.counters is not None or on["polish texts"] or own.get("enable_llm")
        return vtt_cues(self._transformed(df, bool(read)))

    def _merged(self, df: DataFrame) -> DataFrame:
        own = self.config["segment_merging"]
        return merge.merge_incomplete_segments(df, tuple(own["incomplete_markers"]), own["max_merge_gap"], self.config["segment_splitting"]["max_line_length"])

    def _split(self, df: DataFrame, keep_words: bool = True) -> DataFrame:
        own = self.config["segment_splitting"]
        most, rate = own["max_line_length"], self.config["hallucination_filter"]["timing_validation"].get("max_chars_per_second", 20)
        out = split.split_segments(df, most, tuple(own["primary_breaks"]), tuple(own["secondary_breaks"]), keep_words=keep_words)
        if own.get("enable_llm") and (model := self.model or text_model(stage_llm(self.config, "segment_splitting"))):
            out = polish.split_with_model(out, model, most, rate, stage_llm(self.config, "segment_splitting"), bool(self.details))
            out = set_aside(out, self.details) if self.details else out
        if own.get("enable_revalidate") and self.recogniser is not None:
            out = filters.revalidate_segments(out, self.recogniser, self.truth, rate)
        return out

    def _polished(self, df: DataFrame) -> DataFrame:
        llm = stage_llm(self.config, "text_polishing")
        model = self.model or text_model(llm)
        if model is None:
            return df
        out = polish.polish_segments(df, model, self.config["text_polishing"].get("batch_size", 10), llm).drop("error")
        return set_aside(out, self.details) if self.details else out.drop("details")
