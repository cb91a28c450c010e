"""What is plugged in from outside: recognisers of speech and models of text, and deterministic stand-ins."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate
from typing import Any, Protocol

import pandas as pd

#: Parameters of strict recognition, against invented text.
STRICT: dict[str, Any] = {"temperature": 0.0, "compression_ratio_threshold": 2.0, "logprob_threshold": -0.8, "no_speech_threshold": 0.4, "condition_on_previous_text": False, "initial_prompt": None}


class Recogniser(Protocol):
    """Times in the result are relative to ``start``."""

    def transcribe(self, media_id: str, start: float, end: float, word_timestamps: bool, params: dict[str, Any]) -> dict[str, Any]:
        """{"text": str, "segments": [{"start", "end", "text", "words": [{"word", "start", "end"}]}]}"""


#: Makes a recogniser on an executor; gets words (start, end, word) of the truth table, those near a segment at least, or None.
RecogniserFactory = Callable[[Sequence[tuple[float, float, str]] | None], Recogniser]


class TextModel(Protocol):
    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str: ...


#: Makes a model on an executor, once a task.
TextModelFactory = Callable[[], TextModel]


def recognition_params(config: dict, device: str = "cpu", **over: Any) -> dict[str, Any]:
    """The recogniser's parameters from its config; half precision on a GPU only; ``over`` wins."""
    names = ("language", "beam_size", "best_of", "patience", "compression_ratio_threshold", "logprob_threshold", "no_speech_threshold", "initial_prompt", "condition_on_previous_text")
    return {n: config[n] for n in names if n in config} | {"fp16": device == "cuda"} | over


class TableRecogniser:
    """Hears the words of a table (word, start, end) that a slice of time overlaps.

    Words that follow each other within ``pause`` seconds form a segment. ``rows``: tuples (start, end, word), or a
    frame with these columns.
    """

    def __init__(self, rows: pd.DataFrame | Sequence[tuple[float, float, str]] | None, pause: float = 0.5) -> None:
        self.pause = pause
        if isinstance(rows, pd.DataFrame):
            rows = list(zip(rows["start"], rows["end"], rows["word"], strict=True))
        self.words = sorted(rows or [])
        self.starts = [w[0] for w in self.words]
        self.reach = list(accumulate((w[1] for w in self.words), max))  # the latest end up to each word

    def transcribe(self, media_id: str, start: float, end: float, word_timestamps: bool = True, params: dict[str, Any] | None = None) -> dict[str, Any]:
        segments: list[dict[str, Any]] = []
        for a, b, word in self.words[bisect_right(self.reach, start) : bisect_left(self.starts, end)]:
            if b <= start:
                continue
            one = {"word": word, "start": max(a, start) - start, "end": min(b, end) - start}
            if not segments or one["start"] - segments[-1]["end"] > self.pause:
                segments.append({"start": one["start"], "end": one["end"], "text": "", "words": []})
            segments[-1]["text"] += word
            segments[-1]["end"] = one["end"]
            if word_timestamps:
                segments[-1]["words"].append(one)
        return {"text": "".join(s["text"] for s in segments), "segments": segments}


class StubTextModel:
    """Applies a function to the numbered lines of a prompt and answers with the JSON that is asked for."""

    def __init__(self, change: Callable[[str], str] = str.upper, key: str = "polished") -> None:
        self.change, self.key = change, key

    def generate(self, prompt: str, max_tokens: int = 0, temperature: float = 0.0) -> str:
        import json
        import re

        lines = re.findall(r"(?m)^\d+\. (.*)$", prompt)
        return json.dumps({self.key: [self.change(x) for x in lines]}, ensure_ascii=False)


def text_model(llm: dict) -> TextModelFactory | None:
    """A factory for the provider that the settings name; None if there is none or its library is missing."""
    provider = llm.get("provider", "none")
    if provider == "anthropic":
        return _hosted("anthropic", lambda lib: _Anthropic(lib, llm))
    if provider == "openai":
        return _hosted("openai", lambda lib: _OpenAI(lib, llm))
    if provider == "ollama":
        return lambda: _LocalServer(llm)
    return None


def _hosted(library: str, make: Callable[[Any], TextModel]) -> TextModelFactory | None:
    import importlib.util

    if importlib.util.find_spec(library) is None:
        return None

    def build() -> TextModel:
        return make(__import__(library))

    return build


class _Anthropic:
    def __init__(self, lib: Any, llm: dict) -> None:
        own = llm.get("anthropic", {})
        self.client, self.model = lib.Anthropic(api_key=own.get("api_key"), timeout=llm.get("timeout", 45)), own.get("model")

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str:
        answer = self.client.messages.create(model=self.model, max_tokens=max_tokens or 4096, temperature=temperature, messages=[{"role": "user", "content": prompt}])
        return answer.content[0].text


class _OpenAI:
    def __init__(self, lib: Any, llm: dict) -> None:
        own = llm.get("openai", {})
        self.client, self.model = lib.OpenAI(api_key=own.get("api_key"), timeout=llm.get("timeout", 45)), own.get("model")

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str:
        answer = self.client.chat.completions.create(model=self.model, max_tokens=max_tokens or None, temperature=temperature, messages=[{"role": "user", "content": prompt}])
        return answer.choices[0].message.content


class _LocalServer:
    """A model server on the executor's side that speaks JSON over HTTP; starting one is not our business."""

    def __init__(self, llm: dict) -> None:
        own = llm.get("ollama", {})
        self.url, self.model, self.timeout = own.get("base_url", "http://localhost:11434"), own.get("model"), llm.get("timeout", 45)

    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str:
        import json
        import urllib.request

        options = {"temperature": temperature} | ({"num_predict": max_tokens} if max_tokens else {})
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": options}).encode()
        request = urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())["response"]
