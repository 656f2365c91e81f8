"""Options, and their layers: a YAML file, then the environment (Section__Key), then the command line; later ones win."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from .yaml import read_yaml

#: Fixed value: the default system prompt's placeholder.
LANGUAGE_MARK = "{{ target_language }}"


@dataclass(frozen=True)
class ModelOptions:
    base_url: str = "https://api.openai.com/"
    model: str = "gpt-4o-mini"
    max_output_tokens: int = 4000
    temperature: float = 0.0
    system_prompt: str = f"Translate the user's text into {LANGUAGE_MARK}. Return only the translation."

    def key(self) -> str:
        return f"Model={self.model}, Tokens={self.max_output_tokens}, Temp={self.temperature:g}, BaseUrl={self.base_url}, Prompt={self.system_prompt}"


@dataclass(frozen=True)
class TranslationOptions:
    input_path: str = ""
    output_format: str = "pdf"
    target_language: str = ""
    output_folder: str = ""
    max_chars_per_chunk: int = 10_000
    max_degree_of_parallelism: int = 8
    checkpoint_dir: str = "checkpoints"
    resume: bool = True
    max_attempts_per_chunk: int = 3
    #: Accepted, without effect.
    quarantine_after_attempts: int = 3
    min_output_to_input_ratio: float = 0.30
    min_output_chars: int = 40

    def key(self) -> str:
        return f"Input={re.split(r'[/\\\\]', self.input_path)[-1]}, Target={self.target_language}, Format={self.output_format}, Chunk={self.max_chars_per_chunk}, Parallel={self.max_degree_of_parallelism}, Resume={self.resume}"


@dataclass(frozen=True)
class Margins:
    top: float = 72
    bottom: float = 72
    left: float = 80
    right: float = 80


@dataclass(frozen=True)
class FontOptions:
    page_size: str = "A4"
    regular_font_style: str = ""
    bold_font_style: str = ""
    #: Accepted, without effect.
    italic_font_style: str = ""
    code_font_style: str = ""
    font_size: float = 12.5
    leading_multiplier: float = 1.2
    first_line_indent: float = 20
    space_before: float = 0
    space_after: float = 0
    margins: Margins = field(default_factory=Margins)


@dataclass(frozen=True)
class TestingOptions:
    test_chunks: tuple[int, ...] = ()

    def key(self) -> str:
        return f"TestChunks=[{','.join(map(str, self.test_chunks))}]"


@dataclass(frozen=True)
class Options:
    openai: ModelOptions = field(default_factory=ModelOptions)
    translation: TranslationOptions = field(default_factory=TranslationOptions)
    font: FontOptions = field(default_factory=FontOptions)
    testing: TestingOptions = field(default_factory=TestingOptions)


def _flat(d: dict | list, prefix: str = "") -> dict[str, object]:
    """Keys like section:name, and section:name:0 for items of lists."""
    out: dict[str, object] = {}
    for k, v in d.items() if isinstance(d, dict) else enumerate(d):
        out |= _flat(v, f"{prefix}{k}:") if isinstance(v, (dict, list)) else {f"{prefix}{k}".lower(): v}
    return out


def _typed(cls, given: dict[str, object], section: str):
    values = {}
    for f in fields(cls):
        key = f"{section}:{f.name.replace('_', '')}"
        if f.name == "margins":
            values[f.name] = _typed(Margins, given, f"{section}:margins")
        elif f.name == "test_chunks":
            items = {int(k.rpartition(":")[2]): v for k, v in given.items() if re.fullmatch(rf"{key}:\d+", k)}
            values[f.name] = tuple(int(items[i]) for i in sorted(items))
        elif given.get(key) is not None:
            kind = type(f.default)
            values[f.name] = str(given[key]).lower() == "true" if kind is bool else kind(given[key])
    return cls(**values)


def load(path: str | Path, env: dict[str, str] | None = None, args: list[str] = ()) -> Options:
    """The file must exist. Arguments: --Section:Key=value or --Section:Key value."""
    given = _flat(read_yaml(Path(path).read_text(encoding="utf-8")))
    given |= {k.replace("__", ":").lower(): v for k, v in (os.environ if env is None else env).items() if "__" in k}
    words = list(args)
    while words:
        word = words.pop(0)
        if m := re.fullmatch(r"(?:--|/)([^=]+)(?:=(.*))?", word, re.S):
            given[m[1].lower()] = m[2] if m[2] is not None else (words.pop(0) if words else "")
    return Options(*(_typed(c, given, s) for c, s in ((ModelOptions, "openai"), (TranslationOptions, "translation"), (FontOptions, "font"), (TestingOptions, "testing"))))
