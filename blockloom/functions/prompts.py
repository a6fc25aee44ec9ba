"""Prompts by language and key, as an immutable registry; a key that a language lacks falls back to English."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import fill

_ASK = 'Answer in JSON: {{"detailed_description": "...", "entity_info": {{"entity_name": "...", "entity_type": "{kind}", "summary": "..."}}}}'
_GIVEN = {"image": "Image: {image_path}\nCaptions: {captions}\nFootnotes: {footnotes}", "table": "Table: {table_body}\nImage: {image_path}\nCaptions: {captions}\nFootnotes: {footnotes}", "equation": "Equation: {text}\nFormat: {text_format}", "generic": "Content of type {type}: {extra}"}
_AIM = {"image": "Describe what the image shows: its parts, their places, colours, texts and purpose.", "table": "Explain the table: its structure, its figures, trends and outliers.", "equation": "Explain the equation: its meaning, its symbols, where it holds and what it is for.", "generic": "Explain the content: its structure, its facts and how they relate."}
_ZH = {"image": "请描述图像：组成、位置、颜色、文字和用途。", "table": "请说明表格：结构、数据、趋势和异常。", "equation": "请说明公式：含义、符号、适用条件和用途。", "generic": "请说明内容：结构、要点及其关系。"}


def _set(aims: dict[str, str], context: str) -> dict[str, str]:
    out = {}
    for kind, aim in aims.items():
        out[kind] = f"{aim}\n{_GIVEN[kind]}\n{_ASK.replace('{kind}', kind)}"
        out[f"{kind}_with_context"] = f"{aim}\n{context}: {{context}}\n{_GIVEN[kind]}\n{_ASK.replace('{kind}', kind)}"
        out[f"{kind}_system"] = f"You analyse content of type {kind}."
    return out


@dataclass(frozen=True)
class Prompts:
    languages: dict[str, dict[str, str]] = field(default_factory=lambda: {"en": _set(_AIM, "It stands among this"), "zh": _set(_ZH, "上下文")})
    language: str = "en"

    @staticmethod
    def name(language: str) -> str:
        return language.strip().lower().replace("_", "-").split("-")[0]

    def use(self, language: str) -> Prompts:
        if (key := self.name(language)) not in self.languages:
            raise ValueError(f"no prompts in {key}; there are {', '.join(self.available())}")
        return Prompts(self.languages, key)

    def register(self, language: str, prompts: dict[str, str]) -> Prompts:
        key = self.name(language)
        return Prompts({**self.languages, key: {**self.languages.get(key, {}), **prompts}}, self.language)

    def available(self) -> list[str]:
        return sorted(self.languages)

    def get(self, key: str) -> str:
        return self.languages[self.language].get(key) or self.languages["en"][key]

    def table(self, spark: SparkSession) -> DataFrame:
        """language, key, template with the fallback in place."""
        keys = sorted({k for p in self.languages.values() for k in p})
        return spark.createDataFrame([(lang, k, self.use(lang).get(k)) for lang in self.available() for k in keys], "language string, key string, template string")

    def column(self, kind: str, context: Column | None = None) -> Column:
        """The prompt for blocks of a kind, from their columns."""
        from .text import or_none

        some = dict(image_path=F.col("img_path"), captions=or_none("captions"), footnotes=or_none("footnotes"), table_body=F.col("table_body"), text=F.col("text"), text_format=F.col("text_format"), type=F.col("type"), extra=F.coalesce(F.col("extra"), F.col("text")))
        plain = fill(self.get(kind), **some)
        if context is None:
            return plain
        return F.when(F.coalesce(context, F.lit("")) == "", plain).otherwise(fill(self.get(f"{kind}_with_context"), context=context, **some))

    def for_blocks(self, context: Column | None = None) -> Column:
        out = F.when(F.col("type") == "image", self.column("image", context))
        for kind in ("table", "equation"):
            out = out.when(F.col("type") == kind, self.column(kind, context))
        return out.otherwise(self.column("generic", context))
