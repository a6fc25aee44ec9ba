"""Settings of the engine; frozen, so that a plan never changes under its readers."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import SparkSession

IMAGE, OFFICE, TEXT, PDF, HTML = (".png", ".jpeg", ".jpg", ".bmp", ".tiff", ".tif", ".gif", ".webp"), (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"), (".txt", ".md"), (".pdf",), (".html", ".htm", ".xhtml")


@dataclass(frozen=True)
class Config:
    parser: str = "mineru"
    parse_method: str = "auto"
    enable_image: bool = True
    enable_table: bool = True
    enable_equation: bool = True
    max_concurrent_files: int = 1
    recursive: bool = True
    supported_extensions: tuple[str, ...] = PDF + IMAGE + OFFICE + TEXT
    context_window: int = 1
    context_mode: str = "page"
    max_context_tokens: int = 2000
    include_headers: bool = True
    include_captions: bool = True
    context_filter_types: tuple[str, ...] = ("text",)
    content_format: str = "minerU"
    use_full_path: bool = False
    cosine_threshold: float = 0.2
    top_k: int = 60
    chunk_size: int = 1200
    chunk_overlap: int = 100

    def with_(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        """Settings from spark.blockloom.<name>, defaults else."""
        found = {}
        for f in dataclasses.fields(cls):
            v = spark.conf.get(f"spark.blockloom.{f.name}", None)
            if v is not None:
                kind = type(f.default)
                found[f.name] = v.lower() == "true" if kind is bool else tuple(x.strip() for x in v.split(",")) if kind is tuple else kind(v)
        return cls(**found)

    def enabled_types(self) -> tuple[str, ...]:
        return tuple(t for t, on in (("image", self.enable_image), ("table", self.enable_table), ("equation", self.enable_equation)) if on) + ("generic",)

    def info(self) -> dict:
        """What a caller sees of the settings."""
        return dataclasses.asdict(self)
