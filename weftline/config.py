"""Frozen configuration with the engine's defaults, and a merge of overrides one nested level deep."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace


# fixed values: the defaults of all sections below


@dataclass(frozen=True)
class Crawl:
    max_depth: int = 3
    max_pages: int = 500
    max_pages_per_domain: int = 200
    delay_between_requests_sec: float = 1.5
    request_timeout_sec: int = 20
    max_retries: int = 3
    retry_backoff_sec: float = 2.0
    user_agent: str = "weftline/1.0"


@dataclass(frozen=True)
class Scope:
    internal_only: bool = True
    allow_subdomains: bool = True
    external_sites_whitelist: tuple[str, ...] = ()
    url_patterns_include: tuple[str, ...] = ()
    # fixed values: addresses that are never pages
    url_patterns_exclude: tuple[str, ...] = (
        r".*\.(css|js|woff|woff2|ttf|eot|ico|svg)$",
        r".*/login.*",
        r".*/logout.*",
        r".*/cart.*",
        r".*/account.*",
        r".*\?.*sessionid.*",
    )


@dataclass(frozen=True)
class Assets:
    download_images: bool = True
    download_pdfs: bool = True
    min_image_size_bytes: int = 5120
    max_image_size_mb: int = 20
    max_pdf_size_mb: int = 100
    image_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")


@dataclass(frozen=True)
class Extraction:
    extract_tables: bool = True
    extract_structured_data: bool = True
    min_text_length_chars: int = 100
    noise_selectors: tuple[str, ...] = (".topbar", ".footer_logos")
    skip_link_prefixes: tuple[str, ...] = ("skip", "jump to")


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 1000
    overlap: int = 150
    min_chunk_size: int = 50
    min_body_chars: int = 100


@dataclass(frozen=True)
class Retrieval:
    candidates: int = 20
    top_k: int = 5
    min_score: float = 0.3
    rrf_k: int = 2
    dimension: int = 768
    buckets: int = 100_000
    embed_batch: int = 32


@dataclass(frozen=True)
class Agent:
    # fixed values: the models' temperatures and longest answer
    temperature: float = 0.1
    grading_temperature: float = 0.0
    rewrite_temperature: float = 0.3
    max_tokens: int = 512
    generation_messages: int = 4
    min_relevant: int = 1
    max_rewrites: int = 2
    max_regenerations: int = 1
    memory_messages: int = 20
    dedup: bool = True
    language_aware: bool = False


@dataclass(frozen=True)
class Config:
    crawl: Crawl = field(default_factory=Crawl)
    scope: Scope = field(default_factory=Scope)
    assets: Assets = field(default_factory=Assets)
    extraction: Extraction = field(default_factory=Extraction)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    agent: Agent = field(default_factory=Agent)


def merged(base: Config, over: dict) -> Config:
    """base with the sections of over laid on top, key by key; unknown keys are left out, lists become tuples."""
    sections = {}
    for name, values in over.items():
        section = getattr(base, name, None)
        if is_dataclass(section) and isinstance(values, dict):
            known = {f.name for f in fields(section)}
            sections[name] = replace(section, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})
    return replace(base, **sections)


def load(path: str | None = None, base: Config | None = None) -> tuple[Config, list[str]]:
    """(configuration, seeds) of a JSON file laid over the defaults; no file gives the defaults."""
    import json

    if not path:
        return base or Config(), []
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    return merged(base or Config(), found), list(found.get("seeds", []))


def required(settings: dict, names: list[str]) -> None:
    """Raises ValueError naming every setting that is missing or empty."""
    missing = [n for n in names if not settings.get(n)]
    if missing:
        raise ValueError("missing settings: " + ", ".join(missing))


def as_dict(config: Config) -> dict:
    return asdict(config)
