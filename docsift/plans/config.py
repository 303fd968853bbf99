"""Settings, from defaults, a .env file and the environment, in this order of precedence from low to high."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

TRUE = ("1", "true", "yes", "on")


def load_dotenv(path: str | Path) -> None:
    """Sets what a file of NAME=value lines names, unless the environment has it already."""
    file = Path(path)
    if not file.exists():
        return
    for line in file.read_text(encoding="utf-8").splitlines():
        name, sign, value = line.strip().partition("=")
        if sign and name.strip() and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    llm_api_key: str = field(default="", repr=False)
    llm_base_url: str = "https://api.openai.com/v1"
    llm_model: str = "gpt-4o-mini"
    embedding_api_key: str = field(default="", repr=False)
    embedding_base_url: str = ""
    embedding_model: str = ""
    local_embedding_model: str = ""
    embedding_device: str = ""
    hf_local_files_only: bool = False
    use_flagembedding: bool = False
    flagembedding_repo_path: str = ""
    reranker_api_key: str = field(default="", repr=False)
    reranker_base_url: str = ""
    reranker_model: str = ""
    reranker_path: str = "/rerank"
    local_reranker_model: str = ""
    reranker_device: str = ""
    reranker_weight: float = 0.25
    enable_query_enhancement: bool = False
    query_enhancement_mode: str = "rewrite"
    enable_llm_verifier: bool = False

    @property
    def chunks_path(self) -> str:
        return f"{self.data_dir}/chunks"

    @property
    def index_path(self) -> str:
        return f"{self.data_dir}/index"

    @property
    def vectors_path(self) -> str:
        return f"{self.data_dir}/vectors"

    @property
    def summary_log(self) -> str:
        return f"{self.data_dir}/summaries"

    @property
    def manifest_path(self) -> str:
        return f"{self.data_dir}/manifest"


def get_settings(dotenv: str | Path | None = None, **overrides) -> Settings:
    """Each field from the environment variable of its name in capitals; overrides win."""
    if dotenv is not None:
        load_dotenv(dotenv)
    values = {}
    for f in fields(Settings):
        raw = os.environ.get(f.name.upper())
        if raw is not None:
            values[f.name] = raw.strip().lower() in TRUE if f.type == "bool" else float(raw) if f.type == "float" else raw.strip()
    values |= overrides
    base = values.get("llm_base_url", Settings.llm_base_url)
    for name in ("embedding_base_url", "reranker_base_url"):
        values[name] = values.get(name) or base
    return Settings(**values)
