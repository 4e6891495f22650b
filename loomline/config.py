"""Settings of a deployment: defaults, over them a file's, over those the environment's; checked when they are made."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from loomline.operators.recall import PERSONAS


@dataclass(frozen=True)
class Settings:
    """What operators take as parameters, in one place."""

    persona: str = "default"
    read_only_agents: tuple[str, ...] = ()
    multi_tenant: bool = True
    batch_name: str = "nightly"
    synced_agents: tuple[str, ...] = ()
    max_results: int = 5
    dedup_cosine: float = 0.80
    dedup_overlap: float = 0.55
    lens_limit: int = 60
    data_dir: str = "data"

    def __post_init__(self) -> None:
        if self.persona not in PERSONAS:
            raise ValueError(f"unknown persona {self.persona!r}, there are {', '.join(PERSONAS)}")
        for name in ("dedup_cosine", "dedup_overlap"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.max_results < 1 or self.lens_limit < 1:
            raise ValueError("limits must be at least 1")
        if ".." in self.data_dir.split("/"):
            raise ValueError("data_dir must not climb out of its folder")

    @property
    def thresholds(self) -> tuple[float, float]:
        """Least cosines of the first and the second cached tier."""
        return PERSONAS[self.persona]


def _typed(kind: str, value: object) -> object:
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(value)
    if kind == "bool":
        return str(value).strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](value)


def load(file: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, prefix: str = "LOOMLINE_") -> Settings:
    """Settings of a file's mapping and of variables like LOOMLINE_MAX_RESULTS; unknown names in the file are an error."""
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    if unknown := set(file or {}) - set(kinds):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    env = os.environ if env is None else env
    given = dict(file or {}) | {name: env[prefix + name.upper()] for name in kinds if prefix + name.upper() in env}
    return replace(Settings(), **{name: _typed(kinds[name], value) for name, value in given.items()})
