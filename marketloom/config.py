"""Settings of a run, from the environment."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

_HIDDEN = ("token", "secret", "key")


@dataclass(frozen=True)
class Settings:
    """Paths and limits; each is read from MARKETLOOM_<NAME> if that is set."""

    sheets_path: str = ""
    workbook_path: str = ""
    links_path: str = ""
    pages_path: str = ""
    catalogue_path: str = ""
    cache_path: str = ""
    output_path: str = ""
    batch_rows: int = 10
    notify_token: str = ""
    notify_chat: str = ""

    @staticmethod
    def load() -> Settings:
        given = {f.name: os.environ.get(f"MARKETLOOM_{f.name.upper()}") for f in fields(Settings)}
        return Settings(**{k: int(v) if k == "batch_rows" else v for k, v in given.items() if v is not None})

    def shown(self) -> dict:
        """All settings, secrets masked."""
        mask = lambda v: "" if not v else ("****" if len(v) <= 8 else f"{v[:4]}****{v[-4:]}")
        return {k: mask(v) if any(h in k for h in _HIDDEN) else v for k, v in asdict(self).items()}
