"""The settings file: ``key = value`` lines, repeatable keys, comments."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, field

from pathlens.functions import text

MAX_BYTES = 64 * 1024


class ConfigError(ValueError):
    """Names the line, never what stands in it."""


@dataclass
class Config:
    roots: list[str] = field(default_factory=lambda: ["/"])
    exclude: list[str] = field(default_factory=list)
    rescan: list[str] = field(default_factory=list)
    rescan_interval: int = 900

    @classmethod
    def parse(cls, content: str) -> Config:
        out = cls(roots=[])
        lists = {"root": out.roots, "exclude": out.exclude, "rescan": out.rescan}
        for n, line in enumerate(content.splitlines(), 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            key, equals, value = (x.strip() for x in line.partition("="))
            if not equals:
                raise ConfigError(f"line {n}: expected `key = value`")
            if key in lists:
                lists[key].append(value)
            elif key == "rescan_interval":
                if not value.isascii() or not value.isdigit():
                    raise ConfigError(f"line {n}: rescan_interval must be whole seconds")
                out.rescan_interval = int(value)
            else:
                raise ConfigError(f"line {n}: unknown setting")
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, "rb") as f:
            raw = f.read(MAX_BYTES + 1)
        if len(raw) > MAX_BYTES:
            raise ConfigError("the file is too large")
        try:
            return cls.parse(raw.decode())
        except UnicodeDecodeError:
            raise ConfigError("the file is not UTF-8") from None

    def to_text(self) -> str:
        rows = [("root", r) for r in self.roots] + [("exclude", e) for e in self.exclude] + [("rescan", r) for r in self.rescan]
        return "".join(f"{k} = {v}\n" for k, v in [*rows, ("rescan_interval", self.rescan_interval)])

    def checked(self) -> Config:
        """With clean absolute paths; anything else raises."""
        clean = lambda paths: [text.normalise_path(p) for p in paths]
        return Config(clean(self.roots), clean(self.exclude), clean(self.rescan), self.rescan_interval)

    def install(self, path: str) -> None:
        """Whole or not at all: a file beside it is renamed over it."""
        raw = self.checked().to_text().encode()
        if len(raw) > MAX_BYTES:
            raise ConfigError("the file would be too large")
        handle, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(raw)
                f.flush()
                os.fsync(f.fileno())
            os.chmod(tmp, 0o644)
            os.replace(tmp, path)
        except BaseException:
            os.unlink(tmp)
            raise
