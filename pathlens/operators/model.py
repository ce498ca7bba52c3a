"""The data model: entries, search options, limits."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

ENTRIES = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("parent_id", T.LongType()),  # null for roots
        T.StructField("name", T.StringType()),  # a root's name is its whole path
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("alive", T.BooleanType()),
    ]
)
DEFAULT_LIMIT, EXEC_LIMIT, HARD_CAP, PAGE_DEFAULT, PAGE_RANGE, LAUNCHER_LIMIT, LAUNCHER_BYTES = 100, 100_000, 100_000, 500, (100, 20_000), 30, 3
KINDS = ("all", "files", "folders")


@dataclass(frozen=True)
class SearchOptions:
    match_case: bool = False
    regex: bool = False
    in_path: bool = False
    kind: str = "all"
    hide_hidden: bool = False

    def to_flags(self) -> str:
        on = [("c", self.match_case), ("r", self.regex), ("p", self.in_path), ("f", self.kind == "files"), ("d", self.kind == "folders"), ("h", self.hide_hidden)]
        return "".join(f for f, x in on if x) or "-"

    @classmethod
    def from_flags(cls, flags: str) -> SearchOptions:
        """Unknown letters are ignored; of f and d the later one counts."""
        known = {"c": {"match_case": True}, "r": {"regex": True}, "p": {"in_path": True}, "f": {"kind": "files"}, "d": {"kind": "folders"}, "h": {"hide_hidden": True}}
        out = cls()
        for f in flags:
            out = replace(out, **known.get(f, {}))
        return out

    def badges(self) -> str:
        names = [("match case", self.match_case), ("regex", self.regex), ("path", self.in_path), (f"{self.kind} only", self.kind != "all"), ("no hidden", self.hide_hidden)]
        return " · ".join(n for n, on in names if on)


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT) -> int:
    return default if limit is None else max(0, min(limit, HARD_CAP))


def page_size(asked: int | None) -> int:
    return PAGE_DEFAULT if asked is None else max(PAGE_RANGE[0], min(asked, PAGE_RANGE[1]))
