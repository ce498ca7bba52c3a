"""Text expressions: folding, n-grams, regular-expression dialect, formats, URIs; and the query tokeniser."""

from __future__ import annotations

import re
import warnings

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlens.functions.dialect import RegexError, java_regex

MAX_TERMS = 64


# --- case folding


def fold(col) -> Column:
    """Per-character lower case.

    For ASCII plain ``lower`` gives the same and stays in generated code; elsewhere each character is folded by
    itself, so a final sigma stays what a medial one becomes.
    """
    c = F.col(col) if isinstance(col, str) else col
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.lower(x)), "")
    return F.when(is_ascii(c), F.lower(c)).otherwise(each)


def fold_text(text: str) -> str:
    """fold() of a literal, on the driver."""
    return "".join(ch.lower() for ch in text)


def fold_bytes(raw: bytes) -> bytes:
    """fold() of a name that need not be UTF-8: stray bytes stay as they are."""
    return fold_text(raw.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def is_ascii(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.octet_length(c) == F.char_length(c)


def display(raw) -> Column:
    """Bytes as text for people: what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.col(raw).cast("string") if isinstance(raw, str) else raw.cast("string"))


def ngrams(col, n: int = 3) -> Column:
    """Distinct windows of n bytes, as binary values; none for shorter names."""
    c = F.encode(F.col(col) if isinstance(col, str) else col, "utf-8")
    size = F.octet_length(c)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<binary>"))


def literal_ngrams(text: str, n: int = 3) -> list[bytes]:
    raw = text.encode("utf-8")
    return list(dict.fromkeys(raw[i : i + n] for i in range(len(raw) - n + 1)))


# --- queries


def split_terms(query: str) -> list[str]:
    """Words at white space; double quotes group, an open one runs to the end; empty words go."""
    words, now, quoted = [], [], False
    for ch in query:
        if ch == '"':
            quoted = not quoted
        elif ch.isspace() and not quoted:
            words.append("".join(now))
            now = []
        else:
            now.append(ch)
    words.append("".join(now))
    return [w for w in words if w]


def bounded_terms(terms: list[str]) -> list[str]:
    if len(terms) > MAX_TERMS:
        warnings.warn(f"only the first {MAX_TERMS} of {len(terms)} words count", stacklevel=3)
    return terms[:MAX_TERMS]


def checked_regex(spark, pattern: str, match_case: bool = False) -> str:
    """java_regex, refused at once and in one line where Java can't compile it."""
    made = java_regex(pattern, match_case)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(made)
    except (Py4JJavaError, PySparkException) as e:
        raise RegexError(str(e).strip().splitlines()[0]) from None
    return made


# --- paths


def parent_dir(path) -> Column:
    """The folder of a path; ``/`` for top-level paths and those without a slash."""
    p = F.col(path) if isinstance(path, str) else path
    found = F.regexp_extract(p, r"(?s)^(.+)/[^/]*\z", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def base_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path) -> Column:
    """What follows the last dot of the path, in lower case; the whole path without a dot."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.element_at(F.split(p, r"\."), -1))


def is_within(path, folder) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    d = F.lit(folder) if isinstance(folder, str) else folder
    return (d == "/") | (p == d) | F.startswith(p, F.concat(d, F.lit("/")))


def within(path: str, folder: str) -> bool:
    return folder == "/" or path == folder or path.startswith(folder + "/")


def normalise_path(path: str) -> str:
    """An absolute path without empty and ``.`` parts; ``..`` and line breaks are refused."""
    if not path.startswith("/"):
        raise ValueError("not an absolute path")
    if "\n" in path or "\r" in path:
        raise ValueError("a path may not hold a line break")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError("a path may not hold ..")
    return "/" + "/".join(parts)


def normalised(path) -> Column:
    """normalise_path as an expression; refused paths raise."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    bad = ~F.startswith(p, F.lit("/")) | F.array_contains(parts, "..") | F.contains(p, F.lit("\n")) | F.contains(p, F.lit("\r"))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a clean absolute path: "), p))).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def ancestors(path) -> Column:
    """All proper ancestors, the root ``/`` first."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.size(parts)
    deeper = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("/")), deeper))


# --- presentation

#: Icon names by the extension's group.
ICONS = {
    "text-x-generic": "txt md log rst",
    "application-pdf": "pdf",
    "image-x-generic": "png jpg jpeg gif webp svg",
    "video-x-generic": "mp4 mkv webm avi mov",
    "audio-x-generic": "mp3 flac ogg wav opus",
    "package-x-generic": "zip gz xz bz2 tar 7z rar",
    "text-x-script": "rs c h cpp py sh js ts go",
}


def icon(path) -> Column:
    """By what follows the path's last dot; generic text for everything else."""
    ext = extension(path)
    out = F.when(F.lit(False), "")
    for name, group in ICONS.items():
        out = out.when(ext.isin(*group.split()), F.lit(name))
    return out.otherwise(F.lit("text-x-generic"))


def relevance(name, query: str, unicode: bool = False) -> Column:
    """1.0 for the name itself, 0.9 for its beginning, 0.7 for a part of it, else 0.4; ASCII case is ignored."""
    n = F.col(name) if isinstance(name, str) else name
    if unicode:
        n, q = fold(n), F.lit(fold_text(query))
    else:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        n, q = F.translate(n, upper, lower), F.lit(query.translate(str.maketrans(upper, lower)))
    return F.when(n == q, F.lit(1.0)).when(F.startswith(n, q), F.lit(0.9)).when(F.contains(n, q), F.lit(0.7)).otherwise(F.lit(0.4))


def result_type(score) -> Column:
    """100 where the query is or begins the name, else 30."""
    return F.when(F.col(score) >= 0.9, F.lit(100)).otherwise(F.lit(30))


def format_size(size) -> Column:
    """Bytes with 1024 as base, one decimal above B; ``?`` where unknown."""
    s = F.col(size) if isinstance(size, str) else size
    out = F.when(s.isNull(), F.lit("?")).when(s < 1024, F.concat(s.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(s < 1024 ** (k + 1), F.concat(F.format_string("%.1f", F.bround(s / float(1024**k), 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(s / float(1024**4), 1)), F.lit(" TB")))


def format_time(ts) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("?"))


def group_digits(n) -> Column:
    return F.format_number(n, 0)


def one_line(path) -> Column:
    """Line breaks as U+23CE."""
    return F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\n"), F.lit("⏎"))


def substitute(template: str, path) -> Column:
    """The template with each ``{}`` replaced by the path."""
    return F.replace(F.lit(template), F.lit("{}"), F.col(path) if isinstance(path, str) else path)


# --- file URIs

_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/-._~"


def file_uri(path) -> Column:
    """file:// and the path's bytes, escaped but for letters, digits and ``/-._~``."""
    p = F.col(path) if isinstance(path, str) else path
    raw = F.encode(p, "utf-8")
    one = lambda i: F.substring(raw, i, F.lit(1))
    escaped = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.when(F.hex(one(i)).isin(*[f"{ord(c):02X}" for c in _PLAIN]), F.decode(one(i), "utf-8")).otherwise(F.concat(F.lit("%"), F.hex(one(i)))))
    return F.when(p == "", F.lit("file://")).otherwise(F.concat(F.lit("file://"), F.array_join(escaped, "")))


_URI = re.compile(rb"file://(/(?:[^%]|%[0-9A-Fa-f]{2})*)", re.S)


def path_from_uri(uri: str | None) -> bytes | None:
    """The path's bytes; None unless the URI is file://, absolute and well escaped."""
    m = _URI.fullmatch(uri.encode("utf-8")) if uri else None
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1]) if m else None


def uri_path(uri) -> Column:
    """path_from_uri over Arrow batches."""
    @F.pandas_udf("binary")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(path_from_uri)

    return decode(uri)
