"""Names, paths and follow-up questions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FOLLOW_UP, lines, strip

# Fixed values of file names.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
EXTENSIONS = r"(?i)\.(md|markdown|txt|pdf|html?|docx?)$"
ENDS = "？?！!。."


def title(text: Column) -> Column:
    """What follows ``# `` on the first line that starts so, without white space at its ends; null if none does."""
    return strip(F.get(F.filter(lines(text), lambda x: x.startswith("# ")), 0).substr(F.lit(3), F.lit(1 << 30)))


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def canonical(text: Column) -> Column:
    """Line feeds for other line ends, no white space at the ends; white space inside stays."""
    return strip(F.regexp_replace(text, r"\r\n?", "\n"))


def label(text: Column) -> Column:
    """A node's name without brackets, quotes and marks, at most 60 characters."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\[\](){}<>\"`|#]", "·"), r"(?U)\s+", " ")
    short = F.substring(strip(clean), 1, 60)
    return F.when(F.length(short) > 0, short).otherwise("未命名")


def file_name(text: Column, fallback: Column) -> Column:
    """A name that file systems take, at most 80 characters; reserved names get a prefix, an empty one is ``fallback``."""
    name = F.substring(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", ""), 1, 80)
    return F.when(F.length(name) == 0, fallback).when(F.upper(name).isin(*RESERVED), F.concat(F.lit("收藏-"), name)).otherwise(name)


def same_title(a: Column, b: Column) -> Column:
    """Whether two titles agree but for a known extension."""
    bare = lambda x: strip(F.regexp_replace(x, EXTENSIONS, ""))
    return bare(a) == bare(b)


def tags(values: Column, most_chars: int = 24) -> Column:
    """Distinct tags in order: white space collapses, long ones are cut, empty ones go."""
    clean = F.transform(values, lambda x: F.substring(strip(F.regexp_replace(x, r"(?U)\s+", " ")), 1, most_chars))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x) > 0))


def follows_up(question: Column) -> Column:
    """Whether a question leans on the one before it."""
    return F.regexp_replace(question, f"[{ENDS}]+$", "").rlike(FOLLOW_UP)


def safe_member(path: Column, files: tuple[str, ...] = (), folders: tuple[str, ...] = ()) -> Column:
    """Whether an archive member's path stays inside and is a legal name everywhere, and, where ``files`` or ``folders`` are given,
    is one of those files or lies below one of those folders."""
    reserved = "(?i)^(CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])(\\.|$)"
    bad = lambda p: (F.length(p) == 0) | p.isin(".", "..") | p.rlike(r"[ .]$") | p.rlike(r'[\x00-\x1f<>"|?*]') | p.rlike(reserved)
    parts = F.split(path, "/")
    fine = (F.length(path) > 0) & ~path.rlike(r"[\\:\x00]") & F.forall(parts, lambda p: ~bad(p))
    if not files and not folders:
        return fine
    return fine & (path.isin(*files) | ((F.size(parts) > 1) & F.get(parts, 0).isin(*folders)))
