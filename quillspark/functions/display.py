"""What a reader is shown: concepts asked for, citation links, places, notes, figures and errors, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fixed values of the texts shown.
BULLET = r"(?U)^\s*(?:[-*]|\d+[.)])\s+"
TERM = r"(?U)\b[A-Za-z][A-Za-z0-9-]+\b"
JOINS = r"(?:、|和|与|/|,|，|and\b)"
UNKNOWN = "未记录"
NO_FIGURE = "—"
USER_PATH = r"(?i)[a-z]:\\+Users\\+[^\"\\]+"
#: Codes of errors, by what their text holds; the rest is generation_failed.
ERRORS = (("deepseek_not_configured", "deepseek_not_configured"), ("Ollama is busy", "ollama_busy"), ("Ollama", "ollama_unavailable"))
PREVIEW, CHAT_CUT, STUDIO_CUT = 360, 9000, 12000


def separate_concepts(question: Column) -> Column:
    """Latin terms before 分别, distinct and in order; none in other questions."""
    before = F.substring_index(question, "分别", 1)
    return F.when(F.contains(question, F.lit("分别")), F.array_distinct(F.regexp_extract_all(before, F.lit(TERM), F.lit(0)))).otherwise(F.array().cast("array<string>"))


def covers_separately(answer: Column, concepts: Column) -> Column:
    """Whether every concept opens a list item of its own: an item that joins it to another concept does not count."""
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E(?![a-z0-9-])"))
    names = F.array_distinct(F.transform(concepts, F.lower))
    items = F.transform(F.filter(T.lines(answer), lambda x: x.rlike(BULLET)), lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, BULLET, ""), r"\*\*|`", "")))

    def opened(c):
        others = F.array_join(F.transform(F.filter(names, lambda o: o != c), quoted), "|")
        joined = F.concat(F.lit("^"), quoted(c), F.lit(rf"\s*{JOINS}\s*(?:"), others, F.lit(")"))
        alone = lambda x: (F.size(names) == 1) | ~F.regexp_like(x, joined)
        return F.exists(items, lambda x: F.regexp_like(x, F.concat(F.lit("^"), quoted(c))) & alone(x))

    return F.forall(names, opened)


def citation_links(text: Column, labels: Column) -> Column:
    """``[S1]`` as a link to its source where ``labels`` has S1; other brackets stay as they are."""
    known = F.concat(F.lit(r"\[("), F.array_join(labels, "|"), F.lit(r")\]"))
    return F.when(F.size(labels) > 0, F.regexp_replace(text, known, F.lit("[$0](#cite-$1)"))).otherwise(text)


def safe_url(url: Column) -> Column:
    """A link's target if it is http, https or a citation; else empty."""
    return F.when(url.startswith("#cite-") | url.rlike("(?i)^https?://"), url).otherwise("")


def place(kind: Column, page: Column, cell: Column, start: Column, end: Column, origin: Column, published: Column) -> Column:
    """Where a source is, by its kind."""
    span = F.concat(F.lit("第 "), start, F.lit("–"), end, F.lit(" 行"))
    return (
        F.when(kind == "pdf", F.concat(F.lit("第 "), page, F.lit(" 页")))
        .when(kind == "notebook", F.concat(F.lit("单元格 "), cell, F.lit(" · "), span))
        .when(kind == "memory", F.when(F.length(origin) > 0, F.concat(F.lit("来自记忆 · "), origin)).otherwise("来自记忆"))
        .when(kind == "web", F.when(F.length(published) > 0, F.concat(F.lit("发布于 "), F.substring(published, 1, 10))).otherwise("发布时间未知"))
        .otherwise(span)
    )


def private(text: Column, *markers: str) -> Column:
    """Whether a text that is to be public holds a marker or the path of a user's folder."""
    held = text.rlike(USER_PATH)
    for m in markers:
        held |= F.contains(text, F.lit(m))
    return held


def evidence_text(sources: Column) -> Column:
    """Numbered sources (title, heading, text) as a prompt shows them."""
    return F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("[S"), i + 1, F.lit("] "), s["title"], F.lit(" → "), s["heading"], F.lit("\n"), s["text"])), "\n\n")


def reduction_note(before: Column, after: Column, tokens: Column) -> Column:
    """A line that says how many sources a model's window took away; null if none."""
    return F.when(after < before, F.format_string("模型上下文窗口为 %d token，证据从 %d 条减到 %d 条；被减掉的条目没有参与生成。", tokens, before, after))


def rate_cell(kind: Column, hit_rate: Column, nodes: Column) -> Column:
    """A guide's rate of sourced lines, or a mind map's number of nodes: a map is made of its sources, so it has no rate."""
    map_ = F.when(nodes > 0, nodes.cast("string")).otherwise(NO_FIGURE)
    return F.when(kind == "mindmap", map_).when(hit_rate.isNull(), NO_FIGURE).otherwise(F.format_string("%.1f%%", hit_rate * 100))


def short_time(iso: Column) -> Column:
    return F.when(F.length(iso) > 0, F.replace(F.substring(iso, 1, 16), F.lit("T"), F.lit(" "))).otherwise(UNKNOWN)


def short_index(name: Column) -> Column:
    return F.when(F.length(name) > 0, F.substring(name, 1, 8)).otherwise(UNKNOWN)


def error_code(error: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(error, F.lit(held)), F.lit(code)) for held, code in ERRORS], F.lit("generation_failed"))


def measured(value: Column) -> Column:
    """A counter or duration as text, as a number; null where it is none or negative."""
    number = F.when(value.rlike(r"^\d+(\.\d+)?$"), value.cast("double"))
    return F.when(number >= 0, number)


def phases(prepare: Column, generation: Column, finalize: Column, total: Column) -> Column:
    """A map of timings: those of the preparation by name, the three phases, and what they leave of the total, never below 0."""
    ready = F.coalesce(F.try_element_at(prepare, F.lit("total_ms")), F.lit(0.0))
    parts = F.transform_keys(F.map_filter(prepare, lambda k, v: k != "total_ms"), lambda k, v: F.concat(F.lit("prepare_"), k))
    rest = F.greatest(F.lit(0.0), total - ready - generation - finalize)
    named = F.create_map(*[x for name, v in (("prepare_total_ms", ready), ("generation_wall_ms", generation), ("finalize_ms", finalize), ("runtime_overhead_ms", rest), ("runtime_total_ms", total)) for x in (F.lit(name), v)])
    return F.map_concat(parts, named)
