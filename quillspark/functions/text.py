"""Text scalars as Column builders: all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the query grammar.
STOP_PHRASES = ("解决什么问题", "分别起什么作用", "有什么关系", "什么是", "是什么", "有哪些", "有什么", "为什么", "如何", "怎么样", "分别", "作用", "问题", "它", "一个", "一种", "这个", "该", "基础", "用户问题", "用户", "系统", "最终回答", "回答", "最终", "通常", "经历", "哪些", "步骤", "能力", "方面", "从", "到")
CONNECTORS = "[的了和与在对将把由及等]"
ACTIONS = ("预订", "订票", "购买", "下单", "支付", "发送邮件", "删除文件", "修改文件")
PERSONAL = ("我的简历", "根据我", "适合我", "我的经历", "我的偏好")
REALTIME_HARD = ("天气", "气温", "空气质量", "汇率", "股价", "比分", "航班", "限行", "热搜")
REALTIME_SOFT = ("今天", "明天", "最新", "实时", "价格")
STATIC_CONTEXT = ("最新论文", "最新研究", "最新版本", "最新进展", "最新工作", "实时推理", "实时计算", "实时系统", "实时性", "价格模型", "价格策略", "价格敏感", "定价", "我的资料", "我的笔记", "资料里", "笔记里", "文档里", "这份文档")
SPECULATION = ("推测", "可能", "一般而言", "根据常识", "我认为", "大概")
ABSTENTION = ("知识库资料不足", "资料不足", "无法提供", "无法回答", "未提供详细", "无法直接找到", "未给出明确支持")
PENDING_HEADING, PENDING_FACTOR = "待继续拆分", 0.35
FOLLOW_UP = "^(?:它|这个|这项|上述|前面|刚才|那个|那它|还有|那么|为什么|怎么做|有何区别)|(?:呢|还有吗)$"
CJK = "[\\x{4e00}-\\x{9fff}]"
#: Group 1 looks ahead to the token, what follows consumes a whole Latin run or one CJK character, so pairs may overlap.
TOKEN = f"(?=([a-z0-9]+|{CJK}{{2}}|(?<!{CJK}){CJK}(?!{CJK})))(?:[a-z0-9]+|{CJK})"


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def strip(text: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Tokens in order: lower-case Latin-and-digit runs whole, CJK runs as overlapping pairs (a lone character stays)."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def tokenize_query(text: Column) -> Column:
    """Distinct tokens of a question without its stop phrases (longest first) and connectors, sorted."""
    clean = F.lower(text)
    for phrase in sorted(STOP_PHRASES, key=len, reverse=True):
        clean = F.replace(clean, F.lit(phrase), F.lit(" "))
    return F.array_sort(F.array_distinct(tokenize(F.regexp_replace(clean, CONNECTORS, " "))))


def first_phrase(text: Column, phrases) -> Column:
    """First of ``phrases`` in their own order that ``text`` contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def rejection(question: Column) -> Column:
    """Why a static corpus cannot answer: ``action:…``, ``personal:…`` or ``realtime:…``; null if it can."""
    text = F.lower(question)
    soft = F.when(first_phrase(text, STATIC_CONTEXT).isNull(), first_phrase(text, REALTIME_SOFT))
    tag = lambda kind, phrase: F.concat(F.lit(f"{kind}:"), phrase)
    return F.coalesce(tag("action", first_phrase(text, ACTIONS)), tag("personal", first_phrase(text, PERSONAL)), tag("realtime", F.coalesce(first_phrase(text, REALTIME_HARD), soft)))


def citation_labels(answer: Column) -> Column:
    """Distinct upper-case labels inside square brackets, in order of first use."""
    inside = F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(F.upper(x), F.lit(r"(S\d+)"), F.lit(1)))))


def single_citations(line: Column) -> Column:
    """Labels of the strict form ``[S1]`` only, one to a bracket."""
    return F.regexp_extract_all(line, F.lit(r"\[(S\d+)\]"), F.lit(1))


def lines(text: Column) -> Column:
    """Lines without the empty one that a closing line feed leaves."""
    flat = F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", "\n")
    return F.when(F.length(flat) > 0, F.split(F.regexp_replace(flat, r"\n$", ""), "\n")).otherwise(F.array().cast("array<string>"))


def excerpt(text: Column, matched: Column) -> Column:
    """Lines with a matched token and the non-blank line above each; the whole text if no line has one."""
    rows = lines(strip(text))
    hit = F.transform(rows, lambda x: F.arrays_overlap(tokenize(x), matched))
    blank = lambda x: F.length(strip(x)) == 0
    keep = F.filter(rows, lambda x, i: ~blank(x) & (F.get(hit, i) | F.coalesce(F.get(hit, i + 1), F.lit(False))))
    return F.when(F.exists(hit, lambda h: h), F.array_join(keep, "\n")).otherwise(strip(text))


def quality_factor(heading: Column) -> Column:
    return F.when(F.contains(heading, F.lit(PENDING_HEADING)), F.lit(PENDING_FACTOR)).otherwise(F.lit(1.0))


def decompose(question: Column) -> Column:
    """Sub-questions of an enumerating question (one that holds 分别 after two or more subjects); others as they are."""
    at = F.instr(question, "分别")
    before, after = question.substr(F.lit(1), at - 1), question.substr(at + 2, F.length(question))
    place = F.instr(before, "在")
    subjects = F.when(place > 0, before.substr(F.lit(1), place - 1)).otherwise(before)
    suffix = strip(F.when(place > 0, F.concat(F.lit("在"), before.substr(place + 1, F.length(before)), F.lit(" "), after)).otherwise(after))
    parts = F.filter(F.transform(F.split(F.replace(F.regexp_replace(subjects, "[、和与]", "|"), F.lit("以及"), F.lit("|")), r"\|"), strip), lambda x: F.length(x) > 0)
    return F.when((at > 0) & (F.size(parts) >= 2), F.transform(parts, lambda x: strip(F.concat(x, F.lit(" "), suffix)))).otherwise(F.array(question))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def highlighted(text: Column, tokens: Column) -> Column:
    """``text`` as an array of (text, hit): the places of ``tokens`` in any case, from the left, the longest first where several
    begin, none over another. Null and empty tokens count for nothing; without any hit the text is one piece."""
    quoted = lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    needles = F.array_distinct(F.transform(F.filter(tokens, lambda t: F.length(t) > 0), F.lower))
    needles = F.transform(F.array_sort(F.transform(needles, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: quoted(x["t"]))
    pattern = F.concat(F.lit("(?iu)(?:"), F.array_join(needles, "|"), F.lit(")"))
    hits, rest = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, F.lit(-1))
    both = F.flatten(F.transform(rest, lambda x, i: F.array(F.struct(x.alias("text"), F.lit(False).alias("hit")), F.struct(F.get(hits, i).alias("text"), F.lit(True).alias("hit")))))
    pieces = F.filter(both, lambda x: F.length(x["text"]) > 0)
    whole = F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    return F.when(text.isNotNull(), F.when((F.size(needles) > 0) & (F.size(pieces) > 0), pieces).otherwise(whole))
