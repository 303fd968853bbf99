"""Text functions as Column expressions, so that they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.udfs import repair_and_unescape

CJK = "[\\u4e00-\\u9fff]"
TOKEN = "[a-z0-9][a-z0-9_\\-./]*|[\\u4e00-\\u9fff]+"

#: Words that say nothing about the evidence asked for. Fixed values.
EVIDENCE_STOPWORDS = ("什么", "哪些", "多少", "根据", "文档", "杂志", "产品", "手册", "进行", "一个", "一种", "相关", "信息", "提供", "说明", "推荐", "要求", "需要", "能够")
#: Words that mark a question as one about the contents as a whole. Fixed values.
NAVIGATION_TRIGGERS = ("有哪些", "列举", "记录了", "包括哪些", "目录", "案例", "文章", "主题")
#: Words of such questions that are no search terms. Fixed values.
NAVIGATION_STOPWORDS = ("中国", "中国无", "无线电", "杂志", "记录", "记录了", "哪些", "有哪些", "典型", "列举", "包括", "包括哪些", "根据", "这期", "文章", "主题", "目录")
#: Which words in a question name which source. Fixed values.
SOURCE_RULES = (("产品手册", "产品手册.pdf"), ("杂志", "杂志.pdf"), ("中国无线电", "杂志.pdf"))
#: Source names known to arrive garbled. Fixed values.
SOURCE_NAMES = {"浜у搧鎵嬪唽.pdf": "产品手册.pdf", "鏉傚織.pdf": "杂志.pdf"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def squeeze(text: Column) -> Column:
    """Runs of any blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def strip_markup(text: Column) -> Column:
    """Tags and Markdown images as spaces, then squeezed. Contents of script and style stay."""
    text = F.regexp_replace(text, "<[^>]+>", " ")
    return squeeze(F.regexp_replace(text, "!\\[[^\\]]*\\]\\([^)]+\\)", " "))


def whole_entities(text: Column) -> Column:
    """The text for ``clean`` to resolve only entities that end in a semicolon: other ampersands are escaped, so those of a text cut within ``&amp;`` stay as they are."""
    return F.regexp_replace(text, "&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def clean(text: Column) -> Column:
    """Repairs, resolves entities, strips markup, in this order, so that escaped tags go as well."""
    return strip_markup(repair_and_unescape(text))


def tokenize(text: Column) -> Column:
    """Tokens of a clean text: Latin words whole; runs of CJK as characters, then pairs, then triples."""
    base = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))

    def grams(run: Column, n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: run.substr(i, F.lit(n)))
        return F.when(F.length(run) >= n, some).otherwise(F.array().cast("array<string>"))

    split = F.flatten(F.transform(base, lambda t: F.when(t.rlike("^" + CJK), F.concat(grams(t, 1), grams(t, 2), grams(t, 3))).otherwise(F.array(t))))
    return F.when(text.rlike(CJK), split).otherwise(base)


def stable_id(*parts: Column) -> Column:
    """The first 12 hex digits of SHA-1 of the parts joined by bars; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays up to the shorter one's end; 0 if either is empty or null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def salient_terms(text: Column) -> Column:
    """Distinct tokens with CJK, of two characters or more, without the stop words."""
    return F.array_distinct(F.filter(tokenize(text), lambda t: t.rlike(CJK) & (F.length(t) >= 2) & ~t.isin(*EVIDENCE_STOPWORDS)))


def navigation_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(tokenize(text), lambda t: (F.length(t) >= 2) & ~t.isin(*NAVIGATION_STOPWORDS)))


def lexical_coverage(terms: Column, text: Column) -> Column:
    """The share of distinct terms among the text's tokens; 0 without terms."""
    return term_coverage(terms, tokenize(text))


def term_coverage(terms: Column, held: Column) -> Column:
    """The share of distinct terms among those held; 0 without terms."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, held)) / F.size(terms)).otherwise(F.lit(0.0))


def evidence_coverage(terms: Column, evidence: Column) -> tuple[Column, Column]:
    """(share of distinct terms among the evidence's, 1 without terms; the missing ones, sorted)."""
    share = F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, evidence)) / F.size(terms)).otherwise(F.lit(1.0))
    return share, F.array_sort(F.array_except(terms, evidence))


def insufficiency_note(coverage: Column, missing: Column, threshold: float = 0.35) -> Column:
    shown = F.array_join(F.slice(missing, 1, 8), "、")
    # the words of the note are fixed values
    note = F.concat(F.lit("证据充分性提示：当前候选证据对问题关键词覆盖较低（coverage="), F.format_string("%.2f", coverage), F.lit("）。未覆盖的关键词包括："), shown, F.lit("。如果后续 LLM 生成答案，应优先触发拒答或要求继续检索。"))
    return F.when(coverage >= threshold, F.lit("")).otherwise(note)


def query_variants(query: Column, most: int = 8) -> Column:
    """The query, then its parts of four characters or more between separators; distinct, at most so many."""
    parts = F.split(query, "[，,；;。\n]|并|以及|同时|且")
    parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[ ？?：:]+|[ ？?：:]+$", "")), lambda p: F.length(p) >= 4)
    return F.slice(F.array_distinct(F.concat(F.array(query), parts)), 1, most)


def source_hints(text: Column, rules: tuple = SOURCE_RULES) -> Column:
    """Sources that the words of a clean text name; possibly several."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.contains(word), F.lit(source)) for word, source in rules])))


def is_navigation(text: Column) -> Column:
    return text.rlike("|".join(NAVIGATION_TRIGGERS))


def known_source(name: Column, names: dict[str, str] | None = None) -> Column:
    """A source's right name, where it is known to arrive garbled."""
    pairs = [F.lit(x) for item in (names or SOURCE_NAMES).items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def page_matches(start: Column, end: Column, gold: Column) -> Column:
    """Whether the pages from start to end meet a gold page, ``"7"`` or ``"7-9"``; false for what is neither."""
    number = "^[ ]*[+-]?[0-9]+[ ]*$"
    left, right = F.substring_index(gold, "-", 1), F.expr("null")
    right = F.regexp_replace(gold, "^[^-]*-", "")
    ranged = F.when(left.rlike(number) & right.rlike(number), (start <= F.trim(right).try_cast("int")) & (end >= F.trim(left).try_cast("int")))
    single = F.when(gold.rlike(number), F.trim(gold).try_cast("int").between(start, end))
    return F.coalesce(F.when(gold.contains("-"), ranged).otherwise(single), F.lit(False))


def page_label(start: Column, end: Column) -> Column:
    one = F.concat(F.lit("第 "), start.cast("string"), F.lit(" 页"))
    return F.when(start == end, one).otherwise(F.concat(F.lit("第 "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" 页")))


def cut_at_word(text: Column, size: int) -> Column:
    """A clean text's first ``size`` characters, without the last word if it was cut; whole words only where there are any."""

    def cut(t: Column) -> Column:
        words = lambda head: bound(F.trim(F.regexp_extract(head, "^(?s)(.*) ", 1)), lambda w: F.when(w != "", w).otherwise(F.trim(head)))
        return F.when(F.length(t) <= size, t).otherwise(bound(F.substring(t, 1, size), words))

    return bound(text, cut)
