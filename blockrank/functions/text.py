"""Text functions on columns; no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results depend on these words.
LEXICAL_STOP = "api http https www com org net rest json xml get post put delete 管理 系统 模块 接口 服务 功能 方案 流程 问题 方法 数据 设计 开发".split()
ANCHOR_STOP = [w for w in LEXICAL_STOP if w not in ("get", "post", "put", "delete")]
EXPANSION_STOP = "a an and are as at be best can do does for from how i in it is of on or please tell the to what when where which why with would you your 原理 机制 概念 解释 介绍 如何 怎么 怎样".split()
KEYWORD_STOP = "actually basically easily just quickly really safely simply similarly truly".split()
COMPACT_STOP = "actually basically easily just quickly really similarly truly".split()
QUESTION_WORDS = "how what why when where which who can do does should".split()

TOKEN = r"[0-9A-Za-z_]+|[一-鿿]{2,}"
INDEX_TOKEN = r"[0-9a-z_]+|[一-鿿]+"
SPACE = r"(?U)\s"


def words(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def is_short_ascii(token: Column) -> Column:
    return token.rlike("^[0-9A-Za-z_]+$") & (F.length(token) < 3)


def query_tokens(text: Column) -> Column:
    """Distinct lower-case tokens in order, without ASCII ones of fewer than three characters."""
    return F.filter(F.array_distinct(all_matches(F.lower(text), TOKEN)), lambda t: ~is_short_ascii(t))


def index_tokens(text: Column) -> Column:
    return all_matches(F.lower(text), INDEX_TOKEN)


def word_keys(low: Column) -> Column:
    """Distinct ASCII words of lower-case text."""
    return F.array_distinct(all_matches(low, "[0-9a-z_]+"))


def character_pairs(low: Column) -> Column:
    """Distinct pairs of neighbours in runs of CJK characters."""
    runs = all_matches(low, "[一-鿿]{2,}")
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))


def anchor_terms(text: Column) -> Column:
    return F.array_except(query_tokens(text), words(ANCHOR_STOP))


def highlight_tokens(a: Column, b: Column, most: int = 24) -> Column:
    """Distinct tokens of a that b has in any case, in order."""
    pattern = r"[0-9A-Za-z_]+|[一-鿿]+"
    lower = F.transform(all_matches(b, pattern), F.lower)
    return F.slice(F.array_distinct(F.filter(all_matches(a, pattern), lambda t: F.array_contains(lower, F.lower(t)))), 1, most)


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean_text(raw: Column) -> Column:
    """Comments, links and fences out; labels stay."""
    steps = [
        (r"(?s)<!--.*?-->", " "),
        (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"),
        (r"\[\[([^\]|]*)[^\]]*\]\]", "$1"),
        # a label of white space alone leaves a space, any other is trimmed
        (r"(?U)!\[\s*\]\([^)]+\)|\[\s+\]\([^)]+\)", " "),
        (r"(?U)!\[\s*([^\]]*?)\s*\]\([^)]+\)|\[\s*([^\]]+?)\s*\]\([^)]+\)", "$1$2"),
        (r"(?U)https?://[^\s)>]+", " "),
        (r"(?s)`{3}.*?`{3}", " "),
    ]
    for pattern, to in steps:
        raw = F.regexp_replace(raw, pattern, to)
    return squeeze(raw)


def inline_tags(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"(?U)(?<!\w)#([a-zA-Z0-9_\-/]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def link_target(raw: Column) -> Column:
    """struct(path, heading, block) of a link's target."""
    mark = F.instr(raw, "#^")
    hash_ = F.instr(raw, "#")
    target = F.when(mark > 0, F.substring_index(raw, "#^", 1)).when(hash_ > 0, F.substring_index(raw, "#", 1)).otherwise(raw)
    after = lambda n: raw.substr(hash_ + n, F.length(raw))
    path = squeeze_ends(target)
    return F.struct(
        F.when(path.endswith(".md"), path).otherwise(F.concat(path, F.lit(".md"))).alias("path"),
        F.when((mark == 0) & (hash_ > 0), after(1)).alias("heading"),
        F.when(mark > 0, raw.substr(mark + 2, F.length(raw))).alias("block"),
    )


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_anchor(target: Column) -> Column:
    return squeeze_ends(F.when(F.instr(target, "#^") > 0, F.substring_index(target, "#^", 1)).otherwise(F.substring_index(target, "#", 1)))


def path_suffix(path: Column) -> Column:
    """Of the last part: from its last dot, unless that is the first or the last character."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def classify_target(raw: Column) -> Column:
    t = squeeze_ends(raw)
    bare = strip_anchor(raw)
    suffix = F.lower(path_suffix(bare))
    return (
        F.when(t == "", "empty_target")
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "external_scheme")
        .when(bare == "", "same_note_anchor")
        .when((suffix != "") & (suffix != ".md"), "non_markdown_target")
        .otherwise("markdown_note_target")
    )


def note_path(raw: Column, kind: Column) -> Column:
    """A note target with `.md` and no leading slash; null for any other kind."""
    bare = F.regexp_replace(strip_anchor(raw), "^/+", "")
    return F.when(kind == "markdown_note_target", let(bare, lambda b: F.when(F.lower(b).endswith(".md"), b).otherwise(F.concat(b, F.lit(".md")))))


def normal_target(raw: Column) -> Column:
    return note_path(raw, classify_target(raw))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def heading_line(headings: Column) -> Column:
    return F.array_join(F.filter(F.transform(headings, squeeze_ends), lambda h: h != ""), " > ")


def embedding_input(headings: Column, text: Column, most: int = 2400) -> Column:
    head = heading_line(headings)
    return F.substring(F.when(head == "", text).otherwise(F.concat(F.lit("Heading: "), head, F.lit("\nCurrent: "), text)), 1, most)


def block_query_text(headings: Column, text: Column) -> Column:
    return squeeze_ends(F.concat(heading_line(headings), F.lit("\n"), text))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, 220)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def pseudo_embedding(text: Column, dims: int = 64) -> Column:
    """A vector from the text's SHA-256 bytes, of length one."""

    def spread(digest: Column) -> Column:
        byte = lambda i: F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(i) / 255.0 - 0.5)

    def unit(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(raw, lambda x: x / n))

    return let(let(F.sha2(text, 256), spread), unit)
