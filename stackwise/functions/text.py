"""Text functions as column expressions: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ideograph and kana ranges of the tokenisers and of the token estimate.
CJK = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af"
#: Scripts written without spaces between words (Hangul is not among them), with the length mark they share.
UNSEGMENTED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\u30fc\\u3005-\\u3007"
#: Ideographs that OCR sets apart, without kana and Hangul (whose spaces part words), and what it sets between them.
HAN, HORIZONTAL = "\\u3400-\\u4dbf\\u4e00-\\u9fff", " \\t\\u3000\\u00a0"
# Extensions of the files that are read.
EXTENSIONS = ("txt", "md", "markdown", "mdx", "csv", "html", "htm", "json", "log", "pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "epub")
MAX_TERMS = 64


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    c = F.regexp_replace(c, "\r\n?", "\n")
    return trimmed(F.regexp_replace(c, "\n{3,}", "\n\n"))


def est_tokens(c: Column) -> Column:
    """max(1, ceil(ideographs / 1.5 + other characters / 4))."""
    cjk = F.regexp_count(c, F.lit(f"[{CJK}]"))
    return F.greatest(F.lit(1), F.ceil(cjk / 1.5 + (F.length(c) - cjk) / 4)).cast("long")


def char_budget(c: Column, size: int, overlap: int) -> tuple[Column, Column]:
    """Characters of a chunk and of its overlap for a budget in tokens, by the text's own characters per token."""
    size = max(64, int(size))
    overlap = max(0, min(int(overlap), size - 1))
    per = F.length(c) / est_tokens(c)
    chars = F.greatest(F.lit(64), F.floor(F.lit(size) * per + 0.5))
    return chars.cast("long"), F.least(F.floor(F.lit(overlap) * per + 0.5), chars - 1).cast("long")


def bigrams(run: Column) -> Column:
    """A run of one character as it is, a longer one as its overlapping pairs."""
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: run.substr(i, F.lit(2))))


def tok_bigram(c: Column) -> Column:
    """Latin runs of two or more, then the pairs of ideograph runs; duplicates stay."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0)), F.flatten(F.transform(runs, bigrams)))


def count_bigram(c: Column) -> Column:
    """How many ``tok_bigram`` has, without making them: of ideographs, those with another behind them and those that stand alone."""
    low = F.lower(c)
    pairs = F.regexp_count(low, F.lit(f"[{CJK}](?=[{CJK}])")) + F.regexp_count(low, F.lit(f"(?<![{CJK}])[{CJK}](?![{CJK}])"))
    return F.regexp_count(low, F.lit("[a-z0-9_]{2,}")) + F.when(F.octet_length(low) > F.length(low), pairs).otherwise(F.lit(0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tok_match_terms(c: Column, most: int = MAX_TERMS) -> Column:
    """Distinct words of three or more characters, then trigrams of longer unsegmented runs; the first ``most``."""
    parts = F.flatten(F.transform(tokens(c), lambda t: F.regexp_extract_all(t, F.lit(f"[{UNSEGMENTED}]+|[^{UNSEGMENTED}]+"), F.lit(0))))
    long_run = lambda p: F.regexp_like(p, F.lit(f"^[{UNSEGMENTED}]")) & (F.length(p) > 3)
    words = F.filter(parts, lambda p: (F.length(p) >= 3) & ~long_run(p))
    grams = F.flatten(F.transform(F.filter(parts, long_run), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3)))))
    return F.slice(F.array_distinct(F.concat(words, grams)), 1, most)


def tok_short_terms(c: Column) -> Column:
    """Distinct whole tokens of one or two characters."""
    return F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) < 3))


def ascii_lower(c: Column) -> Column:
    """A-Z folded and nothing else, as LIKE folds."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_contains(c: Column, part: Column) -> Column:
    """Literal substring, ASCII case ignored; %, _ and \\ mean themselves."""
    return F.contains(ascii_lower(c), ascii_lower(part))


def bm25_norm(score: Column) -> Column:
    return score / (score + 1)


def search_text(context: Column, text: Column) -> Column:
    return F.when(F.length(context) > 0, F.concat(context, F.lit("\n"), text)).otherwise(text)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def accepted(name: Column) -> Column:
    return extension(name).isin(*EXTENSIONS)


def parser_of(name: Column, mime: Column) -> Column:
    """Which parser reads a file: by MIME type for pdf and docx, else by extension, else as text."""
    ext = extension(name)
    mime = F.coalesce(mime, F.lit(""))
    return (
        F.when((mime == "application/pdf") | (ext == "pdf"), "pdf")
        .when((mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document") | (ext == "docx"), "docx")
        .when(ext.isin("html", "htm"), "html")
        .when(ext.isin("doc", "ppt", "xls", "pptx", "xlsx", "epub"), ext)
        .otherwise("text")
    )


def url_host(url: Column) -> Column:
    """Lower-cased host, without user, port and the brackets of an IPv6 address."""
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(rest), r"^\[|\]$", "")


# Hosts that may not be fetched.
BLOCKED_HOSTS = ("localhost", "0.0.0.0", "::1", "::", "metadata.google.internal", "169.254.169.254")
BLOCKED_RANGES = r"^(127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|0\.)"


def url_allowed(url: Column) -> Column:
    """http or https, and no loopback, private, link-local or metadata host."""
    host = url_host(url)
    return F.coalesce(F.regexp_like(F.lower(url), F.lit("^https?://")) & (host != "") & ~host.isin(*BLOCKED_HOSTS) & ~F.regexp_like(host, F.lit(BLOCKED_RANGES)), F.lit(False))


def ocr_despaced(c: Column) -> Column:
    """No horizontal spaces between two ideographs; line ends stay."""
    return F.regexp_replace(c, f"(?<=[{HAN}])[{HORIZONTAL}]+(?=[{HAN}])", "")


def avg_line_length(c: Column) -> Column:
    """Mean length of trimmed lines that are not empty; 0 without any."""
    lines = F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != "")
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return F.when(F.size(lines) > 0, total / F.size(lines)).otherwise(F.lit(0.0))


# The named character references that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "times": "×", "divide": "÷", "deg": "°", "plusmn": "±",
}


def named_entities(c: Column) -> Column:
    """The named references decoded in one scan, so that nothing is decoded twice; names in any case."""
    known = "&(?:" + "|".join(ENTITIES) + ");"
    value = F.create_map(*[F.lit(x) for name, v in ENTITIES.items() for x in (f"&{name};", v)])
    parts = F.regexp_extract_all(c, F.lit(f"(?i){known}|&|[^&]+"), F.lit(0))
    out = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("&")), F.coalesce(F.try_element_at(value, F.lower(p)), p)).otherwise(p))
    return F.when(F.contains(c, F.lit("&")), F.array_join(out, "")).otherwise(c)


def numeric_entities(c: Column) -> Column:
    """Hexadecimal, then decimal references, by cutting the text at them; what is no valid code point becomes U+FFFD."""

    def char(code: Column) -> Column:
        bad = code.isNull() | (code < 0) | (code > 0x10FFFF) | ((code >= 0xD800) & (code <= 0xDFFF))
        wide = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code).cast("long")), 8, "0")), "UTF-32")
        return wide

    def decoded(c: Column, found: str, digits: str, base: int) -> Column:
        parts = F.regexp_extract_all(c, F.lit(f"(?s){found}|.(?:(?!{found}).)*"), F.lit(0))
        code = lambda p: F.conv(F.regexp_extract(p, digits, 1), base, 10).cast("decimal(20,0)").cast("long")
        return F.when(F.regexp_like(c, F.lit(found)), F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(f"^{found}$")), char(code(p))).otherwise(p)), "")).otherwise(c)

    c = decoded(c, "&#[xX][0-9a-fA-F]+;", "&#[xX]([0-9a-fA-F]+);", 16)
    return decoded(c, "&#[0-9]+;", "&#([0-9]+);", 10)


def entities(c: Column) -> Column:
    return named_entities(numeric_entities(c))


def html_title(c: Column) -> Column:
    return entities(trimmed(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1)))


def html_text(c: Column) -> Column:
    """Comments, head, script, style and noscript dropped; block ends and breaks are line ends; other tags are spaces; lines collapsed, empty ones dropped."""
    c = F.regexp_replace(c, "(?s)<!--.*?-->", " ")
    for tag in ("head", "script", "style", "noscript"):
        c = F.regexp_replace(c, f"(?is)<{tag}.*?</{tag}>", " ")
    c = F.regexp_replace(c, "(?i)</(p|div|h[1-6]|li|tr|section|article|blockquote)>", "\n")
    c = F.regexp_replace(c, r"(?i)<(br|hr)\s*/?>", "\n")
    c = entities(F.regexp_replace(c, "<[^>]+>", " "))
    lines = F.transform(F.split(c, "\n"), lambda x: trimmed(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def citation(title: Column, heading: Column, base: Column, text: Column) -> Column:
    """The text as a quotation, and the line that names its source."""
    source = F.concat(title, F.when(F.length(heading) > 0, F.concat(F.lit(" / "), heading)).otherwise(F.lit("")), F.lit("（知识库 "), base, F.lit("）"))
    return F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> "), F.lit("\n>\n> — "), source)


def read_slice(c: Column, start: int, end: int | None, most: int = 20_000) -> tuple[Column, Column]:
    """The characters [start, end), at most ``most``, and whether text follows."""
    total = F.length(c)
    lo = F.least(F.greatest(F.lit(int(start)), F.lit(0)), total)
    hi = F.least(F.greatest(F.least(F.lit(int(end)) if end is not None else total, total), lo), lo + most)
    return c.substr(lo + 1, hi - lo), hi < total


def snippet(c: Column, terms: Column, before: int = 90, after: int = 180) -> Column:
    """A window around the first place of any term, with ellipses; without one, the beginning."""
    low = F.lower(c)
    places = F.filter(F.transform(terms, lambda t: F.position(F.lower(t), low)), lambda p: p > 0)
    at = F.array_min(places)
    lo = F.greatest(F.lit(0), at - 1 - before)
    hi = F.least(F.length(c), at - 1 + after)
    window = F.concat(F.when(lo > 0, "…").otherwise(""), c.substr(lo + 1, hi - lo), F.when(hi < F.length(c), "…").otherwise(""))
    head = F.concat(F.substring(c, 1, after), F.when(F.length(c) > after, "…").otherwise(""))
    return F.when(F.size(places) > 0, window).otherwise(head)


def highlight(c: Column, terms: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """Every place of a term, in any case, between marks."""
    import re

    known = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return F.regexp_replace(c, "(?i)(" + "|".join(map(re.escape, known)) + ")", f"{left}$1{right}") if known else c


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
