"""Text expressions: cleaning, ids, splitting, templates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of set-valued strings and of extraction records, and limits of stored fields.
FIELD_SEP = "<SEP>"
TUPLE_SEP = "<|#|>"
END_MARK = "<|COMPLETE|>"
NAME_LIMIT = 256
SUMMARY_LIMIT = 250
# HTML escapes that are resolved, the ampersand last, so that nothing is resolved twice.
ESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#60;", "<"), ("&#62;", ">"), ("&#160;", "\u00a0"), ("&#38;", "&"), ("&amp;", "&"))


def sanitize(text: Column) -> Column:
    """Trimmed text without control characters (tab, newline and return stay) and U+FFFE/F, with ``ESCAPES`` resolved; null stays null."""
    t = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFE\\uFFFF]", "")
    for name, char in ESCAPES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", ""))


def hash_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: a prefix and the MD5 of the joined parts."""
    return F.concat(F.lit(prefix), F.md5(F.concat(*parts)))


def summary(text: Column, limit: int = SUMMARY_LIMIT) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("...")))


def tokens(text: Column) -> Column:
    """Tokens of the deterministic default tokenizer: runs between white space."""
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def split_markers(text: Column, *markers: str) -> Column:
    """Trimmed, non-blank parts between any of the markers; null gives an empty array."""
    pattern = "|".join("\\Q" + m + "\\E" for m in markers)
    parts = F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(FIELD_SEP, F.least(a, b), F.greatest(a, b))


# Full-width forms and the plain ones they become; marks that come off when they enclose a name.
WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９－＋／＊（）—　"
NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-+/*()- "
ENCLOSING = ('""', "''", "“”", "‘’", "《》")
SHORT_NUMBER = "^(?:[0-9]{1,2}|(?=.{1,5}$)[0-9.]*\\.[0-9.]*)$"
#: What isn't printable ASCII, or is one of ``"&'<``. Characters are listed one by one: a matcher looks them up at once, but tries ranges in turn.
ODD = "[^" + "".join(c if c.isalnum() else "\\" + c for c in map(chr, range(0x20, 0x7F)) if c not in "\"&'<") + "]"
HAN, BESIDE_HAN = "[\\u4e00-\\u9fa5]", "[a-zA-Z0-9()\\[\\]@#$%!&*\\-=+_]"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def normalized(text: Column, inner_quotes: bool = False) -> Column:
    """Extracted text as it is stored: markup off, full-width forms plain, no blanks beside Chinese characters but those
    between other words, enclosing quotes off where none of their kind are inside, short numbers dropped.

    With ``inner_quotes`` Chinese quotes and plain ones beside Chinese characters go, and hard blanks become blanks.
    """
    t = F.translate(F.regexp_replace(text, "(?i)</p\\s*>|<p\\s*>|<p/>|</br\\s*>|<br\\s*>|<br/>", ""), WIDE, NARROW)
    t = F.regexp_replace(t, f"(?U)(?<={HAN})\\s+(?={HAN}|{BESIDE_HAN})|(?<={BESIDE_HAN})\\s+(?={HAN})", "")
    for left, right in ENCLOSING:
        t = F.regexp_replace(t, f"^{left}([^{left}{right}]*){right}$", "$1")
    if inner_quotes:
        t = F.regexp_replace(F.translate(t, "“”‘’", ""), f"['\"]+(?={HAN})|(?<={HAN})['\"]+", "")
        t = F.regexp_replace(F.translate(t, "\u00a0", " "), "(?<=[^\\d])\u202f", " ")
    t = _stripped(t)
    return F.regexp_replace(t, SHORT_NUMBER, "")


def cleaned(text: Column, inner_quotes: bool = False) -> Column:
    """``normalized`` of the sanitized text. Printable ASCII without ``"&'<`` is only trimmed and rid of short numbers, as
    nothing else of both applies to it; ``text`` is asked for several times, so it should be a plain column."""
    odd = text.rlike(ODD)
    return F.when(odd, normalized(sanitize(text), inner_quotes)).otherwise(F.regexp_replace(F.trim(text), SHORT_NUMBER, ""))


def normalize_name(text: Column) -> Column:
    """A name as it is stored: cleaned, normalized with its inner quotes, and cut to the limit."""
    return F.substring(cleaned(text, inner_quotes=True), 1, NAME_LIMIT)


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?s)^(<think>.*?</think>|.*</think>)", ""))


def is_number(text: Column) -> Column:
    return text.rlike("^[-+]?[0-9]*\\.?[0-9]+$")


def query_mode(query: Column) -> Column:
    """Struct mode, context_only, user_prompt, query of a prefixed query: ``/mode[prompt] text``; the default is mix."""
    pattern = "(?s)^/(localcontext|globalcontext|hybridcontext|naivecontext|mixcontext|local|global|hybrid|naive|mix|bypass|context)?(?:\\[([^\\]]*)\\])?(?:\\s+|$)(.*)$"
    name, prompt, rest = (F.regexp_extract(query, pattern, i) for i in (1, 2, 3))
    given = query.rlike(pattern) & ((name != "") | (prompt != ""))
    mode = F.when(name.isin("", "context"), "mix").otherwise(F.regexp_replace(name, "context$", ""))
    return F.struct(
        F.when(given, mode).otherwise("mix").alias("mode"), F.when(given, name.endswith("context")).otherwise(False).alias("context_only"),
        F.when(given & (prompt != ""), prompt).alias("user_prompt"), F.when(given, rest).otherwise(query).alias("query"),
    )


def modality(content: Column, is_multimodal: Column | None = None, original_type: Column | None = None) -> Column:
    """Modality of a chunk: its recorded type, else the first rule its text meets, else text."""
    t = F.lower(content)
    guess = F.when(t.contains("image content analysis") | t.contains("image path:"), "image").when(t.contains("table analysis") | t.contains("structure:"), "table").when(t.contains("mathematical equation") | t.contains("equation:"), "equation").otherwise("text")
    return guess if is_multimodal is None else F.when(is_multimodal & original_type.isNotNull(), original_type).otherwise(guess)


def block_text(kind: Column, text: Column, level: Column) -> Column:
    """A content block as one line of context."""
    return F.when(kind == "text", F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)).when(kind == "image", F.concat(F.lit("[Image: "), text, F.lit("]"))).when(kind == "table", F.concat(F.lit("[Table: "), text, F.lit("]"))).otherwise(text)


def truncate_sentence(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters: after the last full stop or newline where that keeps over 80 %, else with dots."""
    cut = F.substring(text, 1, limit)
    back = lambda c: limit - F.locate(c, F.reverse(cut))  # noqa: E731  0-based place of the last c
    stop, line = back("."), back("\n")
    return F.when(F.length(text) <= limit, text).when((F.locate(".", cut) > 0) & (stop > limit * 0.8), F.substring(text, F.lit(1), stop + 1)).when((F.locate("\n", cut) > 0) & (line > limit * 0.8), F.substring(text, F.lit(1), line)).otherwise(F.concat(cut, F.lit("...")))


def cache_key(mode: Column, kind: Column, *parts: Column) -> Column:
    """``mode:kind:hash`` of the joined parts."""
    return F.concat_ws(":", mode, kind, F.md5(F.concat(*parts)))


def parsed_cache_key(key: Column) -> Column:
    """Struct mode, cache_type, hash; null where there are fewer than three parts. The hash may hold colons."""
    p = F.split(key, ":", 3)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("mode"), p[1].alias("cache_type"), p[2].alias("hash")))


def uuid_of(text: Column) -> Column:
    """32 hexadecimal digits of a version 4 UUID made of the text's SHA-256."""
    h = F.sha2(text, 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def extracted_answer(text: Column) -> Column:
    """What stands between the two labels, trimmed; the whole text after the first where the second is missing."""
    after = F.substring_index(text, "Extracted answer:", -1)
    return F.trim(F.substring_index(after, "Answer format:", 1))


def keywords(text: Column) -> Column:
    """Struct high and low: the keyword lists in the first JSON object of a model's text, empty where there is none."""
    parsed = F.from_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0), "high_level_keywords array<string>, low_level_keywords array<string>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(parsed["high_level_keywords"], none).alias("high"), F.coalesce(parsed["low_level_keywords"], none).alias("low"))


def resolved_keywords(query: Column, high: Column, low: Column) -> Column:
    """Struct high and low: a query under 50 characters without keywords is its own low-level keyword."""
    bare = (F.size(high) == 0) & (F.size(low) == 0) & (F.length(query) < 50)
    return F.struct(high.alias("high"), F.when(bare, F.array(query)).otherwise(low).alias("low"))
