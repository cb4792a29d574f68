"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the keyword filter.
STOPWORDS = "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should may might can must shall this that these those i you he she it we they me him her us them".split()
#: Words that a search query must quote.
RESERVED = ("AND", "OR", "NOT", "DE", "IN", "THE")
#: Characters that are invisible or a byte order mark.
INVISIBLE = "\x00﻿￾​‌‍⁠"

#: Blanks within a line: what Unicode counts as white space, but for the line end.
_BLANKS = r"[\t\x0B\f\r \x1C-\x1F\u0085   -     　]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Words between white space; none for blank texts."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clean_query(query: Column) -> Column:
    """A query without bullets and signs that search syntax would read, its reserved words quoted."""
    out = F.replace(query, F.lit("\n"), F.lit(" "))
    for pattern, by in ((r"^[-\s]+", ""), (r"[-\s]+$", ""), (r"(?:^|\s)[-•*]\s*", " "), (r"""[:"'()\[\]{}<>^]""", ""), (r"[+\-`]", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(F.trim(out), rf"\b({'|'.join(RESERVED)})\b", '"$1"')


def search_terms(query: Column, joiner: str = " AND ") -> Column:
    """Words of a query without search syntax, joined."""
    return F.array_join(words(F.regexp_replace(query, r'[+\-&|!(){}\[\]^"~*?:\\/]', " ")), joiner)


def plain_terms(query: Column) -> Column:
    """Letters and digits of a query, all else a blank."""
    return F.array_join(words(F.regexp_replace(query, r"[^\p{L}\p{N}_]", " ")), " ")


def entity_key(name: Column) -> Column:
    return F.upper(F.trim(name))


def relation_type(name: Column) -> Column:
    """Upper case, blanks as underscores, other signs dropped; RELATED_TO if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.replace(entity_key(name), F.lit(" "), F.lit("_")), "[^A-Z0-9_]", ""), F.lit("")), F.lit("RELATED_TO"))


def without_invisible(text: Column) -> Column:
    return F.regexp_replace(text, "[" + "".join(f"\\u{ord(c):04x}" for c in INVISIBLE) + "]", "")


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for; ASCII texts never leave the JVM's own path."""

    @F.arrow_udf("string")
    def compose(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in column.to_pylist()], pa.string())

    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(compose(text))


def collapse_blanks(text: Column) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit("    ")), _BLANKS + "+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), " +\n", "\n")


def without_page_marks(text: Column) -> Column:
    out = F.regexp_replace(text, r"---\s*Page\s*\d+\s*---\n?", "")
    out = F.regexp_replace(out, r"(?m)^\s*\d{1,4}\s*$", "")
    return F.regexp_replace(out, r"(?i)Page\s+\d+\s+of\s+\d+", "")


def without_repeating_lines(text: Column, least: int = 3) -> Column:
    """A text without its lines of 6 to 79 trimmed characters that occur `least` times or more."""
    lines = F.split(text, "\n", -1)
    short = F.array_sort(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (F.length(x) > 5) & (F.length(x) < 80)))
    step = least - 1
    # each of these becomes a variable by a transform over one element; an expression would be worked out for every line
    bound = F.transform(F.array(F.struct(lines.alias("all"), short.alias("short"))), lambda b: F.struct(b["all"].alias("all"), F.array_distinct(F.filter(b["short"], lambda x, i: F.get(b["short"], i + step) == x)).alias("out")))
    return F.transform(bound, lambda b: F.array_join(F.filter(b["all"], lambda x: ~F.array_contains(b["out"], F.trim(x))), "\n"))[0]


def clean(text: Column, file_type: str = "text", unicode: bool = True, headers: bool = False) -> Column:
    """The cleaning steps in order: invisible characters, NFKC, page marks and headers of PDFs, blanks, ends."""
    out = without_invisible(text)
    if unicode:
        out = nfkc(out)
    if file_type == "pdf":
        out = without_page_marks(out)
        if headers:
            out = without_repeating_lines(out)
    return F.btrim(collapse_blanks(out), F.lit(" \n\r\t"))


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def without_fences(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?m)^```[a-zA-Z]*\s*$", ""), F.lit(" \n"))


def first_object(text: Column) -> Column:
    """The text from the first { to the last }; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def html_to_text(html: Column) -> Column:
    """Visible text by patterns alone: comments, scripts, styles and tags go, five references are decoded."""
    out = html
    for pattern, by in ((r"(?s)<!--.*?-->", " "), (r"(?si)<script[^>]*>.*?</script>", " "), (r"(?si)<style[^>]*>.*?</style>", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"[ \t\r\n]+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def snippet(text: Column, word: Column, around: int = 30) -> Column:
    """The first place of a word in a text with `around` characters on each side; null if it is not there."""
    at = F.instr(F.lower(text), F.lower(word))
    start = F.greatest(at - around, F.lit(1))
    return F.when((at > 0) & (word != ""), F.substring(text, start, at + F.length(word) + around - start))


def highlighted(text: Column, word: Column) -> Column:
    """A text with every copy of the word's first form in it between pairs of asterisks."""
    at = F.instr(F.lower(text), F.lower(word))
    form = F.substring(text, at, F.length(word))
    return F.when((at > 0) & (word != ""), F.replace(text, form, F.concat(F.lit("**"), form, F.lit("**")))).otherwise(text)


def extension(name: Column) -> Column:
    """The last part of a file name from its dot on, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/\\]*)$", 1), r".(\.[^.]*)$", 1))


def file_name_of_url(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)


def is_object_url(url: Column) -> Column:
    return url.rlike(r"^(s3|s3a|https?)://")


def truncated(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def with_context(text: Column, most: int = 200) -> Column:
    """A chunk behind its document's context, of which the first characters are the stand-in."""
    return F.concat(F.lit("[Document Context: "), F.trim(F.substring(text, 1, most)), F.lit("]\n\n"), text)


def claim_id(subject: Column, description: Column) -> Column:
    return F.concat(F.lit("CLM_"), F.substring(F.sha2(F.concat(F.upper(subject), F.lit(":"), F.lower(description)), 256), 1, 16))


def parent_id(text: Column, index: Column) -> Column:
    return F.concat(F.lit("parent_"), F.substring(F.md5(F.substring(text, 1, 200)), 1, 8), F.lit("_"), index.cast("string"))


def markdown_table(header: Column, rows: Column) -> Column:
    """A header array and an array of row arrays as a Markdown table; rows are padded or cut to the header's width."""
    n = F.size(header)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    fitted = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), 1, n)
    return F.array_join(F.concat(F.array(line(header), line(F.transform(header, lambda _: F.lit("---")))), F.transform(rows, lambda r: line(fitted(r)))), "\n")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ? or ! and white space, which goes."""
    return F.split(F.regexp_replace(text, r"([.?!])[ \n]+", "$1\u0001"), "\u0001")


def lines(*fields: tuple[str, Column]) -> Column:
    """A node's summary: a line `- label: value` for each value that is set; -1 stands for one that is unknown."""
    shown = (F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"- {label}: "), F.when(value == "-1", "Unknown").otherwise(value))) for label, value in fields)
    return F.concat_ws("\n", *shown)
