"""Source code as typed sections: the definitions of a file, and what is left with a note in the place of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.chunk import language_of
from graphloom.sources.files import read_texts

_MODIFIERS = r"(?:(?:export|default|public|protected|private|internal|abstract|final|sealed|static|open|data|case|async|unsafe|partial|readonly|declare|pub(?:\([^)\n]*\))?) +)*"
#: How a definition at the start of a line begins, for each language whose files are taken apart.
DEFINITIONS = {
    "python": r"(?:async +def|def) +\w+ *[(\[]|class +\w+ *[:(\[]",
    "javascript": _MODIFIERS + r"(?:function\b|class +\w)",
    "typescript": _MODIFIERS + r"(?:function\b|class +\w|interface +\w|enum +\w|namespace +\w)",
    "java": _MODIFIERS + r"(?:class|interface|enum|record) +\w",
    "csharp": _MODIFIERS + r"(?:class|interface|enum|struct|record|namespace) +\w",
    "kotlin": _MODIFIERS + r"(?:class|interface|object|fun) +\w",
    "scala": _MODIFIERS + r"(?:class|trait|object|def) +\w",
    "swift": _MODIFIERS + r"(?:class|struct|enum|protocol|extension|func) +\w",
    "go": r"func\b|type +\w+ +(?:struct|interface)\b",
    "rust": _MODIFIERS + r"(?:fn|struct|enum|trait|impl|mod)\b",
    "php": _MODIFIERS + r"(?:function|class|interface|trait) +\w",
    "c": r"(?:struct|enum|union)\b[^;\n]*(?:\n|\z)|[A-Za-z_][\w \t*]*\([^;\n]*(?:\n|\z)",
    "cpp": r"(?:struct|enum|union|class|namespace|template)\b[^;\n]*(?:\n|\z)|[A-Za-z_][\w \t*&:<>~,]*\([^;\n]*(?:\n|\z)",
    "ruby": r"(?:def|class|module) +\w",
    "lua": r"(?:local +)?function\b",
    "elixir": r"(?:defmodule|defprotocol|defimpl|def|defp) +\w",
    "perl": r"sub +\w",
}
#: Languages that close a definition by a word, and those whose comments begin with other marks than //.
WORDED, MARKS = ("ruby", "lua", "elixir"), {"python": "#", "ruby": "#", "elixir": "#", "perl": "#", "lua": "--"}
#: Lines that go on with what is above them: blank or indented ones, closing brackets, braces, comments.
_TOP = r"[^\s)\]}{#/*]"


def code_sections(text: Column, language: Column) -> Column:
    """array<struct<kind, content>>: first each definition at the start of a line ("functions_classes"), in order, then the
    text with `Code for: <first line>` in the place of each ("simplified_code").

    A definition ends before the next line at the margin, without the blank lines and comments between them; so a line of
    a string that stands at the margin ends it as well, but for those between triple double quotes in Python. Decorators stay in the rest. A language that `DEFINITIONS`
    lacks, or null, gives the whole text ("code"); a null text counts as empty. Everything happens within the row, in
    time linear in its length, by expressions alone.
    """
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    # line ends within long strings stand aside as NUL, where marks of such strings come in pairs and the text has no NUL
    quoted = F.split(lines, '"""', -1)
    aside = (language == "python") & (F.size(quoted) > 1) & (F.size(quoted) % 2 == 1) & ~F.contains(lines, F.lit("\0"))
    plain = F.when(aside, F.array_join(F.transform(quoted, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("\n"), F.lit("\0"))).otherwise(x)), '"""')).otherwise(lines)
    back = lambda x: F.when(aside, F.replace(x, F.lit("\0"), F.lit("\n"))).otherwise(x)
    parts = F.when(language.isin(*WORDED), F.split(plain, rf"(?m)(?=^(?!end\b){_TOP})", -1)).otherwise(F.split(plain, rf"(?m)(?=^{_TOP})", -1))
    mark = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair)), language), F.lit("//"))

    def defines(part: Column) -> Column:
        found = F.lit(False)
        for name, begin in DEFINITIONS.items():
            found = F.when(language == name, part.rlike(rf"\A(?:{begin})")).otherwise(found)
        return found

    def body(part: Column) -> Column:
        last = F.regexp_extract(part, r"(?s)\A(.*\n(?:[ \t]+[^\s][^\n]*|[)\]}][^\n]*|end\b[^\n]*))", 1)
        return F.when(defines(part), F.coalesce(F.nullif(last, F.lit("")), F.substring_index(part, "\n", 1)))

    def noted(x: Column) -> Column:
        note = F.concat(mark, F.lit(" Code for: "), F.substring_index(x["part"], "\n", 1), F.substring(x["part"], F.length(x["body"]) + 1, F.length(x["part"])))
        return F.when(x["body"].isNull(), x["part"]).otherwise(note)

    cut = F.transform(parts, lambda p: F.struct(p.alias("part"), body(p).alias("body")))
    found = F.transform(F.filter(cut, lambda x: x["body"].isNotNull()), lambda x: F.struct(F.lit("functions_classes").alias("kind"), back(x["body"]).alias("content")))
    rest = F.regexp_replace(back(F.array_join(F.transform(cut, noted), "")), r"\n\z", "")
    whole = F.array(F.struct(F.lit("code").alias("kind"), F.coalesce(text, F.lit("")).alias("content")))
    return F.when(language.isin(*DEFINITIONS), F.array_append(found, F.struct(F.lit("simplified_code").alias("kind"), rest.alias("content")))).otherwise(whole)


def headed(sections: Column) -> Column:
    """One text of all sections, each but plain code under `=== KIND ===`, with an empty line between."""
    return F.array_join(F.transform(sections, lambda s: F.when(s["kind"] == "code", s["content"]).otherwise(F.concat(F.lit("=== "), F.upper(s["kind"]), F.lit(" ===\n"), s["content"]))), "\n\n")


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """(path, language, encoding, sections, text) of source files; the language goes by the extension, null if it is unknown. Spark's reader passes over
    empty files and over those whose names begin with _ or a dot."""
    rows = read_texts(spark, path).withColumn("language", F.nullif(language_of(F.col("path"), ""), F.lit("")))
    rows = rows.withColumn("sections", code_sections(F.col("text"), F.col("language")))
    return rows.select("path", "language", "encoding", "sections", headed(F.col("sections")).alias("text"))
