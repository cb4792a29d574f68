"""Chunking of texts into rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import extension, parent_id, sentences, with_context

#: Chunkers by file extension; others are chunked by meaning.
ROUTES = {
    ".md": "markdown",
    ".mdx": "markdown",
    ".html": "markdown",
    ".htm": "markdown",
    ".txt": "standard",
    ".csv": "standard",
    ".log": "standard",
    ".pdf": "semantic",
    ".docx": "semantic",
    ".doc": "semantic",
    ".pptx": "semantic",
    ".py": "code",
    ".js": "code",
    ".jsx": "code",
    ".ts": "code",
    ".tsx": "code",
    ".java": "code",
    ".go": "code",
    ".rs": "code",
    ".rb": "code",
    ".c": "code",
    ".h": "code",
    ".cpp": "code",
    ".hpp": "code",
    ".cs": "code",
    ".kt": "code",
    ".swift": "code",
    ".php": "code",
    ".lua": "code",
    ".scala": "code",
    ".ex": "code",
    ".exs": "code",
    ".tex": "code",
    ".rst": "code",
}
#: Languages of code by file extension.
EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cc": "cpp",
    ".cs": "csharp",
    ".scala": "scala",
    ".swift": "swift",
    ".tex": "latex",
    ".html": "html",
    ".htm": "html",
    ".sol": "sol",
    ".php": "php",
    ".hs": "haskell",
    ".ex": "elixir",
    ".exs": "elixir",
    ".kt": "kotlin",
    ".lua": "lua",
    ".pl": "perl",
    ".pm": "perl",
    ".ps1": "powershell",
    ".proto": "proto",
    ".rst": "rst",
    ".cob": "cobol",
}
SEPARATORS = ("\n\n", "\n", " ", "")
#: What begins a definition or a block of a language; code is cut before it first, at the start of a line but for tags.
LANGUAGES = {
    "c": ("struct", "enum", "void", "int", "float", "double", "if", "for", "while", "switch"),
    "cobol": ("IDENTIFICATION DIVISION", "DATA DIVISION", "PROCEDURE DIVISION", "SECTION", "PERFORM", "IF"),
    "cpp": ("class", "namespace", "struct", "template", "void", "int", "float", "double", "if", "for", "while", "switch"),
    "csharp": ("namespace", "interface", "enum", "class", "public", "protected", "private", "static", "if", "for", "foreach", "while", "switch"),
    "elixir": ("defmodule", "def", "defp", "defprotocol", "defmacro", "if", "unless", "case", "cond"),
    "go": ("func", "type", "var", "const", "if", "for", "switch"),
    "haskell": ("module", "import", "data", "newtype", "type", "class", "instance", "where", "let"),
    "html": ("<body", "<div", "<section", "<h1", "<h2", "<h3", "<p", "<table", "<ul", "<li"),
    "java": ("class", "interface", "enum", "public", "protected", "private", "static", "if", "for", "while", "switch"),
    "js": ("function", "class", "const", "let", "var", "if", "for", "while", "switch"),
    "kotlin": ("class", "object", "interface", "fun", "val", "var", "if", "for", "while", "when"),
    "latex": ("\\chapter", "\\section", "\\subsection", "\\subsubsection", "\\begin"),
    "lua": ("function", "local function", "local", "if", "for", "while", "repeat"),
    "markdown": ("#", "##", "###", "####", "#####", "######", "```", "---"),
    "perl": ("package", "sub", "use", "if", "foreach", "for", "while"),
    "php": ("namespace", "class", "interface", "trait", "function", "if", "foreach", "while", "switch"),
    "powershell": ("function", "param", "class", "if", "foreach", "for", "while", "switch"),
    "proto": ("message", "service", "enum", "option", "import", "syntax"),
    "python": ("class", "def", "async def", "\tdef", "    def"),
    "rst": ("===", "---", "***", ".."),
    "ruby": ("module", "class", "def", "if", "unless", "while", "for", "begin"),
    "rust": ("mod", "pub", "fn", "struct", "enum", "trait", "impl", "const", "let", "if", "for", "while", "match"),
    "scala": ("object", "class", "trait", "def", "val", "var", "if", "for", "while", "match"),
    "sol": ("pragma", "contract", "interface", "library", "function", "event", "modifier", "struct", "enum", "if", "for"),
    "swift": ("struct", "class", "enum", "extension", "func", "if", "for", "while", "switch"),
    "ts": ("namespace", "enum", "interface", "type", "class", "function", "const", "let", "var", "if", "for", "while", "switch"),
}
LANGUAGES |= {"javascript": LANGUAGES["js"], "typescript": LANGUAGES["ts"]}


def code_separators(language: str) -> tuple[str, ...]:
    """Where code of a language is cut: before the marks above, then as any text; other languages are cut as any text.

    Words stand at the start of a line with a blank behind them, and so do headings of `#`. Other marks, such as commands
    and rules of lines, need none, and tags may stand anywhere.
    """

    def separator(mark: str) -> str:
        if mark.startswith("<"):
            return mark
        return f"\n{mark} " if mark.strip()[0].isalpha() or mark.startswith("#") else f"\n{mark}"

    return (*map(separator, LANGUAGES.get(language.lower(), ())), *SEPARATORS)


def language_of(name: Column, default: str = "python") -> Column:
    """The language of a file of code by its extension."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit(default))


def _strides(text: Column, size: int, overlap: int) -> Column:
    """The pieces of `size` characters that start every size - overlap, as an array; null for no text."""
    starts = F.sequence(F.lit(1), F.length(text), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: text.substr(s, F.lit(size))))


def strides(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id_col, chunk_id, chunk): pieces of `size` characters that start every size - overlap. Only the pieces leave a text's row."""
    rows = docs.select(F.col(id_col), F.posexplode_outer(_strides(F.col(text_col), size, overlap)).alias("chunk_id", "chunk"))
    return rows.where("chunk is not null").withColumn("chunk_id", F.col("chunk_id").cast("long"))


def described(chunks: DataFrame, method: str, size: int) -> DataFrame:
    """Chunks with their method, size limit and number of words."""
    words = F.size(F.filter(F.split("chunk", r"[ \t\r\n]+"), lambda w: w != "")).cast("long")
    return chunks.withColumns({"chunk_method": F.lit(method), "chunk_size": F.lit(size).cast("long"), "word_count": words})


def parents_and_children(docs: DataFrame, id_col: str, text_col: str, parent: tuple[int, int] = (2000, 200), child: tuple[int, int] = (500, 50)) -> DataFrame:
    """(id_col, parent_index, parent_id, child_index, siblings, chunk): children of each parent chunk."""
    outer = strides(docs, id_col, text_col, *parent)
    step = child[0] - child[1]
    parents = outer.select(id_col, F.col("chunk_id").alias("parent_index"), parent_id(F.col("chunk"), F.col("chunk_id")).alias("parent_id"), F.ceil(F.length("chunk") / step).cast("long").alias("siblings"), _strides(F.col("chunk"), *child).alias("_c"))
    inner = parents.select(id_col, "parent_index", "parent_id", "siblings", F.posexplode_outer("_c").alias("child_index", "chunk")).where("chunk is not null")
    return inner.select(id_col, "parent_index", "parent_id", F.col("child_index").cast("long").alias("child_index"), "siblings", "chunk")


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """(rank, key, text, score) of ranked hits (rank, parent_id, text, score): the first hit of each parent, with the parent's text.

    parents: (parent_id, parent_text). Hits without a parent id pass, and a parent that is not there leaves its hit's text.
    """
    own = Window.partitionBy("parent_id").orderBy("rank")
    child = hits.where("parent_id is not null").withColumn("_n", F.row_number().over(own)).where("_n = 1")
    grown = child.join(parents, "parent_id", "left").select("rank", F.col("parent_id").alias("key"), F.coalesce("parent_text", "text").alias("text"), "score")
    return grown.union(hits.where("parent_id is null").select("rank", F.lit(None).cast("string"), "text", "score"))


def _split(text: str, separators: tuple[str, ...], size: int, overlap: int) -> Iterator[str]:
    """Pieces of at most `size` characters where separators allow it, cut at the first separator that occurs."""
    mark, rest = next(((s, separators[k + 1 :]) for k, s in enumerate(separators) if s == "" or s in text), ("", ()))
    parts = list(text) if mark == "" else text.split(mark)
    if mark.strip():  # a heading or definition stays with what follows
        parts = [parts[0], *(mark + p for p in parts[1:])]
    glue = "" if mark.strip() else mark
    held: list[str] = []
    total = 0

    def out() -> Iterator[str]:
        joined = glue.join(held).strip()
        if joined:
            yield joined

    for part in filter(None, parts):
        if len(part) > size:
            yield from out()
            held, total = [], 0
            yield from _split(part, rest, size, overlap) if rest else [part]
            continue
        if held and total + len(glue) + len(part) > size:
            yield from out()
            while held and (total > overlap or total + len(glue) + len(part) > size):
                total -= len(held.pop(0)) + (len(glue) if held else 0)
        total += len(part) + (len(glue) if held else 0)
        held.append(part)
    yield from out()


def _cut(column: pa.Array, separators: tuple[str, ...], size: int, overlap: int, rows: int = 64) -> pa.Array:
    """The pieces of each text; only `rows` texts at a time are Python's objects."""
    kind = pa.list_(pa.string())
    parts = (column.slice(i, rows).to_pylist() for i in range(0, len(column), rows))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([list(_split(x or "", separators, size, overlap)) for x in part], kind) for part in parts)])


def recursive(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(id_col, chunk_id, chunk): pieces cut at paragraphs, else lines, else words, else anywhere; a tail up to `overlap` is carried on."""

    @F.arrow_udf("array<string>")
    def cut(column: pa.Array) -> pa.Array:
        return _cut(column, separators, size, overlap)

    pieces = docs.select(F.col(id_col), F.posexplode(cut(F.col(text_col))).alias("chunk_id", "chunk"))
    return pieces.withColumn("chunk_id", F.col("chunk_id").cast("long"))


def code(docs: DataFrame, id_col: str, text_col: str, language: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """As `recursive`, cut at the definitions of a language of `LANGUAGES` first."""
    return recursive(docs, id_col, text_col, size, overlap, code_separators(language))


def code_files(docs: DataFrame, id_col: str, text_col: str, name_col: str, size: int = 1500, overlap: int = 200, default: str = "python") -> DataFrame:
    """(id_col, language, chunk_id, chunk): files of several languages in one pass, each cut as the extension of its name says."""
    separators = {language: code_separators(language) for language in {*EXTENSIONS.values(), default}}

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, languages: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), languages.to_pylist(), strict=True)
        return pa.array([list(_split(x or "", separators[language], size, overlap)) for x, language in rows], pa.list_(pa.string()))

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), language_of(F.col(name_col), default).alias("language"))
    pieces = rows.select(id_col, "language", F.posexplode(cut(F.col("_text"), F.col("language"))).alias("chunk_id", "chunk"))
    return pieces.withColumn("chunk_id", F.col("chunk_id").cast("long"))


def contextual(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Recursive chunks behind their context."""
    return recursive(docs, id_col, text_col, size, overlap).withColumn("chunk", with_context(F.col("chunk")))


def markdown(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, section, breadcrumb, body): texts cut at # to #### headings, with the headings above each part.

    A text is cut before its headings at once, within its own row; only the titles are folded from section to section.
    """
    sections = F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?md)(?=^#{1,4} +\S)", -1)
    depth = lambda x: F.length(F.regexp_extract(x, r"^(#{1,4}) +\S", 1))
    title = lambda x: F.trim(F.regexp_replace(F.substring_index(x, "\n", 1), r"^#+ +", ""))
    heads = F.transform(sections, lambda x: F.struct(depth(x).alias("depth"), F.when(depth(x) > 0, title(x)).alias("title")))
    start = F.struct(F.expr("cast(array('', '', '', '') as array<string>)").alias("path"), F.expr("cast(array() as array<string>)").alias("crumbs"))

    def add(done, head):
        path = F.transform(done["path"], lambda p, i: F.when((head["depth"] == 0) | (i + 1 < head["depth"]), p).when(i + 1 == head["depth"], head["title"]).otherwise(""))
        return F.struct(path.alias("path"), F.array_append(done["crumbs"], F.array_join(F.filter(path, lambda p: p != ""), " > ")).alias("crumbs"))

    parts = docs.select(F.col(id_col), F.posexplode(F.arrays_zip(sections.alias("text"), F.aggregate(heads, start, add, lambda x: x["crumbs"]).alias("breadcrumb"))).alias("section", "p"))
    body = F.btrim(F.regexp_replace("p.text", r"\A#{1,4} +\S[^\n]*", ""), F.lit(" \n"))
    return parts.select(id_col, F.col("section").cast("long").alias("section"), F.col("p.breadcrumb").alias("breadcrumb"), body.alias("body")).where("body <> ''")


def route(name, fallback: str = "semantic"):
    """The chunker for a file name."""
    known = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit(fallback))


def sentence_windows(docs: DataFrame, id_col: str, text_col: str, around: int = 1) -> DataFrame:
    """(id_col, nth, sentence, window): sentences with their neighbours on each side, joined by blanks."""
    rows = docs.select(F.col(id_col), sentences(F.col(text_col)).alias("s"))
    rows = rows.select(id_col, F.posexplode(F.transform("s", lambda x, i: F.struct(x.alias("sentence"), F.array_join(F.slice("s", F.greatest(i + 1 - around, F.lit(1)), F.least(i + 1 + around, F.size("s")) - F.greatest(i - around, F.lit(0))), " ").alias("window")))).alias("nth", "x"))
    return rows.select(id_col, F.col("nth").cast("long").alias("nth"), "x.sentence", "x.window")


def semantic(vectors: DataFrame, id_col: str, percentile: float = 0.95) -> DataFrame:
    """(id_col, segment, n, text): sentences joined until the distance to the next is over the document's percentile.

    vectors: (id_col, nth, sentence, distance to the next sentence; null for the last).
    """
    limit = vectors.groupBy(id_col).agg(F.percentile("distance", F.lit(percentile)).alias("limit"))
    own = Window.partitionBy(id_col).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    cut = vectors.join(limit, id_col).withColumn("segment", F.coalesce(F.sum((F.col("distance") > F.col("limit")).cast("long")).over(own), F.lit(0)))
    parts = cut.groupBy(id_col, "segment").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("nth", "sentence"))).alias("s"))
    return parts.select(id_col, "segment", "n", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("text"))


def statistics(chunks: DataFrame) -> DataFrame:
    n = F.length("chunk")
    return chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(n)).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.sum(n).cast("long").alias("total_chars"))
