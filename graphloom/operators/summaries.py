"""Nested attributes of nodes as clean values and as lines of a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the keys of a gene's details stand for.
GENE_KEYS = {
    "name": "gene name",
    "type_of_gene": "gene types",
    "alias": "other gene names",
    "other_names": "extended other gene names",
    "genomic_pos": "genomic position",
    "generif": "PubMed text",
    "interpro": "protein family and classification information",
    "summary": "protein summary text",
}
#: Words of references, and reviews or questions, that a summary holds.
REFERENCE_WORDS, ENTRIES = 50_000, 27


def without_nan(value: Column, kind: T.DataType) -> Column:
    """A value with null for each NaN in it, however deep in arrays and structs."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_nan(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(without_nan(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def cleaned(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with null for each NaN in the given nested columns, such as lists of reviews."""
    return rows.withColumns({c: without_nan(F.col(c), rows.schema[c].dataType) for c in columns})


def detail_lines(details: Column, is_gene: Column) -> Column:
    """Lines `  - key: value` of a JSON object of details, as an array in the object's order.

    Keys that begin with `_` or hold `_id`, and empty values, are left out. A gene's keys say what they stand for; there
    families give their descriptions, references their texts, and of several positions the first counts. Nested values
    stay JSON. Null and what is no object give no lines.
    """
    pairs = F.map_entries(F.from_json(details, "map<string,string>"))
    labels = F.create_map(*(F.lit(x) for pair in GENE_KEYS.items() for x in pair))

    def line(pair: Column) -> Column:
        key, value = pair["key"], pair["value"]
        listed = F.when(value.startswith("["), value).otherwise(F.concat(F.lit("["), value, F.lit("]")))
        families = F.to_json(F.transform(F.from_json(listed, "array<struct<desc: string>>"), lambda x: x["desc"]))
        texts = F.array_join(F.transform(F.from_json(listed, "array<struct<text: string>>"), lambda x: x["text"]), "; ")
        references = F.array_join(F.slice(F.split(texts, " "), 1, REFERENCE_WORDS), " ")
        place = F.when(value.startswith("["), F.get_json_object(value, "$[0]")).otherwise(value)
        shown = F.when(is_gene & (key == "interpro"), families).when(is_gene & (key == "generif"), references).when(is_gene & (key == "genomic_pos"), place).otherwise(value)
        label = F.when(is_gene & F.map_contains_key(labels, key), F.concat(key, F.lit(" ("), labels[key], F.lit(")"))).otherwise(key)
        return F.concat(F.lit("  - "), label, F.lit(": "), shown)

    kept = F.filter(pairs, lambda p: ~(F.coalesce(p["value"], F.lit("")).isin("", "nan", "NaN") | p["key"].startswith("_") | p["key"].contains("_id")))
    return F.coalesce(F.transform(kept, line), F.expr("cast(array() as array<string>)"))


def described_node(name: Column, kind: Column, source: Column, details: Column) -> Column:
    """The summary of a node with details: name, type, source and, if there are any, the lines of its details."""
    lines = detail_lines(details, kind == "gene/protein")
    head = F.concat_ws("\n", F.concat(F.lit("- name: "), name), F.concat(F.lit("- type: "), kind), F.concat(F.lit("- source: "), source))
    return F.when(F.size(lines) > 0, F.concat_ws("\n", head, F.lit("- details:"), F.array_join(lines, "\n"))).otherwise(head)


def described_paper(title: Column, abstract: Column, date: Column, *venues: tuple[str, Column]) -> Column:
    """The summary of a paper: title, abstract, date, and the first venue that is known; -1 stands for what is not."""
    known = lambda c: c.isNotNull() & (c != "-1")
    where = F.coalesce(*(F.when(known(c), F.concat(F.lit(f" - {label}: "), c)) for label, c in venues))
    body = F.regexp_replace(F.replace(F.coalesce(abstract, F.lit("")), F.lit("\r"), F.lit("")), r"\n+\z", "")
    return F.concat_ws("\n", F.concat(F.lit(" - paper title: "), title), F.concat(F.lit(" - abstract: "), body), F.when(known(date), F.concat(F.lit(" - publication date: "), date)), where)


def counted(kind: Column, name: Column, papers: Column, citations: Column) -> Column:
    """The summary of an author, a field of study or an institution: its name and its counts of papers and citations.

    A count of -1 is not known and left out; -1 elsewhere, as in a name, reads Unknown.
    """
    heads = F.when(kind == "author", "- author name: ").when(kind == "field_of_study", " - field of study: ").when(kind == "institution", " - institution: ")
    label = F.when(kind == "field_of_study", "field").otherwise(kind)
    line = lambda what, n: F.when(n != -1, F.concat(F.lit("- "), label, F.lit(f" {what} count: "), n.cast("string")))
    text = F.concat_ws("\n", F.concat(heads, F.coalesce(name, F.lit(""))), line("paper", papers), line("citation", citations))
    return F.when(heads.isNotNull(), F.replace(text, F.lit("-1"), F.lit("Unknown")))


def described_product(title: Column, brand: Column, dimensions: Column, description: Column, features: Column, reviews: Column, questions: Column) -> Column:
    """The summary of a product: title, brand, size and weight, description, features, reviews and questions with answers.

    dimensions: `size ; weight`; another form is left out. description and features: arrays of strings; features that name
    an article number are left out and keep their places. reviews: array<struct<summary, reviewText, vote>>, those with most
    votes first, of equal ones the earlier; a vote may have commas, none counts as zero. questions: array<struct<question,
    answer>> in order. At most `ENTRIES` of either are shown, with their places. Null or empty parts leave no line.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    halves = F.split(dimensions, " ; ", -1)
    size = F.when(F.size(halves) == 2, F.concat(F.lit("- dimensions: "), halves[0], F.lit("\n- weight: "), halves[1]))
    whole = some(F.btrim(F.array_join(description, " "), F.lit(" ")))
    numbered = lambda items, show: F.filter(F.transform(items, lambda x, i: F.concat(F.lit("#"), (i + 1).cast("string"), F.lit(":"), show(x))), lambda x: x.isNotNull())
    block = lambda head, items: F.when(F.size(items) >= 0, F.concat_ws("\n", F.lit(head), items))
    shown = numbered(features, lambda x: F.when((x != "") & ~F.lower(x).contains("asin"), F.concat(F.lit(" "), x)))
    votes = F.transform(reviews, lambda x, i: F.struct((-F.coalesce(F.replace(x["vote"], F.lit(","), F.lit("")).cast("long"), F.lit(0))).alias("v"), i.alias("i"), x["summary"].alias("summary"), x["reviewText"].alias("text")))
    texts = F.transform(
        F.slice(F.array_sort(votes), 1, ENTRIES),
        lambda x: F.concat(F.lit("#"), (x["i"] + 1).cast("string"), F.lit(":\nsummary: "), F.coalesce(x["summary"], F.lit("")), F.lit('\ntext: "'), F.coalesce(x["text"], F.lit("")), F.lit('"')),
    )
    answers = numbered(F.slice(questions, 1, ENTRIES), lambda x: F.concat(F.lit('\nquestion: "'), F.coalesce(x["question"], F.lit("")), F.lit('"\nanswer: "'), F.coalesce(x["answer"], F.lit("")), F.lit('"')))
    filled = lambda items, made: F.when(F.size(items) > 0, made)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- product: "), title),
        F.concat(F.lit("- brand: "), some(brand)),
        size,
        F.concat(F.lit("- description: "), whole),
        filled(features, block("- features: ", shown)),
        filled(reviews, block("- reviews: ", texts)),
        filled(questions, block("- Q&A: ", answers)),
    )
