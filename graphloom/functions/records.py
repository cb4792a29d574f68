"""Functions over JSON, arrays, maps and validity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_list(text: Column) -> Column:
    """A list of ids from JSON or from a literal with blanks; null if it is neither."""
    return F.from_json(F.trim(text), "array<bigint>")


def findings(text: Column) -> Column:
    """A JSON list of texts, or the text itself as the only one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array(text))


def ranking(reply: Column, n: Column, complete: bool = True) -> Column:
    """Places 0 to n-1 from a reply such as {"ranking": [2, 0]}, else from its numbers in order.

    Places that are not valid and repeats go; missing ones follow in order if `complete`.
    """
    parsed = F.from_json(F.get_json_object(reply, "$.ranking"), "array<int>")
    rescued = F.transform(F.regexp_extract_all(reply, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    found = F.array_distinct(F.filter(F.coalesce(parsed, rescued), lambda x: (x >= 0) & (x < n)))
    if not complete:
        return found
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.concat(found, F.array_except(every, found))


def sub_queries(reply: Column, original: Column, most: int = 3) -> Column:
    """A JSON list in a reply, else what stands in its first brackets, else the original question; at most `most`."""
    inner = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    found = F.coalesce(F.from_json(reply, "array<string>"), F.from_json(inner, "array<string>"))
    found = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(original)), 1, most)


def tool_calls(content: Column) -> Column:
    """Structs (id, name, arguments) of all <tool_call> blocks; arguments stay JSON."""
    blocks = F.regexp_extract_all(content, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    return F.transform(blocks, lambda b, i: F.struct(F.concat(F.lit("call_"), i.cast("string")).alias("id"), F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))


def thinking(content: Column) -> Column:
    """(reasoning, rest): the texts of non-empty <think> blocks with blank lines between them, and all else."""
    found = F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1)), lambda x: F.btrim(x, F.lit(" \n"))), lambda x: x != "")
    rest = F.btrim(F.regexp_replace(content, r"(?s)<think>.*?</think>", ""), F.lit(" \n"))
    return F.struct(F.when(F.size(found) > 0, F.array_join(found, "\n\n")).alias("reasoning"), rest.alias("rest"))


def answer_nodes(value: Column) -> Column:
    """(id, reason) of answer nodes given as JSON objects with several spellings of their keys, or as texts."""
    items = F.from_json(value, "array<string>")
    pick = lambda x, *keys: F.coalesce(*(F.get_json_object(x, f"$.{k}") for k in keys))
    return F.transform(items, lambda x: F.struct(F.coalesce(pick(x, "id", "node_id", "nodeId", "name"), x).alias("id"), F.coalesce(pick(x, "reason", "reasoning", "description"), F.lit("")).alias("reason")))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's values win."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def without_keys(values: Column, *keys: str) -> Column:
    return F.map_filter(values, lambda k, v: ~k.isin(*keys))


def votes(value: Column) -> Column:
    """A count such as "1,234"; null and other texts are 0."""
    return F.coalesce(F.replace(value, F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0))


def is_true(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("true", "1", "yes")


def layered(*values: Column) -> Column:
    """The first value that is set: environment, file, default."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def query_error(query: Column, most: int = 10_000) -> Column:
    """Why a query is not valid; null if it is."""
    return F.when(query.isNull() | (F.trim(query) == ""), "empty").when(F.length(query) > most, "too long")


#: Validity of values by name.
VALID = {
    "non_empty": lambda c: c.isNotNull() & (F.trim(c) != ""),
    "positive_int": lambda c: F.coalesce(c.try_cast("bigint") > 0, F.lit(False)) & c.rlike(r"^\s*\d+\s*$"),
    "positive_number": lambda c: F.coalesce(c.try_cast("double") > 0, F.lit(False)),
    "port": lambda c: F.coalesce(c.try_cast("int").between(1, 65535), F.lit(False)),
    "url": lambda c: c.rlike(r"^https?://[^\s/]+"),
    "email": lambda c: c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
    "ip": lambda c: c.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"),
    "json": lambda c: F.try_parse_json(c).isNotNull(),
}


def valid_length(value: Column, least: int, most: int) -> Column:
    return F.length(value).between(least, most)


def valid_range(value: Column, least: float, most: float) -> Column:
    return F.coalesce(value.try_cast("double").between(least, most), F.lit(False))


def one_of(value: Column, *choices: str) -> Column:
    return value.isin(*choices)


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(pattern)


def scanned_page(fonts: Column, images: Column, chars: Column, image_share: Column, least_chars: int = 50) -> Column:
    """Whether a page's features say that it is a scan."""
    few = chars < least_chars
    return ((fonts == 0) & ((images > 0) | (chars == 0))) | ((images > 0) & few) | ((images == 1) & (image_share >= 0.8) & few)


def norm(vector: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; vectors of length zero count as length one."""
    own = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return dot(a, b) / (own(a) * own(b))
