"""Queries of cleaning, chunking and text search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.registry import register_functions
from graphloom.operators import chunk as K
from graphloom.operators import search as S
from graphloom.operators.components import ensure_checkpoints
from graphloom.operators.text_index import TextIndex
from graphloom.plans.base import query, table
from graphloom.sources import code as C
from graphloom.sources import star
from graphloom.sources.star import EDGES_SQL, NODES_SQL

TOKENS = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}_]+)', 1)"


def _bm25_sql(docs: str, did: str, text: str, k1: float, okapi: bool, asked: str = "select item_id as query, text from benchmark") -> str:
    idf = "ln(n_docs - df + 0.5) - ln(df + 0.5)" if okapi else "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"
    floor = "case when raw < 0 then 0.25 * (select avg(raw) from r) else raw end" if okapi else "raw"
    return rf"""tok as (select {did} as doc, unnest({TOKENS.format(text)}) as term from {docs}), p as (select doc, term, cast(count(*) as double) as tf from tok group by doc, term),
dl as (select {did} as doc, cast(len({TOKENS.format(text)}) as double) as dl from {docs}), sz as (select cast(count(*) as double) as n_docs, avg(dl) as avgdl from dl),
q as (select query, term, count(*) as qtf from (select query, unnest({TOKENS.format("text")}) as term from ({asked})) group by query, term), dfs as (select term, cast(count(*) as double) as df from p group by term),
r as (select term, {idf} as raw from dfs, sz), i as (select term, {floor} as idf from r),
sc as (select query, doc, sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))) as score, count(*) as matched from p join q using (term) join i using (term) join dl using (doc), sz group by query, doc)"""


TOP = "select query, doc, score, rank from (select query, doc, s as score, row_number() over (partition by query order by s desc, doc) as rank from (select query, doc, round(score, 6) as s from sc) where s > 0) where rank <= {}"


@query("bm25_topk", f"with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)} {TOP.format(5)}")
def bm25_topk(spark, d):
    return S.bm25_top(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", 5).select("query", "doc", "score", "rank")


@query("bm25_okapi_topk", f"with {_bm25_sql('documents', 'doc_id', 'text', 1.5, True)} {TOP.format(5)}")
def bm25_okapi_topk(spark, d):
    return S.bm25_top(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", 5, k1=1.5, okapi=True).select("query", "doc", "score", "rank")


@query("fulltext_and", f"with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)}, w as (select query, count(*) as wanted from q group by query) select query, doc, round(score, 6) as score from sc join w using (query) where matched = wanted")
def fulltext_and(spark, d):
    found = S.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", all_terms=True)
    return found.select("query", "doc", F.round("score", 6).alias("score"))


#: Folders of text indexes, by session and source.
_INDEXES: dict[tuple[str, str], str] = {}


def text_index(spark, d):
    """The index of `documents`, built in two segments when a session first asks for it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        ensure_checkpoints(spark)
        index = TextIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/text-{uuid.uuid4().hex}")
        for even in (True, False):
            index.add(table(spark, d, "documents").where((F.col("doc_id") % 2 == 0) == even), "doc_id", "text")
        _INDEXES[key] = index.folder
    return TextIndex(spark, _INDEXES[key])


@query("index_bm25_topk", f"with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)} {TOP.format(5)}")
def index_bm25_topk(spark, d):
    return text_index(spark, d).search(table(spark, d, "benchmark"), 5, "item_id", "text")


@query("index_okapi_topk", f"with {_bm25_sql('documents', 'doc_id', 'text', 1.5, True)} {TOP.format(5)}")
def index_okapi_topk(spark, d):
    return text_index(spark, d).search(table(spark, d, "benchmark"), 5, "item_id", "text", k1=1.5, okapi=True)


@query("fulltext_two_field", f"with n as (select p_partkey, p_name, p_brand || ' ' || p_type as about from part), qs(item, words) as (values (1, 'brand#11 steel'), (2, 'part 7')), f as (select p_partkey as doc, 'a' as field, p_name as body from n union all select p_partkey, 'b', about from n), tok as (select field, doc, unnest({TOKENS.format('body')}) as term from f), p as (select field, doc, term, cast(count(*) as double) as tf from tok group by all), dl as (select field, doc, cast(len({TOKENS.format('body')}) as double) as dl from f), sz as (select field, cast(count(*) as double) as n_docs, avg(dl) as avgdl from dl group by field), q as (select query, term, count(*) as qtf from (select item as query, unnest({TOKENS.format('words')}) as term from qs) group by all), dfs as (select field, term, cast(count(*) as double) as df from p group by all), sc as (select cast(query as bigint) as query, doc, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from p join q using (term) join dfs using (field, term) join dl using (field, doc) join sz using (field) group by query, doc) {TOP.format(10)}")
def fulltext_two_field(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type").alias("about"))
    asked = spark.createDataFrame([(1, "brand#11 steel"), (2, "part 7")], "item long, words string")
    return S.top_per_query(S.fields_search(parts, asked, "p_partkey", ["p_name", "about"], "item", "words"), 10)


GROUP_SQL = r"""list_filter(string_split_regex(lower(summary), '\s+'), lambda w: w <> '')"""


@query("neighbour_bm25", f"""with {NODES_SQL}, {EDGES_SQL}, c as (select distinct e.end_node_index as seed, n.index as item, {GROUP_SQL} as w from edges e join nodes n on n.index = e.start_node_index where e.type = 'SUPPLIED_BY'),
sz as (select seed, cast(count(*) as double) as n, avg(len(w)) as avgdl from c group by seed), h as (select seed, item, cast(len(w) as double) as dl, term, cast(len(list_filter(w, lambda x: x = term)) as double) as tf from (select *, unnest(['small', 'brand#11', 'steel']) as term from c)),
dfs as (select seed, term, cast(count(*) as double) as df from h where tf > 0 group by all)
select seed, item, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from h join dfs using (seed, term) join sz using (seed) where tf > 0 group by seed, item""")
def neighbour_bm25(spark, d):
    near = star.edges(spark, d).where(F.col("type") == "SUPPLIED_BY").select(F.col("end_node_index").alias("seed"), F.col("start_node_index").alias("item"))
    texts = star.nodes(spark, d).where("type = 'part'").select(F.col("index").alias("item"), "summary")
    return S.group_bm25(near, "seed", "item", "summary", "small Brand#11 steel", texts=texts).withColumn("score", F.round("score", 6))


@query("keyword_filter", f"""with {NODES_SQL} select index, name, case when position('brand#1' in lower(name)) > 0 then 0 else 1 end as bucket, cast((position('brand#1' in lower(summary)) > 0) as bigint) + 0 as relevance from nodes where type = 'part' and position('brand#1' in lower(summary)) > 0""")
def keyword_filter(spark, d):
    parts = star.nodes(spark, d).where("type = 'part'")
    return S.keyword_filter(parts, "Brand#1", "name", "summary", "index", X.STOPWORDS)


@query("snippets", r"""select doc_id, case when position('tion' in lower(text)) > 0 then substring(text, greatest(position('tion' in lower(text)) - 30, 1), position('tion' in lower(text)) + 4 + 30 - greatest(position('tion' in lower(text)) - 30, 1)) end as snippet,
case when position('tion' in lower(text)) > 0 then md5(replace(text, substring(text, position('tion' in lower(text)), 4), '**' || substring(text, position('tion' in lower(text)), 4) || '**')) else md5(text) end as marked from documents""")
def snippets(spark, d):
    word = F.lit("tion")
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), word).alias("snippet"), F.md5(X.highlighted(F.col("text"), word)).alias("marked"))


@query("clean_text", r"""with a as (select doc_id, regexp_replace(text, '[\x{0000}\x{FEFF}\x{FFFE}\x{200B}\x{200C}\x{200D}\x{2060}]', '', 'g') as t from documents),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, chr(9), '    '), '[\t\x0B\f\r \x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +\n', chr(10), 'g') as t from a)
select doc_id, md5(trim(t, chr(10) || chr(13) || chr(9) || ' ')) as digest, length(trim(t, chr(10) || chr(13) || chr(9) || ' ')) as chars from b""")
def clean_text(spark, d):
    cleaned = X.clean(F.col("text"), unicode=False)
    return table(spark, d, "documents").select("doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("long").alias("chars"))


@query("clean_text_nfkc")
def clean_text_nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("digest"))


@query("strip_repeating_lines", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
c as (select *, count(*) over (partition by doc_id, trim(line)) as k from l)
select doc_id, md5(coalesce(string_agg(line, chr(10) order by n) filter (not (length(trim(line)) between 6 and 79 and k >= 3)), '')) as digest from c group by doc_id""")
def strip_repeating_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.without_repeating_lines(F.col("text"))).alias("digest"))


@query("clean_query", r"""with a as (select item_id, regexp_replace(regexp_replace(replace(text, chr(10), ' '), '^[-\s]+', ''), '[-\s]+$', '') as t from benchmark),
b as (select item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?:^|\s)[-•*]\s*', ' ', 'g'), '[:"''()\[\]{}<>^]', '', 'g'), '[+\-`]', ' ', 'g'), '\s+', ' ', 'g') as t from a)
select item_id, regexp_replace(trim(t), '\b(AND|OR|NOT|DE|IN|THE)\b', '"\1"', 'g') as query,
 array_to_string(list_filter(string_split_regex(regexp_replace(text, '[+\-&|!(){}\[\]^"~*?:\\/]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' AND ') as lucene,
 array_to_string(list_filter(string_split_regex(regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ') as plain from b join benchmark using (item_id)""")
def clean_query(spark, d):
    c = F.col("text")
    return table(spark, d, "benchmark").select("item_id", X.clean_query(c).alias("query"), X.search_terms(c).alias("lucene"), X.plain_terms(c).alias("plain"))


@query("html_to_text", r"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script[^>]*>.*?</script>', ' ', 'gsi'), '<style[^>]*>.*?</style>', ' ', 'gsi'), '<[^>]*>', ' ', 'gs') as t from pages)
select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) as digest from a""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("digest"))


STRIDE_SQL = "select doc_id, generate_subscripts(range(1, length(text) + 1, 800), 1) - 1 as chunk_id, substring(text, unnest(range(1, length(text) + 1, 800)), 1000) as chunk from documents where length(text) > 0"
WORDS_SQL = r"len(list_filter(string_split_regex(chunk, '[ \t\r\n]+'), lambda w: w <> ''))"


@query("chunk_stride", f"with c as ({STRIDE_SQL}) select doc_id, cast(chunk_id as bigint) as chunk_id, md5(chunk) as digest, 'standard' as chunk_method, cast(1000 as bigint) as chunk_size, {WORDS_SQL} as word_count from c")
def chunk_stride(spark, d):
    found = K.described(K.strides(table(spark, d, "documents"), "doc_id", "text"), "standard", 1000)
    return found.select("doc_id", "chunk_id", F.md5("chunk").alias("digest"), "chunk_method", "chunk_size", "word_count")


@query("chunk_statistics", f"with c as ({STRIDE_SQL}) select count(*) as chunks, round(avg(length(chunk))) as avg_chars, min(length(chunk)) as min_chars, max(length(chunk)) as max_chars, cast(sum(length(chunk)) as bigint) as total_chars from c")
def chunk_statistics(spark, d):
    return K.statistics(K.strides(table(spark, d, "documents"), "doc_id", "text"))


@query("chunk_parent_child", """with p as (select doc_id, generate_subscripts(range(1, length(text) + 1, 1800), 1) - 1 as parent_index, substring(text, unnest(range(1, length(text) + 1, 1800)), 2000) as t from documents where length(text) > 0),
c as (select doc_id, parent_index, t, generate_subscripts(range(1, length(t) + 1, 450), 1) - 1 as child_index, substring(t, unnest(range(1, length(t) + 1, 450)), 500) as chunk from p)
select doc_id, cast(parent_index as bigint) as parent_index, 'parent_' || substring(md5(substring(t, 1, 200)), 1, 8) || '_' || parent_index as parent_id, cast(child_index as bigint) as child_index, cast(ceil(length(t) / 450.0) as bigint) as siblings, md5(chunk) as digest from c""")
def chunk_parent_child(spark, d):
    found = K.parents_and_children(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "parent_index", "parent_id", "child_index", "siblings", F.md5("chunk").alias("digest"))


@query("expand_parents", """with h as (select item_id as rank, case when item_id % 4 <> 3 then 'p' || (item_id % 5) end as parent_id, text, length(text) as score from benchmark), p(parent_id, parent_text) as (values ('p0', 'zero'), ('p1', 'one'), ('p2', 'two'))
select rank, parent_id as key, coalesce(parent_text, text) as text, score from (select *, row_number() over (partition by parent_id order by rank) as n from h where parent_id is not null) left join p using (parent_id) where n = 1 union all select rank, null, text, score from h where parent_id is null""")
def expand_parents(spark, d):
    hits = table(spark, d, "benchmark").select(F.col("item_id").alias("rank"), F.when(F.col("item_id") % 4 != 3, F.concat(F.lit("p"), (F.col("item_id") % 5).cast("string"))).alias("parent_id"), "text", F.length("text").cast("long").alias("score"))
    return K.expand_to_parents(hits, spark.createDataFrame([("p0", "zero"), ("p1", "one"), ("p2", "two")], "parent_id string, parent_text string"))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return K.recursive(table(spark, d, "documents"), "doc_id", "text")


@query("chunk_code")
def chunk_code(spark, d):
    return K.code(table(spark, d, "documents"), "doc_id", "text", "python")


@query("chunk_contextual", f"with c as ({STRIDE_SQL}) select doc_id, cast(chunk_id as bigint) as chunk_id, md5('[Document Context: ' || trim(substring(chunk, 1, 200)) || ']' || chr(10) || chr(10) || chunk) as digest from c")
def chunk_contextual(spark, d):
    found = K.strides(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk_id", F.md5(X.with_context(F.col("chunk"))).alias("digest"))


@query("chunk_contextual_recursive")
def chunk_contextual_recursive(spark, d):
    return K.contextual(table(spark, d, "documents"), "doc_id", "text")


NAMES = (".py", ".HTML", ".ts", ".tex", ".unknown")


@query("code_languages", "select page_id, case page_id % 5 when 0 then 'python' when 1 then 'html' when 2 then 'typescript' when 3 then 'latex' else 'python' end as language from pages")
def code_languages(spark, d):
    return table(spark, d, "pages").select("page_id", K.language_of(F.concat("url", F.lit("/a"), F.array(*map(F.lit, NAMES))[(F.col("page_id") % 5).cast("int")])).alias("language"))


@query("chunk_code_files")
def chunk_code_files(spark, d):
    """Pages as files of five kinds, each cut as its extension says."""
    name = F.concat(F.lit("f"), F.array(*map(F.lit, NAMES))[(F.col("page_id") % 5).cast("int")])
    return K.code_files(table(spark, d, "pages").withColumn("name", name), "page_id", "html", "name")


@query("chunk_table_function")
def chunk_table_function(spark, d):
    """The recursive chunks of all documents by the table function, from SQL."""
    register_functions(spark)
    return spark.sql("select cast(id as bigint) as doc_id, chunk_id, chunk from chunk_table(table(select cast(doc_id as string), text from {docs}), 1000, 200)", docs=table(spark, d, "documents"))


CODE_SQL = """with f as (select p_partkey, p_name as name, cast(p_size as varchar) as size, case p_partkey % 3 when 0 then 'python' when 1 then 'javascript' end as language from part)
select p_partkey, language, case p_partkey % 3
when 0 then '=== FUNCTIONS_CLASSES ===' || chr(10) || 'def size_of(x):' || chr(10) || '    # ' || name || chr(10) || chr(10) || '    return ' || size || chr(10) || chr(10) || '=== FUNCTIONS_CLASSES ===' || chr(10) || 'class Part:' || chr(10) || '    n = ' || size || chr(10) || chr(10) || '=== SIMPLIFIED_CODE ===' || chr(10) || 'import sys' || chr(10) || chr(10) || '# Code for: def size_of(x):' || chr(10) || chr(10) || '# ' || name || chr(10) || '# Code for: class Part:' || chr(10) || 'NAME = "' || name || '"'
when 1 then '=== FUNCTIONS_CLASSES ===' || chr(10) || 'export async function sizeOf(x) {' || chr(10) || '  return ' || size || ';' || chr(10) || '}' || chr(10) || chr(10) || '=== SIMPLIFIED_CODE ===' || chr(10) || '// ' || name || chr(10) || '// Code for: export async function sizeOf(x) {' || chr(10) || 'const n = ' || size || ';'
else name || chr(10) || 'def size_of(x):' || chr(10) || size end as code from f"""


@query("code_sections", CODE_SQL)
def code_sections(spark, d):
    """Parts as files of Python, JavaScript and a kind that is not taken apart."""
    parts, size = table(spark, d, "part"), F.col("p_size").cast("string")
    python = F.concat(F.lit("import sys\n\ndef size_of(x):\n    # "), "p_name", F.lit("\n\n    return "), size, F.lit("\n\n# "), "p_name", F.lit("\nclass Part:\n    n = "), size, F.lit('\nNAME = "'), "p_name", F.lit('"\n'))
    script = F.concat(F.lit("// "), "p_name", F.lit("\nexport async function sizeOf(x) {\n  return "), size, F.lit(";\n}\nconst n = "), size, F.lit(";\n"))
    other = F.concat("p_name", F.lit("\ndef size_of(x):\n"), size)
    kind = F.col("p_partkey") % 3
    files = parts.select("p_partkey", F.when(kind == 0, python).when(kind == 1, script).otherwise(other).alias("text"), F.when(kind == 0, "a/b.py").when(kind == 1, "b.JSX").otherwise("notes").alias("name"))
    files = files.withColumn("language", F.nullif(K.language_of(F.col("name"), ""), F.lit("")))
    return files.select("p_partkey", "language", C.headed(C.code_sections(F.col("text"), F.col("language"))).alias("code"))


@query("chunk_markdown", """select p_partkey, 0 as section, p_brand as breadcrumb, 'intro ' || p_name as body from part union all select p_partkey, 1, p_brand || ' > ' || p_type, 'size ' || p_size from part union all select p_partkey, 3, p_type, 'end' from part""")
def chunk_markdown(spark, d):
    text = F.concat(F.lit("# "), "p_brand", F.lit("\nintro "), "p_name", F.lit("\n## "), "p_type", F.lit("\nsize "), F.col("p_size").cast("string"), F.lit("\n# x\n# "), "p_type", F.lit("\nend\n"))
    found = K.markdown(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")
    return found.select("p_partkey", F.col("section").cast("int").alias("section"), "breadcrumb", "body")


@query("chunk_router", """with n as (select page_id, url || case page_id % 5 when 0 then '/a.py' when 1 then '/a.MD' when 2 then '/a.txt' when 3 then '/a.pdf' else '/a.xyz' end as name from pages) select page_id, case page_id % 5 when 0 then 'code' when 1 then 'markdown' when 2 then 'standard' else 'semantic' end as chunker, name from n""")
def chunk_router(spark, d):
    m = F.col("page_id") % 5
    name = F.concat("url", F.when(m == 0, "/a.py").when(m == 1, "/a.MD").when(m == 2, "/a.txt").when(m == 3, "/a.pdf").otherwise("/a.xyz"))
    return table(spark, d, "pages").select("page_id", name.alias("name")).select("page_id", K.route(F.col("name")).alias("chunker"), "name")


SENT_SQL = r"select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as nth, s from (select doc_id, string_split(regexp_replace(text, '([.?!])[ \n]+', '\1' || chr(1), 'g'), chr(1)) as s from documents)"


@query("sentence_windows", f"with w as ({SENT_SQL}) select doc_id, cast(nth as bigint) as nth, length(sentence) as chars, md5(array_to_string(s[greatest(nth, 1):nth + 2], ' ')) as digest from w")
def sentence_windows(spark, d):
    found = K.sentence_windows(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "nth", F.length("sentence").cast("long").alias("chars"), F.md5("window").alias("digest"))


#: A stand-in for sentence vectors: counts of vowels, whose distances both engines work out alike.
VOWEL_SQL = "[" + ", ".join(f"cast(1 + length(sentence) - length(replace(lower(sentence), '{c}', '')) as double)" for c in "aeiou") + "]"


@query("semantic_segments", f"""with w as ({SENT_SQL}), v as (select doc_id, nth, sentence, {VOWEL_SQL} as v from w), n as (select *, lead(v) over (partition by doc_id order by nth) as u from v),
x as (select doc_id, nth, sentence, round(1 - list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 9) as distance from n), l as (select doc_id, quantile_cont(distance, 0.95) as lim from x group by doc_id),
s as (select doc_id, nth, sentence, coalesce(sum(cast(distance > lim as bigint)) over (partition by doc_id order by nth rows between unbounded preceding and 1 preceding), 0) as segment from x join l using (doc_id))
select doc_id, cast(segment as bigint) as segment, count(*) as n, md5(string_agg(sentence, ' ' order by nth)) as digest from s group by doc_id, segment""")
def semantic_segments(spark, d):
    from pyspark.sql import Window

    from graphloom.functions.records import dot

    rows = K.sentence_windows(table(spark, d, "documents"), "doc_id", "text", 0)
    vowels = F.array(*((1 + F.length("sentence") - F.length(F.replace(F.lower("sentence"), F.lit(c), F.lit("")))).cast("double") for c in "aeiou"))
    rows = rows.withColumn("v", vowels).withColumn("u", F.lead("v").over(Window.partitionBy("doc_id").orderBy("nth")))
    v, u = F.col("v"), F.col("u")
    rows = rows.withColumn("distance", F.round(1 - dot(v, u) / (F.sqrt(dot(v, v)) * F.sqrt(dot(u, u))), 9))
    return K.semantic(rows, "doc_id").select("doc_id", "segment", "n", F.md5("text").alias("digest"))
